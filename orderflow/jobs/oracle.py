"""DuckDB SQL for the queries of ``catalog``."""

from __future__ import annotations

_MSGS = """m0 AS (SELECT event_id, user_id, ts, value, props, CASE event_type WHEN 'signup' THEN 'A' WHEN 'click' THEN 'M' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'E' WHEN 'error' THEN 'D' END AS msg_type,
  last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_id FROM events),
msgs AS (SELECT event_id AS seq, epoch_us(ts) * 1000 AS feed_time, msg_type, CAST(user_id AS INT) AS symbol_idx, order_id,
  CASE order_id % 2 WHEN 0 THEN 'B' WHEN 1 THEN 'S' END AS side, CASE WHEN msg_type IN ('A', 'M') THEN CAST(floor(value) AS BIGINT) END AS price,
  CASE WHEN msg_type <> 'D' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS size FROM m0)"""
_STATES = f"""{_MSGS},
s0 AS (SELECT *, sum(CASE WHEN msg_type IN ('A', 'M') THEN 1 ELSE 0 END) OVER (PARTITION BY order_id ORDER BY seq) AS seg FROM msgs WHERE order_id IS NOT NULL),
s1 AS (SELECT *, greatest(0, CASE WHEN msg_type = 'D' THEN 0 ELSE sum(CASE WHEN msg_type IN ('A', 'M') THEN size WHEN msg_type IN ('C', 'E') THEN -size ELSE 0 END) OVER (PARTITION BY order_id, seg ORDER BY seq) END) AS rem,
  last_value(price IGNORE NULLS) OVER (PARTITION BY order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_price FROM s0),
s2 AS (SELECT *, min(CASE WHEN rem = 0 THEN seq END) OVER (PARTITION BY order_id) AS death FROM s1),
st AS (SELECT seq, feed_time, msg_type, symbol_idx, order_id, side, now_price AS price, CAST(rem AS BIGINT) AS rem,
  CAST(coalesce(lag(rem) OVER w, 0) AS BIGINT) AS was_rem, lag(now_price) OVER w AS was_price FROM s2 WHERE death IS NULL OR seq <= death WINDOW w AS (PARTITION BY order_id ORDER BY seq))"""
_DELTAS = f"""{_STATES},
de AS (SELECT seq, feed_time, symbol_idx, side, price, CAST(sum(s) AS BIGINT) AS d_size, CAST(sum(n) AS BIGINT) AS d_orders FROM (
  SELECT seq, feed_time, symbol_idx, side, was_price AS price, -was_rem AS s, CASE WHEN was_rem > 0 THEN -1 ELSE 0 END AS n FROM st WHERE was_price IS NOT NULL
  UNION ALL SELECT seq, feed_time, symbol_idx, side, price, rem, CASE WHEN rem > 0 THEN 1 ELSE 0 END FROM st)
  GROUP BY ALL HAVING sum(s) <> 0 OR sum(n) <> 0)"""
_HISTORY = f"""{_DELTAS},
hi AS (SELECT seq, feed_time, symbol_idx, side, price, CAST(sum(d_size) OVER w AS BIGINT) AS agg_size, CAST(sum(d_orders) OVER w AS BIGINT) AS num_orders, lead(seq) OVER w AS next_seq
  FROM de WINDOW w AS (PARTITION BY symbol_idx, side, price ORDER BY seq))"""
_ROWS = """r0 AS (SELECT CAST(l_suppkey AS INT) AS symbol_idx, CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'S' END AS side, l_orderkey * 8 + l_linenumber AS order_id,
  CAST(floor(l_extendedprice / 1000) AS BIGINT) AS price, CAST(floor(l_extendedprice) AS BIGINT) AS ticks, CAST(l_quantity AS BIGINT) AS size,
  row_number() OVER (PARTITION BY l_orderkey * 8 + l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS insert_no FROM lineitem)"""
_REST = f"{_ROWS}, rest AS (SELECT * EXCLUDE (insert_no) FROM r0 WHERE insert_no = 1)"
_LEVELS = f"""{_REST},
lv AS (SELECT symbol_idx, side, price, CAST(sum(size) AS BIGINT) AS agg_size, count(*) AS num_orders FROM rest GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol_idx, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END) - 1 AS INT) AS idx FROM lv)"""
_SEC = "sec AS (SELECT CAST(s_suppkey AS INT) AS symbol_idx, s_name AS symbol, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 100 END AS scale FROM supplier)"
_NATIVE = f"""{_MSGS}, nat AS (SELECT 0 AS line_id, seq // 20 AS packet_no, seq, feed_time, CASE msg_type WHEN 'E' THEN 'C' ELSE msg_type END AS msg_type, symbol_idx, coalesce(order_id, 0) AS order_id,
  coalesce(side, 'B') AS side, coalesce(price, 0) AS price, coalesce(size, 0) AS size FROM msgs),
wd AS (SELECT *, CASE msg_type WHEN 'A' THEN 32 WHEN 'C' THEN 21 WHEN 'D' THEN 17 WHEN 'M' THEN 30 END AS width FROM nat)"""
_ITCH = f"""{_MSGS}, it AS (SELECT *, seq // 20 AS packet_no, CASE msg_type WHEN 'A' THEN CASE WHEN seq % 3 = 0 THEN 'F' ELSE 'A' END WHEN 'M' THEN 'U' WHEN 'C' THEN 'S' ELSE msg_type END AS type,
  feed_time % 86400000000000 AS ns FROM msgs),
iw AS (SELECT *, CASE type WHEN 'A' THEN 36 WHEN 'F' THEN 40 WHEN 'E' THEN 31 WHEN 'D' THEN 19 ELSE 11 END AS width FROM it)"""
_COUNTS = f"{_NATIVE}, pc AS (SELECT CAST(symbol_idx % 4 AS INT) AS line_id, packet_no, count(*) AS msg_cnt, CAST(sum(width) + 8 AS BIGINT) AS len FROM wd GROUP BY ALL)"
_COPIES = """cp AS (SELECT CAST(user_id % 4 AS INT) AS line_id, 0 AS phys_line, event_id AS first_seq, epoch_us(ts) * 1000 AS arrival_ns FROM events WHERE event_id % 97 <> 0
  UNION ALL SELECT CAST(user_id % 4 AS INT), 1, event_id, epoch_us(ts) * 1000 + (event_id % 7 - 2) * 1000 FROM events WHERE event_id % 89 <> 0)"""
_QUEUE = f"""{_REST}, qu AS (SELECT *, CAST(sum(size) OVER (PARTITION BY symbol_idx, side ORDER BY CASE side WHEN 'B' THEN -price ELSE price END, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS hi FROM rest),
q AS (SELECT *, hi - size AS lo FROM qu)"""
_LATENCY = f"""{_MSGS}, ev AS (SELECT symbol_idx AS section, msg_type = 'A' AS starts, feed_time AS t, lead(msg_type = 'A') OVER w AS next, lead(feed_time) OVER w AS t2 FROM msgs WINDOW w AS (PARTITION BY symbol_idx ORDER BY feed_time, seq)),
su AS (SELECT section, CAST(coalesce(sum(t2 - t) FILTER (starts AND NOT next), 0) AS BIGINT) AS total_ns, count(*) FILTER (starts) AS calls FROM ev GROUP BY section)"""

_LOG = f"""WITH {_ITCH} SELECT seq, CASE WHEN type IN ('A', 'F') THEN printf('[ADD] %-8s %s %6d @ %9.4f  ref=%-20d  ts=%d ns', 'S' || symbol_idx, side, size, CAST(price AS DOUBLE) / 100, order_id, ns)
      WHEN type = 'E' THEN printf('[EXEC] ref=%-20d  shares=%6d  match=%d  ts=%d ns', coalesce(order_id, 0), size, seq, ns) ELSE printf('[DEL] ref=%-20d  ts=%d ns', coalesce(order_id, 0), ns) END AS line FROM it WHERE type IN ('A', 'F', 'E', 'D')"""
_FEED = (_DELTAS.replace("FROM msgs WHERE order_id IS NOT NULL", "FROM kept WHERE order_id IN (SELECT order_id FROM kept WHERE msg_type = 'A')")
    .replace("s0 AS (", """pl AS (SELECT CAST(symbol_idx % 16 AS INT) AS line_id, msgs.*, row_number() OVER (PARTITION BY symbol_idx % 16 ORDER BY seq) + (SELECT count(*) FROM supplier WHERE s_suppkey % 16 = symbol_idx % 16) AS lseq FROM msgs),
kept AS (SELECT * FROM pl WHERE ((lseq - 1) // 20) % 143 <> 7),
s0 AS (""", 1))
_BBO = """tm AS (SELECT DISTINCT symbol_idx, seq FROM hi),
      be AS (SELECT t.symbol_idx, t.seq, max(h.price) FILTER (h.side = 'B') AS bid_price, max_by(h.agg_size, h.price) FILTER (h.side = 'B') AS bid_size, min(h.price) FILTER (h.side = 'S') AS ask_price, min_by(h.agg_size, h.price) FILTER (h.side = 'S') AS ask_size
        FROM tm t LEFT JOIN hi h ON h.symbol_idx = t.symbol_idx AND h.seq <= t.seq AND (h.next_seq IS NULL OR h.next_seq > t.seq) AND h.num_orders > 0 GROUP BY ALL),
      ch AS (SELECT *, lag((bid_price, bid_size, ask_price, ask_size), 1, (NULL, NULL, NULL, NULL)) OVER (PARTITION BY symbol_idx ORDER BY seq) AS was FROM be),
      bb AS (SELECT seq, symbol_idx, bid_price, bid_size, ask_price, ask_size FROM ch WHERE (bid_price, bid_size, ask_price, ask_size) IS DISTINCT FROM was)"""

ORACLE_SQL = {
    "packet_source": f"WITH {_NATIVE} SELECT line_id, packet_no, min(seq) AS first_seq, CAST(sum(width) + 8 AS INT) AS len, 45 AS ver, CAST(count(*) AS INT) AS msg_cnt, CAST(sum(width) + 8 AS INT) AS bytes FROM wd GROUP BY line_id, packet_no",
    "packet_roundtrip": f"""WITH {_NATIVE} SELECT packet_no, seq, feed_time, msg_type, CASE msg_type WHEN 'A' THEN symbol_idx END AS symbol_idx, order_id, CASE msg_type WHEN 'A' THEN side END AS side,
      CASE WHEN msg_type IN ('A', 'M') THEN price END AS price, CASE WHEN msg_type <> 'D' THEN size END AS size, CASE msg_type WHEN 'M' THEN false END AS priority_reset FROM nat""",
    "feed_filter": f"WITH {_ITCH} SELECT packet_no, 26401 AS dst_port, CAST(64 + sum(width + 2) AS INT) AS bytes FROM iw WHERE packet_no % 3 = 1 GROUP BY packet_no",
    "itch_frames": f"WITH {_ITCH} SELECT packet_no, 'SESSION001' AS session, min(seq) AS seqno, CAST(count(*) AS INT) AS msg_count, CAST(sum(width + 2) AS INT) AS bytes FROM iw GROUP BY packet_no",
    "itch_messages": f"WITH {_ITCH} SELECT min(seq) OVER (PARTITION BY packet_no) AS seqno, CAST(seq - min(seq) OVER (PARTITION BY packet_no) AS INT) AS idx, type, width AS bytes FROM iw QUALIFY type IN ('A', 'F', 'E', 'D')",
    "sql_block_walk": f"WITH {_ITCH} SELECT min(seq) OVER (PARTITION BY packet_no) AS seqno, CAST(seq - min(seq) OVER (PARTITION BY packet_no) AS INT) AS idx, type, CAST(width AS INT) AS bytes, 2 AS ways FROM iw",
    "sql_native_walk": f"WITH {_NATIVE} SELECT packet_no, seq, msg_type, order_id, CASE WHEN msg_type IN ('A', 'M') THEN price END AS price, CASE WHEN msg_type <> 'D' THEN size END AS size, 2 AS ways FROM nat",
    "itch_type_filter": f"WITH {_ITCH} SELECT type, count(*) AS msgs FROM it WHERE type <> 'S' GROUP BY type",
    "itch_add": f"WITH {_ITCH} SELECT seq, symbol_idx AS locate, ns AS ts_ns, order_id AS ref, side, size AS shares, 'S' || symbol_idx AS stock, CAST(CAST(CAST(price AS DECIMAL(18, 4)) / 100 AS DECIMAL(18, 4)) AS DOUBLE) AS price FROM it WHERE type IN ('A', 'F')",
    "itch_execute": f"WITH {_ITCH} SELECT seq, symbol_idx AS locate, ns AS ts_ns, coalesce(order_id, 0) AS ref, size AS executed_shares, seq AS match_num FROM it WHERE type = 'E'",
    "itch_delete": f"WITH {_ITCH} SELECT seq, symbol_idx AS locate, ns AS ts_ns, coalesce(order_id, 0) AS ref FROM it WHERE type = 'D'",
    "event_log": _LOG,
    "event_log_text": f"SELECT line, CAST(length(line) AS INT) AS n_chars FROM ({_LOG})",
    "depth_report_text": f"WITH {_LEVELS} SELECT printf('%5d %s %2d %8d %8d', symbol_idx, side, idx, price, agg_size) AS line FROM rk WHERE idx < 3",
    "capture_roundtrip": f"WITH {_NATIVE} SELECT packet_no, seq, feed_time, msg_type, order_id, CASE WHEN msg_type IN ('A', 'M') THEN price END AS price, CASE WHEN msg_type <> 'D' THEN size END AS size FROM nat WHERE packet_no % 3 = 1",
    "capture_stream": f"WITH {_ITCH} SELECT type, seq, width AS bytes FROM iw WHERE type <> 'S'",
    "msg_type_counts": f"WITH {_MSGS} SELECT msg_type, count(*) AS msgs FROM msgs GROUP BY msg_type",
    "order_lifecycle": f"WITH {_DELTAS} SELECT * FROM de",
    "order_modify": f"WITH {_DELTAS} SELECT seq, symbol_idx, side, price, d_size, d_orders FROM de WHERE seq IN (SELECT seq FROM msgs WHERE msg_type = 'M')",
    "order_replace": """SELECT CAST(o_custkey % 100 AS INT) AS symbol_idx, CASE WHEN o_custkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS order_id,
      max_by(CAST(floor(o_totalprice / 10000) AS BIGINT), (o_orderdate, o_orderkey)) AS price, max_by(o_orderkey % 90 + 10, (o_orderdate, o_orderkey)) AS size, count(*) * 1000000 + o_custkey AS last_seq FROM orders GROUP BY o_custkey""",
    "order_remaining": f"WITH {_STATES} SELECT seq, order_id, price, rem FROM st",
    "orphan_messages": f"WITH {_STATES} SELECT seq, order_id, msg_type, CASE WHEN order_id IS NULL THEN 'unknown' ELSE 'dead' END AS reason FROM msgs WHERE seq NOT IN (SELECT seq FROM st)",
    "order_lookup": f"WITH {_STATES} SELECT s.seq, s.msg_type, s.order_id, a.symbol_idx, a.side, s.was_price AS price FROM st s JOIN msgs a ON a.seq = s.order_id WHERE s.msg_type IN ('C', 'D', 'E')",
    "replace_chain_root": "SELECT o_orderkey AS id, root FROM (SELECT o_orderkey, first_value(o_orderkey) OVER w AS root FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE o_orderkey <> root",
    "security_enrich": f"WITH {_MSGS}, {_SEC} SELECT symbol_idx, seq, symbol, scale FROM msgs LEFT JOIN sec USING (symbol_idx)",
    "side_names": f"WITH {_MSGS} SELECT seq, side AS code, CASE side WHEN 'B' THEN 'BUY' ELSE 'SELL' END AS word, CASE side WHEN 'B' THEN 1 ELSE -1 END AS sign FROM msgs WHERE side IS NOT NULL",
    "level_build": f"WITH {_LEVELS} SELECT * FROM lv",
    "book_snapshot": f"WITH {_DELTAS} SELECT symbol_idx, side, price, CAST(sum(d_size) AS BIGINT) AS agg_size, CAST(sum(d_orders) AS BIGINT) AS num_orders, max(seq) AS last_seq FROM de WHERE seq <= 5000 GROUP BY ALL HAVING sum(d_orders) > 0",
    "book_snapshots": f"""WITH {_DELTAS} SELECT event_id AS at_seq, de.symbol_idx, side, price, CAST(sum(d_size) AS BIGINT) AS agg_size, CAST(sum(d_orders) AS BIGINT) AS num_orders
      FROM events JOIN de ON de.seq <= event_id WHERE event_id % 997 = 0 GROUP BY ALL HAVING sum(d_orders) > 0""",
    "keyed_table": f"""WITH {_ROWS}, sent AS (SELECT symbol_idx, side, order_id, price, size + insert_no AS size FROM r0 WHERE insert_no = 1),
      had AS (SELECT symbol_idx, side, order_id, price, size FROM r0 WHERE insert_no = 1 AND order_id % 2 = 0 UNION ALL SELECT * FROM sent WHERE order_id % 2 <> 0),
      lef AS (SELECT * FROM had WHERE order_id // 8 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
      SELECT * FROM lef UNION ALL SELECT symbol_idx, side, order_id, price, -size FROM sent WHERE order_id % 5 = 0 AND order_id NOT IN (SELECT order_id FROM lef)""",
    "total_shares": f"WITH {_REST} SELECT symbol_idx, side, CAST(sum(size) AS BIGINT) AS shares FROM rest GROUP BY ALL",
    "level_count": f"WITH {_LEVELS}, {_SEC} SELECT symbol_idx, count(price) AS levels, count(price) = 0 AS empty FROM (SELECT symbol_idx FROM sec UNION ALL SELECT -symbol_idx - 1 FROM sec) LEFT JOIN lv USING (symbol_idx) GROUP BY symbol_idx",
    "best_bid_offer": f"""WITH {_LEVELS} SELECT symbol_idx, max(price) FILTER (side = 'B') AS bid_price, max_by(agg_size, price) FILTER (side = 'B') AS bid_size,
      min(price) FILTER (side = 'S') AS ask_price, min_by(agg_size, price) FILTER (side = 'S') AS ask_size FROM lv GROUP BY symbol_idx""",
    "price_band_depth": f"WITH {_REST} SELECT symbol_idx, side, ticks // 1024 AS page, CAST(sum(size) AS BIGINT) AS agg_size, count(*) AS num_orders, count(DISTINCT ticks % 1024) AS slots FROM rest GROUP BY ALL",
    "price_bounds": f"WITH {_REST} SELECT order_id, ticks, CASE WHEN ticks < 20000 OR ticks > 20000 + 1024 * 40 - 1 THEN 'price_bounds' END AS reason FROM rest",
    "level_find": f"""WITH {_LEVELS}, w AS (SELECT o_orderkey, CAST(o_custkey % 100 AS INT) AS symbol_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, CAST(floor(o_totalprice / 4000) AS BIGINT) AS price FROM orders)
      SELECT symbol_idx, side, price, o_orderkey, idx, agg_size FROM w LEFT JOIN rk USING (symbol_idx, side, price)""",
    "level_at": f"WITH {_LEVELS} SELECT * FROM rk WHERE idx = 2",
    "next_level": f"WITH {_LEVELS} SELECT a.symbol_idx, a.side, a.price, b.price AS next_price, abs(b.price - a.price) AS gap FROM rk a LEFT JOIN rk b ON b.symbol_idx = a.symbol_idx AND b.side = a.side AND b.idx = a.idx + 1",
    "ladder_sorted": f"WITH {_LEVELS} SELECT symbol_idx, side, idx, price FROM rk",
    "top3_depth": f"WITH {_LEVELS} SELECT symbol_idx, side, idx, price, agg_size, num_orders, printf('%2d %8d %8d', idx, price, agg_size) AS line FROM rk WHERE idx < 3",
    "volume_vector": f"WITH {_LEVELS} SELECT symbol_idx, side, string_agg(CAST(agg_size AS VARCHAR), ',' ORDER BY idx) AS volumes FROM rk GROUP BY symbol_idx, side",
    "level_history": f"WITH {_HISTORY} SELECT seq, symbol_idx, side, price, agg_size, num_orders FROM hi",
    "level_stamps": f"""WITH {_HISTORY}, em AS (SELECT a.seq, a.symbol_idx, a.side, a.price, a.feed_time, (SELECT max(b.seq) FROM hi b WHERE b.symbol_idx = a.symbol_idx AND b.side = a.side AND b.price = a.price AND b.seq < a.seq AND b.num_orders = 0) AS emptied FROM hi a WHERE a.num_orders > 0),
      cr AS (SELECT e.seq, e.symbol_idx, e.side, e.price, e.feed_time, min(h.seq) AS created_seq FROM em e JOIN hi h ON h.symbol_idx = e.symbol_idx AND h.side = e.side AND h.price = e.price AND h.seq <= e.seq AND h.seq > coalesce(e.emptied, -1) GROUP BY ALL)
      SELECT c.seq, c.symbol_idx, c.side, c.price, created_seq, m.feed_time AS created_feed_time, c.feed_time AS last_feed_time FROM cr c JOIN msgs m ON m.seq = created_seq""",
    "queue_position": f"""WITH {_REST} SELECT symbol_idx, side, price, order_id, size, CAST(row_number() OVER w AS INT) AS position, CAST(coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS size_ahead
      FROM rest WINDOW w AS (PARTITION BY symbol_idx, side, price ORDER BY order_id)""",
    "insert_if_absent": f"WITH {_ROWS} SELECT order_id, symbol_idx, side, price, size + CASE order_id % 2 WHEN 0 THEN 0 ELSE 1 END AS size, order_id % 2 <> 0 AS inserted FROM r0 WHERE insert_no = 1",
    "erase_keys": f"WITH {_REST} SELECT order_id, symbol_idx, side, price, size FROM rest WHERE order_id // 8 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "level_payload": f"WITH {_MSGS} SELECT seq, (((feed_time & 281474976710655)::HUGEINT * 65536 + (symbol_idx & 65535) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS packed, CAST(symbol_idx & 65535 AS BIGINT) AS n, feed_time & 281474976710655 AS ft FROM msgs",
    "price_scale": f"WITH {_MSGS}, {_SEC} SELECT seq, CAST(CAST(CAST(price AS DECIMAL(18, 4)) / scale AS DECIMAL(18, 4)) AS DOUBLE) AS display, CAST(CAST(CAST(price AS DECIMAL(18, 4)) / 10000 AS DECIMAL(18, 4)) AS DOUBLE) AS wire FROM msgs JOIN sec USING (symbol_idx) WHERE price IS NOT NULL",
    "feed_timestamp": f"WITH {_MSGS} SELECT seq, feed_time // 1000 AS us, feed_time % 86400000000000 AS ns FROM msgs",
    "sweep_single": f"WITH {_QUEUE} SELECT symbol_idx, side, price, order_id, least(size, 500 - lo) AS fill_size, size - least(size, 500 - lo) AS resting_left FROM q WHERE lo < 500",
    "sweep_many": f"""WITH {_QUEUE}, ag AS (SELECT CAST(o_custkey % 100 AS INT) AS symbol_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side, o_orderkey AS seq, CAST(floor(o_totalprice / 10000) + 1 AS BIGINT) AS quantity FROM orders),
      ac AS (SELECT *, CAST(sum(quantity) OVER (PARTITION BY symbol_idx, side ORDER BY seq) AS BIGINT) AS a_hi FROM ag)
      SELECT a.seq AS aggressor_seq, a.symbol_idx, a.side, q.price, q.order_id, least(q.hi, a_hi) - greatest(q.lo, a_hi - quantity) AS fill_size, q.hi - least(q.hi, a_hi) AS resting_left
      FROM ac a JOIN q ON q.symbol_idx = a.symbol_idx AND q.side = a.side AND greatest(q.lo, a_hi - quantity) < least(q.hi, a_hi)""",
    "bbo_timeline": f"""WITH {_HISTORY}, tm AS (SELECT DISTINCT symbol_idx, seq FROM hi),
      be AS (SELECT t.symbol_idx, t.seq, max(h.price) FILTER (h.side = 'B') AS bid_price, max_by(h.agg_size, h.price) FILTER (h.side = 'B') AS bid_size, min(h.price) FILTER (h.side = 'S') AS ask_price, min_by(h.agg_size, h.price) FILTER (h.side = 'S') AS ask_size
        FROM tm t LEFT JOIN hi h ON h.symbol_idx = t.symbol_idx AND h.seq <= t.seq AND (h.next_seq IS NULL OR h.next_seq > t.seq) AND h.num_orders > 0 GROUP BY ALL),
      ch AS (SELECT *, lag((bid_price, bid_size, ask_price, ask_size), 1, (NULL, NULL, NULL, NULL)) OVER (PARTITION BY symbol_idx ORDER BY seq) AS was FROM be)
      SELECT seq, symbol_idx, bid_price, bid_size, ask_price, ask_size FROM ch WHERE (bid_price, bid_size, ask_price, ask_size) IS DISTINCT FROM was""",
    "bbo_by_nodes": f"WITH {_HISTORY}, {_BBO} SELECT * FROM bb",
    "queue_timeline": f"""WITH {_STATES}, li AS (SELECT *, lead(seq) OVER (PARTITION BY order_id ORDER BY seq) AS next_seq,
      max(CASE WHEN msg_type = 'A' OR price <> was_price THEN seq END) OVER (PARTITION BY order_id ORDER BY seq) AS priority FROM st)
      SELECT q.seq, q.order_id, q.symbol_idx, q.side, q.price, q.rem AS size, count(o.seq) + 1 AS position, CAST(coalesce(sum(o.rem), 0) AS BIGINT) AS size_ahead
      FROM li q LEFT JOIN li o ON o.symbol_idx = q.symbol_idx AND o.side = q.side AND o.price = q.price AND o.priority < q.priority AND o.rem > 0 AND o.seq <= q.seq AND (o.next_seq IS NULL OR o.next_seq > q.seq)
      WHERE q.rem > 0 GROUP BY ALL""",
    "seq_numbering": f"WITH {_COUNTS} SELECT line_id, packet_no, msg_cnt, CAST(1000 + coalesce(sum(msg_cnt) OVER (PARTITION BY line_id ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_seq FROM pc",
    "line_traffic": f"WITH {_COUNTS} SELECT line_id, count(*) AS packets, CAST(sum(msg_cnt) AS BIGINT) AS messages, CAST(sum(len) AS BIGINT) AS bytes FROM pc GROUP BY line_id",
    "seq_gaps": """SELECT 0 AS line_id, event_id AS first_seq, expected, CASE WHEN event_id > expected THEN 'gap' ELSE 'overlap' END AS kind FROM (SELECT event_id, lag(event_id + 1) OVER (ORDER BY event_id) AS expected FROM events WHERE event_id % 97 <> 0) WHERE expected <> event_id""",
    "line_merge": f"WITH {_COPIES} SELECT line_id, phys_line, count(*) AS packets, CAST(sum(first_seq) AS BIGINT) AS seq_sum FROM cp GROUP BY ALL",
    "line_arbitration": f"WITH {_COPIES} SELECT line_id, first_seq, phys_line, arrival_ns FROM cp QUALIFY row_number() OVER (PARTITION BY line_id, first_seq ORDER BY arrival_ns, phys_line) = 1",
    "latency_summary": f"WITH {_LATENCY} SELECT *, total_ns / calls AS mean_ns FROM su WHERE calls > 0",
    "latency_ticks": f"WITH {_LATENCY} SELECT section, total_ns / 3.7e9::DOUBLE AS total_s, calls, total_ns / 3.7e9::DOUBLE / calls AS mean_s FROM su WHERE calls > 0",
    "executed_by_order": f"WITH {_MSGS} SELECT symbol_idx, order_id, CAST(sum(size) AS BIGINT) AS shares, count(*) AS executions FROM msgs WHERE msg_type = 'E' GROUP BY symbol_idx, order_id",
    "executed_volume": f"WITH {_MSGS} SELECT symbol_idx, CAST(sum(size) AS BIGINT) AS shares, count(*) AS executions FROM msgs WHERE msg_type = 'E' GROUP BY symbol_idx",
    "stream_decode": f"WITH {_ITCH} SELECT type, seq, width AS bytes FROM iw WHERE type <> 'S'",
    "stream_book": f"WITH {_DELTAS} SELECT * FROM de",
    "stream_native_book": f"""WITH {_DELTAS}, {_SEC} SELECT seq, symbol_idx, side, price, d_size, d_orders, symbol, scale, NULL::VARCHAR AS reason FROM de LEFT JOIN sec USING (symbol_idx)
      UNION ALL SELECT seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN order_id IS NULL THEN 'unknown' ELSE 'dead' END FROM msgs WHERE seq NOT IN (SELECT seq FROM st)""",
    "stream_feed": f"""WITH {_FEED}, {_SEC} SELECT 'level' AS kind, line_id, lseq AS seq, de.feed_time, de.symbol_idx, de.side, de.price, d_size, d_orders, CASE WHEN scale IS NOT NULL THEN 'S' || de.symbol_idx END AS symbol, scale, NULL::VARCHAR AS reason FROM de JOIN kept USING (seq) LEFT JOIN sec ON sec.symbol_idx = de.symbol_idx
      UNION ALL SELECT 'reject', line_id, lseq, feed_time, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN order_id IN (SELECT order_id FROM kept WHERE msg_type = 'A') THEN 'dead' ELSE 'unknown' END FROM kept WHERE seq NOT IN (SELECT seq FROM st)""",
    "stream_bbo": f"WITH {_HISTORY.replace(_DELTAS, _FEED)}, {_BBO} SELECT line_id, lseq AS seq, bb.symbol_idx, bid_price, bid_size, ask_price, ask_size FROM bb JOIN kept USING (seq)",
    "stream_arbitration": f"WITH {_COPIES} SELECT DISTINCT line_id, first_seq FROM cp",
}

"""URL filters: longest matching rule, else trust and distrust propagated over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rank is counted in whole units, so that sums are exact in any order; 85 times MASS fits a long. DAMPING in percent.
MASS, DAMPING = 10**17, 85
#: Rounds end when no host's rank has grown by more than one part of TOLERANCE; that is looked at every LEAP rounds.
TOLERANCE, LEAP = 1_000, 4
#: Second labels below which a country registers names: co.uk and the like are no owner's domain.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")
REGISTRY = rf"^({'|'.join(REGISTRIES)})\.[a-z][a-z]$"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """``a.b.c`` -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst), src <> dst: links in ``html`` to other hosts, and each host with its parent domain, both ways.

    A parent domain has two labels at least and is no country's registry, so sites of one owner pass rank on and sites of
    one country do not.
    """
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")).select("src", ascii_lower(F.col("dst")).alias("dst"))
    up = hosts.select(F.filter(suffixes(F.col("host")), lambda h: (F.instr(h, ".") > 0) & ~h.rlike(REGISTRY)).alias("h"))
    up = up.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("h"))), lambda i: F.struct(F.get("h", i - 2).alias("src"), F.get("h", i - 1).alias("dst")))).alias("e")).select("e.*")
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return linked.unionByName(both).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, tolerance: int = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, weight) along ``edges`` (src, dst).

    Rounds begin with the seeds' own shares and only add to ranks, until no round adds more than 1 / tolerance of its own
    rank to any host. A host that is reached for the first time has grown by all of its rank, so a host at any distance
    is reached, however small its part of all rank, as long as one whole unit gets there. LEAP rounds make one job.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 1
    start = scratch.write(seeds.select("host", F.expr(f"(cast(weight as decimal(19, 0)) * {MASS}BD) div {total}BD").alias("mass")), "start")
    kept = start.select("host", F.expr(f"mass * {100 - DAMPING}BD div 100BD").alias("rank"))
    out = scratch.write(edges.join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src"), "outs")
    rank = scratch.write(kept.withColumn("before", F.lit(0).cast("long")), "rank")
    none = F.lit(0).cast("long")
    while not rank.where(F.expr(f"rank - before > rank div {tolerance}")).isEmpty():
        held, now = rank, rank.select("host", "rank")
        for _ in range(LEAP):
            last = now
            sent = out.join(last, out.src == last.host).select(F.col("dst").alias("host"), F.expr(f"(rank * {DAMPING} div 100) div out").alias("rank"))
            parts = sent.unionByName(kept)
            now = parts.groupBy("host").agg(F.sum("rank").alias("rank"))
        parts = parts.withColumn("before", none).unionByName(last.select("host", none.alias("rank"), F.col("rank").alias("before")))
        last = parts.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"))
        rank = scratch.write(last, "rank")
        scratch.drop(held)
    return rank.select("host", "rank")


def judge_urls(pages: DataFrame, scratch: Scratch, rules: Sequence[tuple[str, str, str]] = RULES, tolerance: int = TOLERANCE) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    The longest rule that fits gives the verdict. Where none fits, the host's trust (rank from the hosts of allowed
    pages, along links) is held against its distrust (rank from the hosts of blocked pages, against links): more
    distrust than trust blocks. Hosts that neither reaches are allowed.

    Null url or no ``://``: host and path empty, no rule, allowed. Null html: no links. Repeated rows are judged alike,
    each in a row of its own. An empty table gives no rows. Other columns are not read. A host that holds most pages is
    one row of the graph; pages meet their host's rules and rank in joins whose hot keys Spark can split.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    read = scratch.write(pages.select("page_id", host.alias("host"), path.alias("path")), "pages")
    hosts = read.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    given = spark.createDataFrame([(h, p, v, h + p) for h, p, v in rules], "suffix string, prefix string, verdict string, rule string")
    given = given.groupBy("suffix").agg(F.collect_list(F.struct(F.length("rule").alias("long"), "rule", "prefix", "verdict")).alias("rules"))
    fit = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("suffix")).join(given, "suffix").groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])))
    ruled = scratch.write(read.join(fit, "host", "left").select("page_id", "host", "path", best.alias("best")), "ruled")

    links = pages.select(host.alias("host"), "html")
    edges = scratch.write(host_edges(links, hosts.where("host <> ''")), "edges")
    seeds = lambda v: ruled.where((F.col("best.verdict") == v) & (F.col("host") != "")).groupBy("host").agg(F.count(F.lit(1)).alias("weight"))
    trust = propagate(edges, seeds("allow"), scratch, tolerance).withColumnRenamed("rank", "trust")
    distrust = propagate(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds("block"), scratch, tolerance).withColumnRenamed("rank", "distrust")
    score = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    out = ruled.join(score, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn("distrust", F.coalesce("distrust", F.lit(0)))
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), method).alias("verdict"), "trust", "distrust")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "op7"))


def _rank_sql(name: str, src: str, dst: str, verdict: str) -> str:
    picked = f"FROM ruled WHERE host <> '' AND best.verdict = '{verdict}'"
    grown = f"EXISTS (SELECT 1 FROM {name}_r WHERE rank - before > rank // {TOLERANCE}) OR EXISTS (SELECT 1 FROM {name}_r WHERE round % {LEAP} <> 0)"
    return f"""{name}_o AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS outs FROM edges),
{name}_s AS MATERIALIZED (SELECT host, CAST(CAST(CAST({MASS} AS HUGEINT) * count(*) // (SELECT count(*) {picked}) AS HUGEINT) * {100 - DAMPING} // 100 AS BIGINT) AS mass {picked} GROUP BY host),
{name}_r AS (SELECT 0 AS round, host, mass AS rank, CAST(0 AS BIGINT) AS before FROM {name}_s
  UNION ALL SELECT round, host, CAST(sum(rank) AS BIGINT), CAST(sum(before) AS BIGINT) FROM (
    SELECT r.round + 1 AS round, o.dst AS host, (r.rank * {DAMPING} // 100) // o.outs AS rank, CAST(0 AS BIGINT) AS before FROM {name}_r r JOIN {name}_o o ON o.src = r.host
    UNION ALL SELECT (SELECT max(round) FROM {name}_r) + 1, host, mass, 0 FROM {name}_s
    UNION ALL SELECT round + 1, host, 0, rank FROM {name}_r) WHERE {grown} GROUP BY round, host),
{name} AS MATERIALIZED (SELECT host, rank FROM {name}_r WHERE round = (SELECT max(round) FROM {name}_r))"""


_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"
OP7_SQL = f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{x}', '{v}')" for h, x, v in RULES)}) r(suffix, prefix, verdict)),
ruled AS MATERIALIZED (SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path,
   max({{'long': length(r.suffix || r.prefix), 'rule': r.suffix || r.prefix, 'verdict': r.verdict}}) FILTER (r.suffix IS NOT NULL) AS best
   FROM p LEFT JOIN rules r ON (p.host = r.suffix OR ends_with(p.host, '.' || r.suffix)) AND starts_with(p.path, r.prefix) GROUP BY p.page_id),
hs AS (SELECT DISTINCT host FROM p WHERE host <> ''),
sfx AS (SELECT [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FOR i IN range(1, len(string_split(host, '.')) + 1)] AS h FROM hs),
ups AS (SELECT unnest([{{'src': h[i], 'dst': h[i + 1]}} FOR i IN range(1, len(h)) IF contains(h[i + 1], '.') AND NOT regexp_matches(h[i], '{REGISTRY}') AND NOT regexp_matches(h[i + 1], '{REGISTRY}')], recursive := true) FROM sfx),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM ups UNION ALL SELECT dst, src FROM ups
  UNION ALL SELECT host, {_LOWER.format("unnest(regexp_extract_all(html, " + chr(39) + LINK.replace(chr(39), chr(39) * 2) + chr(39) + ", 1))")} FROM p) WHERE src <> '' AND dst <> '' AND src <> dst),
{_rank_sql("a", "src", "dst", "allow")},
{_rank_sql("b", "dst", "src", "block")}
SELECT r.page_id, r.host, r.path, r.best.rule AS rule,
  coalesce(r.best.verdict, CASE WHEN coalesce(b.rank, 0) > coalesce(a.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(a.rank, 0) AS trust, coalesce(b.rank, 0) AS distrust
FROM ruled r LEFT JOIN a ON a.host = r.host LEFT JOIN b ON b.host = r.host
"""

"""Fixed schemas of packets, order messages, resting orders and price levels."""

from __future__ import annotations

ORDER_MSGS = "line_id int, seq long, feed_time long, msg_type string, symbol_idx int, order_id long, new_order_id long, side string, price long, size long, priority_reset boolean, match_num long"
SECURITIES = "symbol_idx int, symbol string, scale int, seq long, feed_time long"
PACKETS = "line_id int, phys_line int, arrival_ns long, dst_ip long, dst_port int, payload binary"
DELTAS = ("seq", "feed_time", "symbol_idx", "side", "price", "d_size", "d_orders")
LEVEL = ("symbol_idx", "side", "price")

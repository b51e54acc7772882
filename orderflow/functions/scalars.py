"""Scalar columns: big-endian integers, fixed-point prices, fixed-width text, packed level payloads, ladder pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_TICKS = 1024


def big_endian(data: Column, offset: int, width: int) -> Column:
    """Unsigned integer at ``offset`` (from 0); eight bytes come as DECIMAL(20,0), fewer as BIGINT."""
    number = F.conv(F.hex(F.substring(data, offset + 1, width)), 16, 10)
    return number.cast("decimal(20,0)" if width == 8 else "long")


def big_endian_hex(value: Column, width: int) -> Column:
    """The opposite: ``width`` bytes as hex digits. A number that they cannot hold is an error, never cut."""
    value = value.cast("long")
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return digits if width == 8 else F.when((value >= 0) & (value < 1 << 8 * width), digits).when(value.isNotNull(), F.raise_error(F.format_string(f"%d does not fit {width} bytes", value)))


def fixed_text(data: Column, offset: int, width: int) -> Column:
    """Text padded with spaces or NULs."""
    return F.rtrim(F.translate(F.substring(data, offset + 1, width).cast("string"), "\0", ""))


def wire_price(ticks: Column) -> Column:
    """Price in ten-thousandths as DECIMAL(18,4)."""
    return (ticks.cast("decimal(18,4)") / 10000).cast("decimal(18,4)")


def display_price(ticks: Column, scale: Column) -> Column:
    """Price in units of ``1 / scale`` as DECIMAL(18,4)."""
    return (ticks.cast("decimal(18,4)") / scale).cast("decimal(18,4)")


def pack_level(orders: Column, feed_time: Column) -> Column:
    """16 bits of order count below 48 bits of feed time; both are masked."""
    return F.shiftleft(feed_time.bitwiseAND(F.lit(0xFFFFFFFFFFFF)), 16).bitwiseOR(orders.cast("long").bitwiseAND(F.lit(0xFFFF)))


def unpack_level(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(packed, 16)


def page(price: Column, min_tick: int) -> Column:
    return F.shiftright(price - min_tick, 10)


def slot(price: Column, min_tick: int) -> Column:
    return (price - min_tick).bitwiseAND(F.lit(PAGE_TICKS - 1))


def in_bounds(price: Column, min_tick: int, max_tick: int) -> Column:
    """Whether the ladder has a slot: bounds are those of whole pages."""
    pages = (max_tick - min_tick) // PAGE_TICKS + 1
    return price.between(min_tick, min_tick + PAGE_TICKS * pages - 1)


def past_midnight(trade_date: Column, ns: Column) -> Column:
    """Timestamp (microseconds) of a time in ns past midnight."""
    return F.timestamp_micros(F.unix_micros(trade_date.cast("timestamp")) + F.floor(ns / 1000).cast("long"))


def sign(side: Column) -> Column:
    """+1 for buys (B), -1 for sells (S)."""
    return F.when(side == "B", 1).when(side == "S", -1)


def side_code(side: Column) -> Column:
    """B or S from B, S, BUY, SELL, BID, ASK in any case, with spaces around or not; null for others."""
    word = F.upper(F.trim(side))
    return F.when(word.isin("B", "BUY", "BID"), "B").when(word.isin("S", "SELL", "ASK"), "S")


def side_word(side: Column) -> Column:
    """BUY or SELL from the same."""
    return F.when(side_code(side) == "B", "BUY").when(side_code(side) == "S", "SELL")

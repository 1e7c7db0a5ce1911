"""Column expressions over the integer microsecond clock, prices and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tobflow.schema import DAY, HOUR, SECOND


def day_start(clock: Column) -> Column:
    """UTC midnight at or before a time; floor, so that times before the epoch work too."""
    return (F.floor(clock / DAY) * DAY).cast("long")


def floor_to(t: Column, step: int) -> Column:
    return t - F.pmod(t, F.lit(step))


def bucket_id(clock: Column, day0: Column, freq_us: int) -> Column:
    """Left-closed bucket of a time; negative before midnight."""
    return F.floor((clock - day0) / freq_us).cast("long")


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def depth(bid_amount: Column, ask_amount: Column) -> Column:
    return (bid_amount + ask_amount) / 2


def in_ticks(value: Column, tick) -> Column:
    """value in ticks, to nine decimals, half to even."""
    return F.bround(value / tick, 9)


def signed_size(side: Column, amount: Column) -> Column:
    return F.when(side == "buy", amount).when(side == "sell", -amount).otherwise(F.lit(0.0))


def overlaps_funding(start: Column, end: Column, minutes: int = 2, period: int = 8 * HOUR) -> Column:
    """Whether [start, end) meets the minutes around a funding time; both borders are open."""
    margin = minutes * 60 * SECOND
    s = F.pmod(start, F.lit(period))
    e = s + (end - start)
    return (s < margin) | (e > period - margin)


def newey_west_lags(n: Column) -> Column:
    return F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def on_grid(price: Column, tick) -> Column:
    x = price / tick
    return F.abs(x - F.rint(x)) < 1e-6


def four_hour_block(t: Column) -> Column:
    return F.floor(F.pmod(F.floor(t / HOUR), F.lit(24)) / 4).cast("int")


def is_weekend(t: Column) -> Column:
    return (F.weekday(F.timestamp_micros(t)) >= 5).cast("int")


def iso_day(day0: Column) -> Column:
    return F.date_format(F.timestamp_micros(day0), "yyyy-MM-dd")


def passed(condition: Column) -> Column:
    return F.when(condition, F.lit("PASS")).otherwise(F.lit("FAIL"))

"""Exact percentiles from counted values: a buffer never holds more than a group's distinct values, which are sorted and may spill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n: how often each known value occurs."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, value, n, ...) with _from and _all: how many of the group come before a row's values, and how many there are."""
    group = Window.partitionBy(*keys)
    before = group.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({"_from": F.coalesce(F.sum("n").over(before), F.lit(0)), "_all": F.sum("n").over(group)})


def picked(p: float, where: Column | None = None) -> Column:
    """An aggregate over ranked rows (those of a condition): the p-th quantile, interpolated between ranks."""
    rank = p * (F.col("_all") - 1)
    value = F.col("value") if where is None else F.when(where, F.col("value"))
    low, high = (F.max(F.when((r >= F.col("_from")) & (r < F.col("_from") + F.col("n")), value)) for r in (F.floor(rank), F.ceil(rank)))
    part = rank - F.floor(rank)
    return low + F.max(part if where is None else F.when(where, part)) * (high - low)


def percentiles(counts: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """keys and one column per wanted percentile, from keys, value and n. Groups without values have no row."""
    return ranked(counts, keys).groupBy(*keys).agg(*[picked(p).alias(name) for name, p in wanted.items()])

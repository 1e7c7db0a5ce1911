"""Sign strategy with costs, worked out day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.operators.percentiles import picked, ranked

KEYS = ("symbol", "model", "latency_ms")


def positions(predicted: DataFrame, freq_us: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """predicted with p, prev (the position coming in, 0 after a gap) and goes_on (whether the next decision follows at once).

    Windows are of one day. A decision next to midnight is also sent to the day beside it, where it only shows its
    neighbour what comes before or behind, so a session that runs over midnight stays one.
    """
    day = lambda shift: S.day_start(F.col("t") + shift)
    beside = [F.when(day(k) != day(0), F.struct(day(k).alias("_day"), F.lit(False).alias("_own"))) for k in (freq_us, -freq_us)]
    places = F.filter(F.array(F.struct(day(0).alias("_day"), F.lit(True).alias("_own")), *beside), lambda x: x.isNotNull())
    rows = predicted.withColumn("p", F.signum("yhat")).select("*", F.explode(places).alias("_place")).select("*", "_place.*").drop("_place")
    order = Window.partitionBy(*keys, "_day").orderBy("t")
    joins = F.coalesce(F.col("t") - F.lag("t").over(order) == freq_us, F.lit(False))
    goes_on = F.coalesce(F.lead("t").over(order) - F.col("t") == freq_us, F.lit(False))
    rows = rows.withColumns({"prev": F.when(joins, F.lag("p").over(order)).otherwise(0.0), "goes_on": goes_on})
    return rows.where("_own").drop("_day", "_own")


def sign_strategy(predicted: DataFrame, freq_us: int, fee_bps: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Economics of holding sign(yhat) for one bucket at each decision time.

    Positions run over decision times freq_us apart and are closed at gaps. A unit of turnover costs the fee and
    the half spread of its row; closing pays that of the last row. Returns keys, gross_bps, turnover, net_bps,
    break_even_bps (null without turnover), gross_bps_per_bucket, buckets, days and median_half_spread_bps. Rows are
    read once: sums by day and half spread give both the totals and the median.
    """
    gross = F.col("p") * F.col("y") * F.col("tick") / F.col("mid_entry") * 1e4
    close = F.when(F.col("goes_on"), 0.0).otherwise(F.abs("p"))
    rows = positions(predicted, freq_us, keys).withColumns({"gross": gross, "turn": F.abs(F.col("p") - F.col("prev")) + close})
    sums = {"n": F.count("*"), "gross": F.sum("gross"), "turn": F.sum("turn")}
    parts = rows.groupBy(*keys, "day", F.col("half_spread_bps").alias("value")).agg(*[v.alias(k) for k, v in sums.items()])
    cost = F.col("turn") * (F.lit(fee_bps) + F.col("value"))
    out = ranked(parts, list(keys)).groupBy(*keys).agg(
        F.sum("gross").alias("gross_bps"),
        F.sum("turn").alias("turnover"),
        (F.sum("gross") - F.sum(cost)).alias("net_bps"),
        (F.sum("gross") / F.sum("n")).alias("gross_bps_per_bucket"),
        F.sum("n").alias("buckets"),
        F.countDistinct("day").alias("days"),
        picked(0.5).alias("median_half_spread_bps"),
    )
    return out.withColumn("break_even_bps", F.try_divide(F.col("gross_bps"), F.col("turnover")))

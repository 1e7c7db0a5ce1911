"""Day grids: bucketing with gap fill, coarsening, trade imbalance and interval exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.operators.events import event_flow
from tobflow.schema import DAY, STREAM


def day_grid(days: DataFrame, freq_us: int) -> DataFrame:
    """One row (symbol, day0, k) per bucket of each (symbol, day0)."""
    buckets = F.sequence(F.lit(0).cast("long"), F.lit(DAY // freq_us - 1).cast("long"))
    return days.select(*STREAM).distinct().select(*STREAM, F.explode(buckets).alias("k"))


def bucket_flow(book: DataFrame, freq_us: int, clock: str = "timestamp", *, early: bool = False) -> DataFrame:
    """symbol, day0, k, flow, n_events and the last known mid, depth and spread of each non-empty bucket of the day.

    With ``early``, bucket -1 is all that comes before the day, and its state that of the last row.
    """
    k = F.greatest(S.bucket_id(F.col(clock), F.col("day0"), freq_us), F.lit(-1))
    state = {
        "mid": S.mid(F.col("bid_price"), F.col("ask_price")),
        "depth": S.depth(F.col("bid_amount"), F.col("ask_amount")),
        "spread": F.col("ask_price") - F.col("bid_price"),
    }
    rows = event_flow(book).select(*STREAM, "seq", "flow", k.alias("k"), *[v.alias(c) for c, v in state.items()])
    inside = rows.where((F.col("k") >= (-1 if early else 0)) & (F.col("k") < DAY // freq_us))
    last = {c: F.expr(f"max_by({c}, seq) FILTER (WHERE {c} IS NOT NULL)") for c in state}
    if early:
        last = {c: F.when(F.col("k") < 0, F.max_by(c, "seq")).otherwise(v) for c, v in last.items()}
    return inside.groupBy(*STREAM, "k").agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("flow"), F.count("*").alias("n_events"), *[v.alias(c) for c, v in last.items()])


def bucketize(book: DataFrame, freq_us: int, tick, clock: str = "timestamp") -> DataFrame:
    """The dense day grid of each stream: symbol, day0, t, flow, dmid_ticks, depth, spread_ticks, n_events, mid.

    book has symbol, day0 and seq (see with_days) and is read once. State is carried forward over empty buckets, and
    into the day from the last row before it, which is bucket -1. Only buckets with rows are sorted; each then stands
    for the empty ones up to the next. tick is a number, or a table of symbol, day0 and tick.
    """
    last = DAY // freq_us - 1
    order = Window.partitionBy(*STREAM).orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bucket_flow(book, freq_us, clock, early=True)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("mid", "depth", "spread")})
    begin = F.when(F.lag("k").over(order).isNull(), F.least(F.col("k"), F.lit(0))).otherwise(F.col("k"))
    end = F.coalesce(F.lead("k").over(order) - 1, F.lit(last).cast("long"))
    rows = rows.withColumns({"was": F.lag("mid").over(order), "begin": F.greatest(begin, F.lit(0)), "end": end})
    grid = rows.where(F.col("end") >= 0).select("*", F.explode(F.sequence("begin", "end")).alias("at"))
    if isinstance(tick, DataFrame):
        grid, tick = grid.join(F.broadcast(tick.select(*STREAM, "tick")), STREAM), F.col("tick")
    own, known = F.col("at") == F.col("k"), F.col("at") >= F.col("k")
    moved = F.when(own, F.col("mid") - F.col("was")).when(known, F.col("mid") - F.col("mid"))
    return grid.select(
        *STREAM,
        (F.col("day0") + F.col("at") * freq_us).alias("t"),
        F.when(own, F.col("flow")).otherwise(0.0).alias("flow"),
        S.in_ticks(moved, tick).alias("dmid_ticks"),
        F.when(known, F.col("depth")).alias("depth"),
        S.in_ticks(F.when(known, F.col("spread")), tick).alias("spread_ticks"),
        F.when(own, F.col("n_events")).otherwise(F.lit(0)).alias("n_events"),
        F.when(known, F.col("mid")).alias("mid"),
    )


def resample(buckets: DataFrame, freq_us: int) -> DataFrame:
    """Coarser buckets: sums of flow, dmid_ticks, n_events and ti (missing counts as 0), the last known state."""
    sums = [c for c in ("flow", "dmid_ticks", "n_events", "ti") if c in buckets.columns]
    last = [c for c in ("depth", "spread_ticks", "mid") if c in buckets.columns]
    total = {c: F.coalesce(F.sum(c), F.lit(0) if c == "n_events" else F.lit(0.0)).alias(c) for c in sums}
    if "dmid_ticks" in total:
        total["dmid_ticks"] = F.bround(F.coalesce(F.sum("dmid_ticks"), F.lit(0.0)), 9).alias("dmid_ticks")
    states = [F.expr(f"max_by({c}, t) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in last]
    out = buckets.groupBy(*STREAM, S.floor_to(F.col("t"), freq_us).alias("t")).agg(*total.values(), *states)
    return out.select(*[c for c in buckets.columns if c in out.columns])


def signed_sums(trades: DataFrame, freq_us: int, clock: str = "timestamp") -> DataFrame:
    """symbol, day0, k and ti: signed traded size of the day's buckets that have trades; unknown sides count nothing."""
    k = S.bucket_id(F.col(clock), F.col("day0"), freq_us)
    signed = trades.select(*STREAM, k.alias("k"), S.signed_size(F.col("side"), F.col("amount")).alias("x"))
    inside = signed.where((F.col("k") >= 0) & (F.col("k") < DAY // freq_us))
    return inside.groupBy(*STREAM, "k").agg(F.sum("x").alias("ti"))


def trade_imbalance(trades: DataFrame, freq_us: int, clock: str = "timestamp", days: DataFrame | None = None) -> DataFrame:
    """symbol, day0, t and ti: signed traded size of every bucket of the days; unknown sides and other days' trades count nothing."""
    grid = day_grid(trades if days is None else days, freq_us).join(signed_sums(trades, freq_us, clock), [*STREAM, "k"], "left")
    return grid.select(*STREAM, (F.col("day0") + F.col("k") * freq_us).alias("t"), F.coalesce("ti", F.lit(0.0)).alias("ti"))


def with_imbalance(buckets: DataFrame, trades: DataFrame, freq_us: int, clock: str = "timestamp") -> DataFrame:
    """A dense grid with ti, the trade imbalance of each bucket: 0 where there are no trades."""
    sums = signed_sums(trades, freq_us, clock).select(*STREAM, (F.col("day0") + F.col("k") * freq_us).alias("t"), "ti")
    return buckets.join(sums, [*STREAM, "t"], "left").withColumn("ti", F.coalesce("ti", F.lit(0.0)))


def drop_funding(buckets: DataFrame, freq_us: int, minutes: int = 2) -> DataFrame:
    """Without the buckets that meet the minutes around a funding time."""
    return buckets.where(~S.overlaps_funding(F.col("t"), F.col("t") + freq_us, minutes))

"""Data-quality reports per stream, and tick inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.operators.percentiles import counted, picked, ranked
from tobflow.schema import BOOK_COLUMNS, HOUR, SECOND

#: Tick candidates are 5, 2 and 1 times a power of ten from 10**4 to 10**-8.
TICKS = [m * 10.0**k for k in range(4, -9, -1) for m in (5, 2, 1)]
OFF_GRID_SHARE = 1e-4


#: Counters that depend on the order of rows: their column in order_flags and how it is put together.
ORDER = {"duplicate_rows": "repeated", "ts_backwards": "back", "local_ts_backwards": "local_back"}


def complete() -> Column:
    out = F.lit(True)
    for c in BOOK_COLUMNS:
        out = out & F.col(c).isNotNull()
    return out


def order_flags(book: DataFrame, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """book with gap (to the row before in time), repeated, back and local_back (against the row before in seq)."""
    by_time, order = Window.partitionBy(*keys).orderBy("timestamp"), Window.partitionBy(*keys).orderBy("seq")
    repeated = F.lit(True)
    for c in BOOK_COLUMNS:
        repeated = repeated & (F.col(c) == F.lag(c).over(order))
    timed = book.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(by_time))
    back = {name: F.col(c) < F.lag(c).over(order) for name, c in (("back", "timestamp"), ("local_back", "local_timestamp"))}
    return timed.withColumns({"repeated": repeated, **back})


def _of_order(where: Column | None = None) -> dict[str, Column]:
    """Aggregates over order_flags, of the rows where a condition holds."""
    when = lambda c: c if where is None else F.when(where, c)
    counts = {name: F.count_if(F.coalesce(when(F.col(flag)), F.lit(False))) for name, flag in ORDER.items()}
    return counts | {"max_gap_s": F.coalesce(F.max(when(F.col("gap"))), F.lit(0)) / SECOND}


def observe_order(book: DataFrame, streams: list[tuple[str, int]], observation: Observation) -> DataFrame:
    """book as it is; whatever job reads it leaves the order counters of each stream (symbol, day0) in the observation."""
    metrics = []
    for i, (symbol, day0) in enumerate(streams):
        own = (F.col("symbol") == symbol) & (F.col("day0") == day0)
        metrics += [v.alias(f"{name}_{i}") for name, v in _of_order(own).items()]
    return order_flags(book).observe(observation, *metrics).select(*book.columns)


def observed_order(spark: SparkSession, streams: list[tuple[str, int]], observation: Observation) -> DataFrame:
    """symbol, day0 and the order counters, once the job is done."""
    found, names = observation.get, [*ORDER, "max_gap_s"]
    rows = [(*s, *(found[f"{name}_{i}"] for name in names)) for i, s in enumerate(streams)]
    return spark.createDataFrame(rows, "symbol string, day0 long, duplicate_rows long, ts_backwards long, local_ts_backwards long, max_gap_s double")


def order_report(book: DataFrame, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    return order_flags(book, keys).groupBy(*keys).agg(*[v.alias(name) for name, v in _of_order().items()])


def value_counts(book: DataFrame, tick, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """keys, kind, value and n, from one reading: how often each receive delay (d, in ms), hour (h) and, in complete rows, spread in ticks (s), price (p) and flag (f: 1 crossed, 2 off the grid) occurs."""
    tick = F.lit(tick) if isinstance(tick, (int, float)) else tick
    bid, ask = F.col("bid_price"), F.col("ask_price")
    flag = (bid >= ask).cast("int") + 2 * (~(S.on_grid(bid, tick) & S.on_grid(ask, tick))).cast("int")
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("double").alias("value"))
    always = [entry("d", (F.col("local_timestamp") - F.col("timestamp")) / 1000), entry("h", F.pmod(F.floor(F.col("timestamp") / HOUR), F.lit(24)))]
    full = [entry("s", F.rint((ask - bid) / tick)), entry("p", bid), entry("p", ask), entry("f", flag)]
    entries = F.when(complete(), F.array(*always, *full)).otherwise(F.array(*always))
    return book.select(*keys, F.inline(entries)).groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"))


def value_report(book: DataFrame, tick, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """The figures that do not depend on the order of rows, by keys, all from the counts of values."""
    by = [*keys, "kind"]
    rows = ranked(value_counts(book, tick, keys), by)
    rows = rows.withColumn("step", F.col("value") - F.lag("value").over(Window.partitionBy(*by).orderBy("value")))
    of = lambda kind: F.col("kind") == kind
    n = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    share = lambda kind, where: F.try_divide(n(of(kind) & where), F.sum(F.when(of(kind), F.col("n"))))
    flagged = lambda bit: of("f") & (F.col("value").cast("int").bitwiseAND(bit) > 0)
    spreads = [picked(p, of("s")).cast("int") for p in (0.5, 0.99, 1.0)]
    return rows.groupBy(*keys).agg(
        n(of("d")).alias("rows"),
        (n(of("d")) - n(of("s"))).alias("rows_with_nan"),
        n(flagged(1)).alias("crossed_or_locked"),
        n(flagged(2)).alias("off_grid_rows"),
        F.when(n(of("s")) > 0, F.array(*spreads)).alias("spread_ticks_p50_p99_max"),
        share("s", F.col("value") == 1).alias("frac_spread_1tick"),
        picked(0.5, of("d")).alias("recv_delay_ms_p50"),
        picked(0.99, of("d")).alias("recv_delay_ms_p99"),
        share("d", F.col("value") < 0).alias("frac_recv_delay_negative"),
        F.round(F.min(F.when(of("p"), F.col("step"))), 10).alias("inferred_tick"),
        F.array(*[n(of("h") & (F.col("value") == h)) for h in range(24)]).alias("rows_per_hour"),
    )


def quality_report(book: DataFrame, tick, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """One row of quality figures per stream.

    book has keys, seq and the book columns; tick is a number or a column of book. Spreads, prices and grid checks use
    rows without a missing value. Percentiles come from counts of the distinct values.
    """
    return value_report(book, tick, keys).join(order_report(book, keys), list(keys))


def price_step(book: DataFrame, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """Smallest gap between distinct prices of complete rows (null with fewer than two)."""
    full = book.dropna("any", subset=BOOK_COLUMNS)
    prices = full.select(*keys, F.explode(F.array("bid_price", "ask_price")).alias("price")).distinct()
    gap = F.col("price") - F.lag("price").over(Window.partitionBy(*keys).orderBy("price"))
    return prices.withColumn("gap", gap).groupBy(*keys).agg(F.round(F.min("gap"), 10).alias("inferred_tick"))


def rows_per_hour(book: DataFrame, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """A row for each of the 24 hours of each stream, those without rows included."""
    counts = book.groupBy(*keys, F.pmod(F.floor(F.col("timestamp") / HOUR), F.lit(24)).cast("int").alias("hour")).agg(F.count("*").alias("rows"))
    grid = book.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(counts, [*keys, "hour"], "left").select(*keys, "hour", F.coalesce("rows", F.lit(0)).alias("rows"))


def infer_tick(prices: DataFrame, keys: tuple[str, ...] = ("symbol",), least: float = 0.9999) -> DataFrame:
    """keys and tick: the largest candidate, no larger than the least price, that so many prices are multiples of.

    prices has keys and price. Equal prices are counted first, so only distinct ones meet the 39 candidates;
    tick is null where none fits.
    """
    by_price = counted(prices.withColumnRenamed("price", "value"), list(keys), "value")
    tried = by_price.select(*keys, "value", "n", F.explode(F.array(*[F.lit(t) for t in TICKS])).alias("tick"))
    on = F.sum(F.when(S.on_grid(F.col("value"), F.col("tick")), F.col("n")).otherwise(0))
    shares = tried.groupBy(*keys, "tick").agg(on.alias("on"), F.sum("n").alias("all"), F.min("value").alias("low"))
    fits = (F.col("tick") <= F.col("low")) & (F.col("on") / F.col("all") >= least)
    return shares.groupBy(*keys).agg(F.round(F.max(F.when(fits, F.col("tick"))), 12).alias("tick"))


def refused(report: DataFrame, share: float = OFF_GRID_SHARE) -> DataFrame:
    """The streams with more off-grid rows than the share allows."""
    return report.where(F.col("off_grid_rows") > share * F.col("rows"))


def gate(report: DataFrame, share: float = OFF_GRID_SHARE) -> None:
    """ValueError if a stream is refused."""
    if bad := refused(report, share).limit(1).collect():
        raise ValueError(f"too many off-grid rows: {bad[0].asDict()}")


def bucket_shares(buckets: DataFrame, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """Shares of empty buckets, of buckets without a price move, and of bucket ends with a spread above one tick."""
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    return buckets.groupBy(*keys).agg(share(F.col("n_events") == 0).alias("frac_empty"), share(F.col("dmid_ticks") == 0).alias("frac_dmid_zero"), share(F.col("spread_ticks") > 1).alias("frac_spread_gt1"))

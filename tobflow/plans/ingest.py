"""From raw days to day grids, quality reports and prediction frames.

Every step takes (symbol, day) pairs, leaves out those its table holds before anything is read, fetches the raw files
of the others, and works on all of them in one plan. A raw file is read once for its values and once more for its
grid; the second reading also leaves the order counters of the quality report, as observed metrics.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tobflow import config as C
from tobflow.operators import buckets as K
from tobflow.operators import predict, quality
from tobflow.schema import BOOK_COLUMNS, SECOND, STREAM
from tobflow.sources import archive, market, reports

STEP_US = 100_000
BOOK, TRADES = "book_ticker", "trades"


def ticks(book: DataFrame) -> DataFrame:
    """symbol, day0 and the tick of each day's complete rows; a day without one is an error."""
    full = book.dropna("any", subset=BOOK_COLUMNS)
    prices = full.select(*STREAM, F.explode(F.array("bid_price", "ask_price")).alias("price"))
    out = quality.infer_tick(prices, tuple(STREAM))
    if bad := out.where("tick IS NULL").limit(1).collect():
        raise ValueError(f"no tick found for {bad[0].symbol}")
    return out


def values(book: DataFrame, tick: DataFrame | None = None) -> DataFrame:
    """The quality figures that need no order, with each day's own tick; days off their tick are an error.

    The result is a row a stream and kept, so that later steps do not read the book for it again.
    """
    tick = (ticks(book) if tick is None else tick).persist()
    if tick.isEmpty():
        raise ValueError("the files hold no rows")
    report = quality.value_report(book.join(F.broadcast(tick), STREAM), F.col("tick")).join(tick, STREAM).persist()
    tick.unpersist()
    quality.gate(report)
    return report


def day_buckets(spark: SparkSession, book: DataFrame, freq_us: int, clock: str = "timestamp", tick: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Callable[[], DataFrame]]:
    """The grid of raw days with their ticks, the value part of the quality report, and the order part.

    Whatever job first reads the whole grid also observes the order counters; the last result gives them then.
    """
    report = values(book, tick)
    streams = [(r.symbol, r.day0) for r in report.select(*STREAM).orderBy(*STREAM).collect()]
    seen = Observation()
    own = report.select(*STREAM, "tick")
    grid = K.bucketize(quality.observe_order(book, streams, seen), freq_us, own, clock)
    return grid.join(F.broadcast(own), STREAM), report, lambda: quality.observed_order(spark, streams, seen)


def raw_days(spark: SparkSession, wanted: list[tuple[str, str]], paths: C.Paths, datasets: tuple[str, ...] = (BOOK, TRADES)) -> tuple[list[tuple[str, str]], dict[str, list[str]]]:
    """Fetch the raw files of days: the days that have them all, and their paths by dataset. Missing days are reported."""
    found = archive.fetch(spark, [(d, *w) for w in wanted for d in datasets], paths)
    gone = sorted({(r.symbol, r.day) for r in found if r.status == "missing"})
    for symbol, day in gone:
        print(f"MISSING {symbol} {day}: not in the archive, left out", file=sys.stderr)
    kept = [w for w in wanted if w not in gone]
    return kept, {d: [r.path for r in found if r.dataset == d and (r.symbol, r.day) in kept] for d in datasets}


def _todo(spark: SparkSession, root: str, symbols: Iterable[str], days: Iterable[str]) -> list[tuple[str, str]]:
    wanted = [(s, C.check_date(d)) for s in symbols for d in days]
    todo = market.pending(spark, root, wanted)
    for symbol, day in wanted:
        if (symbol, day) not in todo:
            print(f"{symbol} {day} exists, skipping")
    return todo


def build_buckets(spark: SparkSession, symbols: Iterable[str], days: Iterable[str], paths: C.Paths, freq_us: int = SECOND) -> DataFrame | None:
    """Day grids with trade imbalance, by symbol and day, and a quality report each; None if there was nothing to do."""
    todo = _todo(spark, paths.buckets(), symbols, days)
    todo, files = raw_days(spark, todo, paths)
    if not todo:
        return None
    book = market.read_book(spark, *files[BOOK])
    grid, report, order = day_buckets(spark, book, freq_us)
    market.write_days(K.with_imbalance(grid, market.read_trades(spark, *files[TRADES]), freq_us), paths.buckets())
    written = spark.read.parquet(paths.buckets()).drop("day").join(F.broadcast(report.select(*STREAM)), STREAM, "left_semi")
    names = {"frac_dmid_zero": "frac_dmid_zero_10s", "frac_spread_gt1": "frac_spread_gt1_10s_bucket_end"}
    coarse = K.drop_funding(K.resample(written.drop("tick"), 10 * freq_us), 10 * freq_us)
    coarse = quality.bucket_shares(coarse).select(*STREAM, *[F.col(k).alias(v) for k, v in names.items()])
    fine = quality.bucket_shares(written).select(*STREAM, F.col("frac_empty").alias("frac_empty_1s_buckets"))
    whole = report.join(order(), STREAM).join(fine, STREAM).join(coarse, STREAM).persist()
    reports.write_quality(whole, paths.reports() / "quality", BOOK)
    report.unpersist()
    return whole


def build_frames(spark: SparkSession, symbols: Iterable[str], days: Iterable[str], paths: C.Paths) -> None:
    """Receive-clock grids of 100 ms into prediction frames, by symbol and day. A receive clock that runs backwards is an error."""
    todo = _todo(spark, paths.frames(), symbols, days)
    todo, files = raw_days(spark, todo, paths)
    if not todo:
        return
    book = market.read_book(spark, *files[BOOK])
    if bad := quality.order_flags(book).where("local_back").select("symbol", "day0").limit(1).collect():
        raise ValueError(f"the receive clock of {bad[0].symbol} runs backwards")
    grid, report, _ = day_buckets(spark, book, STEP_US, "local_timestamp")
    fine = K.with_imbalance(grid, market.read_trades(spark, *files[TRADES]), STEP_US, "local_timestamp")
    latencies = tuple(1000 * x for x in C.LATENCIES_MS)
    frame = predict.predictive_frame(fine, F.col("tick"), STEP_US, 10 * SECOND, latencies)
    market.write_days(frame.drop("day"), paths.frames())
    report.unpersist()

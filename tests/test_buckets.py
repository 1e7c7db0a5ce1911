import numpy as np
import pytest
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.operators import buckets as K
from tobflow.operators.events import event_flow, nan_to_null, with_days, with_median_day
from tobflow.schema import DAY, HOUR, SECOND

DAY0 = 19601 * DAY  # 2023-09-01
BOOK = "symbol string, day0 long, seq long, timestamp long, local_timestamp long, bid_price double, bid_amount double, ask_price double, ask_amount double"


def book(spark, rows, day0=DAY0):
    """rows: (seconds after midnight, bid price, bid size, ask price, ask size), in file order."""
    return spark.createDataFrame([("X", day0, i, day0 + round(s * SECOND), day0 + round(s * SECOND) + 5000, float(bp), float(bs), float(ap), float(az)) for i, (s, bp, bs, ap, az) in enumerate(rows)], BOOK)


def flows(spark, rows):
    return [r.flow for r in event_flow(book(spark, rows)).orderBy("seq").collect()]


@pytest.mark.parametrize(
    "new, expected",
    [
        ((100.0, 8, 100.3, 3), 3), ((99.9, 4, 100.3, 3), -5), ((100.1, 7, 100.3, 3), 7), ((100.0, 5, 100.3, 7), -4),
        ((100.0, 5, 100.2, 2), -2), ((100.0, 5, 100.4, 9), 3), ((100.0, 5, 100.3, 3), 0),
    ],
)
def test_flow_of_one_update(spark, new, expected):
    assert flows(spark, [(1, 100.0, 5, 100.3, 3), (2, *new)]) == [None, expected]


def test_flow_with_constant_prices_telescopes(spark):
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, (50, 2)).astype(float)
    got = flows(spark, [(i, 100.0, a, 100.1, b) for i, (a, b) in enumerate(sizes)])
    assert sum(got[1:]) == (sizes[-1, 0] - sizes[0, 0]) - (sizes[-1, 1] - sizes[0, 1])


def test_a_missing_size_makes_flow_missing_and_a_missing_price_silences_its_side(spark):
    nan = float("nan")
    rows = book(spark, [(1, 100.0, 5.0, 100.3, 3.0), (2, nan, 6.0, 100.3, 7.0), (3, 100.0, nan, 100.3, 1.0), (4, 100.0, 1.0, 100.3, 1.0)])
    got = [r.flow for r in event_flow(nan_to_null(rows)).orderBy("seq").collect()]
    assert got == [None, -4.0, None, None]


def test_grid_seeds_fills_and_differences(spark):
    rows = book(spark, [(-1, 100.0, 2, 100.2, 4), (0, 100.1, 2, 100.3, 4), (9.999, 100.2, 2, 100.4, 6), (30, 100.2, 2, 100.6, 6)])
    grid = K.bucketize(rows, 10 * SECOND, 0.1).orderBy("t").collect()
    assert len(grid) == 8640
    assert [g.n_events for g in grid[:5]] == [2, 0, 0, 1, 0]
    assert [round(g.mid, 6) for g in grid[:5]] == [100.3, 100.3, 100.3, 100.4, 100.4]
    assert [g.dmid_ticks for g in grid[:4]] == [2.0, 0.0, 0.0, 1.0]
    assert [g.spread_ticks for g in grid[:4]] == [2.0, 2.0, 2.0, 4.0]
    assert grid[0].depth == 4.0


def test_without_an_earlier_row_the_first_move_is_unknown(spark):
    grid = K.bucketize(book(spark, [(5, 100.0, 1, 100.2, 1), (15, 100.1, 1, 100.3, 1)]), 10 * SECOND, 0.1).orderBy("t").limit(2).collect()
    assert [g.dmid_ticks for g in grid] == [None, 1.0]


def test_coarser_grid_equals_direct_grid(spark):
    rng = np.random.default_rng(1)
    n = 3000
    times = np.sort(rng.uniform(0, 7200, n))
    bid = 100 + np.cumsum(rng.integers(-1, 2, n)) * 0.5
    rows = [(-0.001, 100.0, 1.0, 100.5, 1.0)] + [(float(t), float(b), float(x), float(b + 0.5 * s), float(y)) for t, b, x, s, y in zip(times, bid, rng.integers(1, 9, n), rng.integers(1, 4, n), rng.integers(1, 9, n))]
    b = book(spark, rows)
    fine = K.resample(K.bucketize(b, SECOND, 0.5), 10 * SECOND).orderBy("t").toPandas()
    direct = K.bucketize(b, 10 * SECOND, 0.5).orderBy("t").toPandas()
    assert (fine["t"] == direct["t"]).all() and len(fine) == 8640
    for c in ("flow", "dmid_ticks", "depth", "spread_ticks", "n_events", "mid"):
        np.testing.assert_allclose(fine[c].fillna(0), direct[c].fillna(0), atol=1e-9)


def test_days_of_a_stream_carry_the_row_before(spark):
    two = book(spark, [(86399, 100.0, 1, 100.5, 1), (86401, 101.0, 1, 101.5, 1)]).drop("day0")
    days = with_days(two)
    assert days.count() == 3
    second = K.bucketize(days, 10 * SECOND, 0.5).where(F.col("day0") == DAY0 + DAY).orderBy("t").first()
    assert second.dmid_ticks == 2.0 and second.n_events == 1


def test_a_day_after_a_gap_starts_from_nothing(spark):
    gap = book(spark, [(86399, 100.0, 1, 100.5, 1), (2 * 86400 + 1, 101.0, 1, 101.5, 1)]).drop("day0")
    days = with_days(gap)
    assert days.count() == 2
    later = K.bucketize(days, 10 * SECOND, 0.5).where(F.col("day0") == DAY0 + 2 * DAY).orderBy("t").first()
    assert later.dmid_ticks is None and later.n_events == 1


def test_a_file_keeps_its_day_by_the_median_time(spark):
    early = [(-0.001, 100.0, 1, 100.5, 1), (5, 100.0, 1, 100.5, 1), (9, 101.0, 1, 101.5, 1)]
    files = book(spark, early).drop("day0").withColumn("file", F.lit("a")).unionByName(book(spark, early, DAY0 + DAY).drop("day0").withColumn("file", F.lit("b")))
    days = with_median_day(files, ["file"])
    assert {(r.file, r.day0) for r in days.select("file", "day0").distinct().collect()} == {("a", DAY0), ("b", DAY0 + DAY)}
    first = K.bucketize(days, 10 * SECOND, 0.5).where(F.col("day0") == DAY0).orderBy("t").first()
    assert (first.n_events, first.dmid_ticks) == (2, 2.0)


def test_the_seed_is_the_last_row_before_the_day_even_if_it_is_incomplete(spark):
    nan = float("nan")
    rows = nan_to_null(book(spark, [(-2, 100.0, 1, 100.5, 1), (-1, nan, 1, 100.5, 1), (11, 101.0, 1, 101.5, 1)]))
    grid = K.bucketize(rows, 10 * SECOND, 0.5).orderBy("t").limit(2).collect()
    assert [(g.mid, g.dmid_ticks, g.depth) for g in grid] == [(None, None, 1.0), (101.25, None, 1.0)]


def test_receive_clock_moves_an_event(spark):
    b = book(spark, [(1, 100.0, 1, 100.2, 1), (9.998, 100.1, 1, 100.3, 1)])
    by = {c: [r.n_events for r in K.bucketize(b, 10 * SECOND, 0.1, c).orderBy("t").limit(2).collect()] for c in ("timestamp", "local_timestamp")}
    assert by == {"timestamp": [2, 0], "local_timestamp": [1, 1]}


def test_trade_imbalance(spark):
    rows = [(-1, "buy", 9.0), (1, "buy", 2.0), (2, "sell", 0.5), (11, "sell", 1.0), (12, "unknown", 5.0)]
    t = spark.createDataFrame([("X", DAY0, DAY0 + s * SECOND, DAY0, side, a) for s, side, a in rows], "symbol string, day0 long, timestamp long, local_timestamp long, side string, amount double")
    got = [r.ti for r in K.trade_imbalance(t, 10 * SECOND).orderBy("t").limit(3).collect()]
    assert got == [1.5, -1.0, 0.0]


def test_funding_times(spark):
    at = [(7, 57, 50), (7, 58, 0), (8, 0, 0), (8, 1, 50), (8, 2, 0), (12, 0, 0), (23, 59, 0), (0, 0, 0)]
    rows = spark.createDataFrame([("X", DAY0, DAY0 + (h * 3600 + m * 60 + s) * SECOND) for h, m, s in at], "symbol string, day0 long, t long")
    kept = sorted((r.t - DAY0) // SECOND for r in K.drop_funding(rows, 10 * SECOND).collect())
    assert kept == [7 * 3600 + 57 * 60 + 50, 8 * 3600 + 120, 12 * 3600]


def test_floor_of_early_times_and_lags(spark):
    row = spark.range(1).select(S.bucket_id(F.lit(-1000), F.lit(0), SECOND).alias("k"), *[S.newey_west_lags(F.lit(n)).alias(f"n{n}") for n in (100, 180, 1000)], S.four_hour_block(F.lit(DAY0 + 13 * HOUR)).alias("b"), S.is_weekend(F.lit(DAY0 + DAY)).alias("w")).first()
    assert tuple(row) == (-1, 4, 4, 6, 3, 1)

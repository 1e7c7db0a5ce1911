import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tobflow.operators import bootstrap as B
from tobflow.operators import depthfit, explore, predict, strategy
from tobflow.operators.percentiles import counted, percentiles
from tobflow.schema import DAY, SECOND

DAY0 = 19601 * DAY
STEP, FREQ = SECOND, 10 * SECOND


@pytest.fixture(scope="module")
def fine(spark):
    """One second steps: flow 3 just before noon, 11 just after; the price moves at noon + 15 s and noon + 25 s."""
    noon = DAY0 + 12 * 3600 * SECOND
    t = (F.col("id") * SECOND + DAY0).alias("t")
    rows = spark.range(86400).select(F.lit("X").alias("symbol"), F.lit(DAY0).alias("day0"), t)
    after = F.col("t") - noon
    mid = F.when(after < 15 * SECOND, 100.0).when(after < 25 * SECOND, 100.5).otherwise(101.5)
    return rows.withColumns({"flow": F.when(after == -2 * SECOND, 3.0).when(after == 2 * SECOND, 11.0).otherwise(0.0), "ti": F.lit(1.0), "mid": mid, "depth": F.lit(4.0), "spread_ticks": F.lit(1.0)}), noon


def test_frame_values_and_no_look_ahead(fine):
    rows, noon = fine
    out = predict.predictive_frame(rows, 0.5, STEP, FREQ, (0, SECOND, 5 * SECOND))
    at = {r.t: r for r in out.where((F.col("t") >= noon) & (F.col("t") <= noon + 40 * SECOND)).collect()}
    assert (at[noon].x, at[noon + FREQ].x, at[noon + 2 * FREQ].x) == (3.0, 11.0, 0.0)
    assert (at[noon].y_0, at[noon + FREQ].y_0, at[noon + FREQ].y_5000) == (0.0, 1.0, 1.0)
    assert at[noon + 2 * FREQ].ar_lag == 1.0 and at[noon].ti_lag == 10.0 and at[noon].depth_t == 4.0
    assert out.where("tgt_start_0 < feat_end OR tgt_start_1000 < feat_end").count() == 0
    assert out.where((F.col("t") - DAY0) < 130 * SECOND).count() == 0


def test_latency_off_the_grid_is_an_error(fine):
    with pytest.raises(ValueError):
        predict.predictive_frame(fine[0], 0.5, STEP, FREQ, (1500,))


def long(spark, rows):
    return spark.createDataFrame(rows, "symbol string, day string, t long, model string, latency_ms double, x double, y double, mid_entry double, half_spread_bps double, tick double")


def test_fit_walk_forward_and_r2(spark):
    rng = np.random.default_rng(3)
    data = [("X", f"d{d:02d}", d * 1000 + i, "flow", 0.0, float(x), float(1 + 2 * x + e), 100.0, 1.0, 0.5) for d in range(6) for i, (x, e) in enumerate(rng.normal(0, 1, (40, 2)))]
    rows = long(spark, data)
    x, y, d = (np.array([r[j] for r in data]) for j in (5, 6, 1))
    want = np.polyfit(x, y, 1)
    got = predict.fit_models(rows).first()
    np.testing.assert_allclose([got.b, got.a], want, rtol=1e-9)
    flat = predict.fit_models(rows.withColumn("x", F.lit(2.0))).first()
    np.testing.assert_allclose([flat.a, flat.b], np.linalg.lstsq(np.column_stack([np.ones(len(y)), np.full(len(y), 2.0)]), y, rcond=None)[0], rtol=1e-9)
    walked = {r.day: r for r in predict.walk_forward(rows, 3).collect()}
    assert sorted(walked) == ["d03", "d04", "d05"]
    for day in walked:
        b, a = np.polyfit(x[d < day], y[d < day], 1)
        own = d == day
        sse = np.sum((y[own] - a - b * x[own]) ** 2)
        np.testing.assert_allclose([walked[day].sse, walked[day].oos_r2], [sse, 1 - sse / np.sum(y[own] ** 2)], rtol=1e-9)


@pytest.mark.parametrize("yhat, gap, turnover", [([1, -1, 1, -1], None, 8), ([1, 1, 1, 1], None, 2), ([1, 1, 1, 1], 2, 4), ([0, 0, 0, 0], None, 0)])
def test_strategy_turnover(spark, yhat, gap, turnover):
    rows = [("X", "d", i * FREQ + (FREQ if gap and i >= gap else 0), "flow", 0.0, 0.0, float(v), 100.0, 1.0, 0.5) for i, v in enumerate([2, -1, 3, 1])]
    got = strategy.sign_strategy(long(spark, rows).withColumn("yhat", F.element_at(F.array(*[F.lit(float(v)) for v in yhat]), (F.row_number().over(__import__("pyspark").sql.Window.orderBy("t"))))), FREQ, 5.0).first()
    assert got.turnover == turnover
    gross = sum(np.sign(p) * v * 0.5 / 100 * 1e4 for p, v in zip(yhat, [2, -1, 3, 1]))
    assert got.gross_bps == pytest.approx(gross) and got.net_bps == pytest.approx(gross - 6 * turnover)
    assert got.break_even_bps == (pytest.approx(gross / turnover) if turnover else None)


def test_bootstrap_draws_follow_the_generator(spark):
    blocks, rng = ["b", "a", "c"], np.random.default_rng(9)
    values = pd.DataFrame({"symbol": "X", "day": ["b", "a", "a", "c", "c", "c", "c"], "x": [2.0, 1.0, 5.0, 9.0, 4.0, 7.0, None], "z": [1.0, 2, 3, 4, 5, 6, 7], "at": range(7)})
    want = {"x": [], "gap": [], "explained": [], "any": []}
    for _ in range(50):
        rows = pd.concat([values[values.day == blocks[j]] for j in rng.integers(0, 3, 3)])
        want["x"].append(rows.x.median())
        want["gap"].append(rows.x.median() - rows.z.median())
        want["explained"].append(1 - rows.x.sum() / rows.z.sum())
        want["any"].append(rows.z.sum())
    statistics = {"x": B.Median("x"), "gap": B.Difference(B.Median("x"), B.Median("z")), "explained": B.Explained("x0", "z"), "any": B.Each(lambda rows, weight: float((rows["z"] * weight).sum()))}
    frame = spark.createDataFrame(values).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("x0", F.coalesce("x", F.lit(0.0)))
    draws = B.bootstrap(frame, "day", statistics, keys=["symbol"], columns=["x", "x0", "z"], order="at", draws=50, seed=9, batch=7).persist()
    got = draws.orderBy("draw").toPandas()
    for name, numbers in want.items():
        np.testing.assert_allclose(got[name], numbers)
    ci = B.percentile_ci(draws, "x", keys=["symbol"]).first().x
    np.testing.assert_allclose([ci.lo, ci.hi], np.quantile(want["x"], [0.025, 0.975]))


def test_all_draws_over_a_month(spark):
    """10,000 draws over 30 days of 48 windows, against medians of repeated rows for some of the draws."""
    rng = np.random.default_rng(1)
    values = pd.DataFrame({"symbol": "X", "day": np.repeat([f"d{i:02d}" for i in range(30)], 48), "x": rng.random(1440), "at": range(1440)})
    draws = B.bootstrap(spark.createDataFrame(values), "day", {"x": B.Median("x")}, keys=["symbol"], columns=["x"], order="at").toPandas().set_index("draw").x
    assert len(draws) == 10_000
    times, by_day = B.multiplicities(30), values.x.to_numpy().reshape(30, 48)
    for k in range(0, 10_000, 997):
        assert draws[k] == np.median(np.repeat(by_day, times[k], axis=0))


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_percentiles_by_counts(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(0, 3, n), 1)
    df = spark.createDataFrame([("k", float(v)) for v in [*values, *values[: n // 2]]] + [("one", 3.0), ("none", None)], "key string, v double")
    wanted = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.key: r for r in percentiles(counted(df, ["key"], "v"), ["key"], wanted).collect()}
    np.testing.assert_allclose([got["k"][c] for c in wanted], np.quantile([*values, *values[: n // 2]], list(wanted.values())))
    assert [got["one"][c] for c in wanted] == [3.0] * 5 and "none" not in got


def test_a_session_runs_over_midnight(spark):
    """Day by day, with the border rows carried, equals one pass over all rows."""
    rng = np.random.default_rng(4)
    times = np.flatnonzero(rng.random(600) < 0.8) * FREQ + DAY0 + DAY - 200 * FREQ
    rows = [("X", str(t // DAY), int(t), "flow", 0.0, 0.0, float(y), 100.0, float(h), 0.5, float(p)) for t, y, h, p in zip(times, rng.normal(size=600), rng.random(600), rng.integers(-1, 2, 600))]
    df = spark.createDataFrame(rows, "symbol string, day string, t long, model string, latency_ms double, x double, y double, mid_entry double, half_spread_bps double, tick double, yhat double")
    got = strategy.sign_strategy(df, FREQ, 5.0).first()
    turn = gross = cost = 0.0
    for i, r in enumerate(rows):
        before = rows[i - 1][10] if i and r[2] - rows[i - 1][2] == FREQ else 0.0
        last = i + 1 == len(rows) or rows[i + 1][2] - r[2] != FREQ
        step = abs(r[10] - before) + (abs(r[10]) if last else 0)
        turn, gross, cost = turn + step, gross + r[10] * r[6] * 0.5 / 100 * 1e4, cost + step * (5 + r[8])
    assert got.turnover == pytest.approx(turn) and got.net_bps == pytest.approx(gross - cost) and got.days == len({r[1] for r in rows})
    assert got.median_half_spread_bps == pytest.approx(np.median([r[8] for r in rows]))


def test_depth_fit_recovers_and_keeps_negative_betas(spark):
    rng = np.random.default_rng(2)
    n = 1500
    depth, block, weekend = np.exp(rng.normal(1, 0.5, n)), rng.integers(0, 6, n), rng.integers(0, 2, n)
    beta = np.exp(0.3 + 0.2 * weekend + 0.1 * (block == 3)) / depth * (1 + rng.normal(0, 0.05, n))
    beta[:20] = -0.01
    z, names = depthfit.control_matrix(block, weekend)
    p, ok = depthfit.fit_depth(beta[20:], depth[20:], z[20:])
    assert ok and abs(p[-1] - 1) < 0.05 and abs(p[1:-1][names.index("weekend")] - 0.2) < 0.05
    rows = pd.DataFrame({"symbol": "X", "window": np.arange(n), "beta": beta, "depth_mean": depth, "block": block, "weekend": weekend})
    fit = depthfit.fit_panel(spark.createDataFrame(rows)).first()
    assert fit.n == n and fit.converged
    whole, _ = depthfit.fit_depth(np.repeat(beta, 2), np.repeat(depth, 2), np.repeat(z, 2, axis=0))
    weighted, _ = depthfit.fit_depth(beta, depth, z, np.full(n, 2))
    np.testing.assert_allclose(whole, weighted, atol=1e-7)


def test_ranks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, 300).astype(float), rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "x": x, "y": y, "i": np.arange(300)}))
    got = explore.spearman(df, "x", "y").first()
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert got.rho == pytest.approx(want)
    assert explore.spearman_p(-0.161, 1488) == pytest.approx(4.3e-10, rel=0.05) and explore.spearman_p(0.012, 1488) == pytest.approx(0.65, abs=0.01)
    cut = pd.qcut(pd.Series(x).rank(method="first"), 5, labels=False)
    ours = explore.quintiles(df, "x", "i").orderBy("i").toPandas()["quintile"]
    assert (ours == cut).all()
    assert explore.lower_quantile(df, "y", 0.3).first().q == sorted(y)[int(np.floor(0.3 * 299))]

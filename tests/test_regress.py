import numpy as np
import pytest
from pyspark.sql import functions as F

from tobflow.operators.regress import shifted, window_features, window_regressions
from tobflow.schema import DAY, SECOND

DAY0 = 19601 * DAY
FREQ, WINDOW = 10 * SECOND, 1800 * SECOND


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    n = 8640
    x = rng.integers(-20, 21, n).astype(float)
    y = 0.5 * x + rng.normal(0, 12, n)
    rows = [("X", DAY0, DAY0 + i * FREQ, float(x[i]), float(x[i] * abs(x[i])), float(y[i]), 2.0, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, day0 long, t long, flow double, square double, dmid_ticks double, depth double, spread_ticks double").cache(), x, y


def hac(x, y):
    """Sandwich with Bartlett weights, by matrices."""
    n = len(y)
    X = np.column_stack([np.ones(n), *x])
    coef = np.linalg.solve(X.T @ X, X.T @ y)
    u = y - X @ coef
    g = X * u[:, None]
    lags = int(np.floor(4 * (n / 100) ** (2 / 9)))
    s = g.T @ g
    for k in range(1, lags + 1):
        w = 1 - k / (lags + 1)
        s += w * (g[k:].T @ g[:-k] + g[:-k].T @ g[k:])
    inv = np.linalg.inv(X.T @ X)
    v = inv @ s @ inv
    return coef, coef[1] / np.sqrt(v[1, 1]), 1 - u @ u / np.sum((y - y.mean()) ** 2)


def test_matches_matrix_formulas(panel):
    rows, x, y = panel
    for z in (None, "square"):
        got = window_regressions(rows, WINDOW, z=z).orderBy("window").collect()
        assert len(got) == 48 and all(g.n == 180 for g in got)
        for i in (0, 20, 47):
            part = slice(180 * i, 180 * (i + 1))
            coef, t, r2 = hac([x[part]] if z is None else [x[part], x[part] * abs(x[part])], y[part])
            np.testing.assert_allclose([got[i].alpha, got[i].beta, got[i].t_nw, got[i].r2], [coef[0], coef[1], t, r2], rtol=1e-6, atol=1e-9)


def test_placebo_collapses(panel):
    rows, _, _ = panel
    assert window_regressions(rows, WINDOW, shift_us=5 * FREQ).agg(F.median("r2")).first()[0] < 0.02


def test_placebo_is_matched_by_time(panel):
    rows, x, _ = panel
    gap = rows.where((F.col("t") < DAY0 + 100 * FREQ) | (F.col("t") >= DAY0 + 110 * FREQ))
    at = {r.t: r.v for r in gap.select("t", shifted(gap, "flow", 5 * FREQ).alias("v")).collect()}
    assert at[DAY0 + 112 * FREQ] is None and at[DAY0 + 115 * FREQ] is None or at[DAY0 + 115 * FREQ] == x[110]
    assert at[DAY0 + 5 * FREQ] == x[0] and at[DAY0 + 4 * FREQ] is None


def test_small_constant_and_flat_windows(panel, spark):
    rows, _, _ = panel
    assert window_regressions(rows.limit(29), WINDOW).count() == 0
    assert window_regressions(rows.withColumn("flow", F.lit(1.0)), WINDOW).count() == 0
    assert window_regressions(rows.withColumn("dmid_ticks", F.lit(1.0)), WINDOW).where("r2 IS NOT NULL").count() == 0


def test_features(spark):
    rows = [("X", DAY0, DAY0 + i * FREQ, 2.0 if i < 180 else 6.0, (2.0 if i % 2 else 1.0) if i < 180 else None) for i in range(360)]
    df = spark.createDataFrame(rows, "symbol string, day0 long, t long, depth double, spread_ticks double")
    got = window_features(df, WINDOW).orderBy("window").collect()
    assert [(g.depth_mean, g.frac_spread_gt1) for g in got] == [(2.0, 0.5), (6.0, 0.0)]

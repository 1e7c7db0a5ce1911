"""Per-window least squares with Newey-West errors, and window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tobflow.config import MIN_OBSERVATIONS
from tobflow.functions import scalars as S
from tobflow.schema import STREAM


def shifted(buckets: DataFrame, column: str, offset_us: int) -> Column:
    """column's value at t - offset_us of the same stream, null where that bucket is not there.

    A frame of one instant: matched by time, so excluded buckets leave gaps and do not shift others.
    """
    at = Window.partitionBy(*STREAM).orderBy("t").rangeBetween(-offset_us, -offset_us)
    return F.max(column).over(at)


def window_regressions(
    buckets: DataFrame,
    window_us: int,
    x: str = "flow",
    z: str | None = None,
    y: str = "dmid_ticks",
    *,
    shift_us: int = 0,
    max_lags: int = 8,
    least: int = MIN_OBSERVATIONS,
) -> DataFrame:
    """OLS of y on a constant, x and, if given, z, in each window of each stream.

    Returns symbol, day0, window, alpha, beta and t_nw (of x), r2 and n. Rows with a missing value are left out.
    Windows of fewer than ``least`` rows or a constant x have no row; a constant y has no r2. The errors use
    Bartlett weights over lags of rows, as many as newey_west_lags gives (at most max_lags).
    """
    source = buckets.withColumn("_x", shifted(buckets, x, shift_us) if shift_us else F.col(x))
    numbers = {"x": "_x", "y": y} | ({"z": z} if z else {})
    window = S.floor_to(F.col("t"), window_us).alias("window")
    rows = source.select(*STREAM, "t", window, *[F.col(c).cast("double").alias(k) for k, c in numbers.items()]).dropna("any")
    keys = [*STREAM, "window"]
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("t")
    moments = {"n": F.count("*"), "mx": F.avg("x"), "my": F.avg("y"), "xx": F.var_pop("x"), "yy": F.var_pop("y"), "xy": F.covar_pop("x", "y")}
    if z:
        moments |= {"mz": F.avg("z"), "zz": F.var_pop("z"), "xz": F.covar_pop("x", "z"), "zy": F.covar_pop("z", "y")}
    rows = rows.select("*", *[m.over(whole).alias(k) for k, m in moments.items()])
    rows = rows.where((F.col("n") >= least) & (F.col("xx") > 0))
    if z:
        det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
        b = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), det)
        c = F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz"), det)
        rows = rows.withColumn("b", b).withColumn("c", c)
        own = F.col("x") - F.col("mx") - F.try_divide(F.col("xz"), F.col("zz")) * (F.col("z") - F.col("mz"))
        error = F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")) - F.col("c") * (F.col("z") - F.col("mz"))
        explained = F.col("b") * F.col("xy") + F.col("c") * F.col("zy")
        alpha = F.col("my") - F.col("b") * F.col("mx") - F.col("c") * F.col("mz")
    else:
        rows = rows.withColumn("b", F.col("xy") / F.col("xx"))
        own = F.col("x") - F.col("mx")
        error = F.col("y") - F.col("my") - F.col("b") * own
        explained = F.col("b") * F.col("xy")
        alpha = F.col("my") - F.col("b") * F.col("mx")
    rows = rows.withColumn("own", own).withColumn("psi", own * error).withColumn("lags", F.least(S.newey_west_lags(F.col("n")), F.lit(max_lags)))
    total = F.col("psi") * F.col("psi")
    for lag in range(1, max_lags + 1):
        weight = F.greatest(F.lit(0.0), 1 - F.lit(lag) / (F.col("lags") + 1))
        total = total + 2 * weight * F.col("psi") * F.coalesce(F.lag("psi", lag).over(order), F.lit(0.0))
    r2 = F.when(F.col("yy") > 0, explained / F.col("yy"))
    rows = rows.select(*keys, "n", "b", alpha.alias("alpha"), r2.alias("r2"), (F.col("own") * F.col("own")).alias("own2"), total.alias("meat"))
    same = [F.first(c).alias(name) for c, name in (("alpha", "alpha"), ("b", "beta"), ("r2", "r2"), ("n", "n"))]
    out = rows.groupBy(*keys).agg(*same, F.sum("own2").alias("own2"), F.sum("meat").alias("meat"))
    t = F.try_divide(F.col("beta") * F.col("own2"), F.sqrt(F.when(F.col("meat") > 0, F.col("meat"))))
    return out.select(*keys, "alpha", "beta", t.alias("t_nw"), "r2", "n")


def window_features(buckets: DataFrame, window_us: int) -> DataFrame:
    """Mean depth, and the share of buckets that end with a spread above one tick (a missing spread does not)."""
    wide = F.avg(F.coalesce((F.col("spread_ticks") > 1).cast("double"), F.lit(0.0)))
    return buckets.groupBy(*STREAM, S.floor_to(F.col("t"), window_us).alias("window")).agg(F.avg("depth").alias("depth_mean"), wide.alias("frac_spread_gt1"))


def _r2_of_pair(x: str, least: int) -> Column:
    """R2 of a regression of dmid_ticks on x alone, over rows where both are known."""
    n, sxx, syy, sxy = (F.expr(f"{f}(dmid_ticks, {x})") for f in ("regr_count", "regr_sxx", "regr_syy", "regr_sxy"))
    return F.when((n >= least) & (sxx > 0) & (syy > 0), sxy * sxy / (sxx * syy))


def _r2_with_square(least: int) -> Column:
    """R2 of a regression of dmid_ticks on flow and flow * |flow|, from their co-moments."""
    m = {k: F.expr(e) for k, e in (
        ("xx", "var_pop(x)"), ("zz", "var_pop(z)"), ("yy", "var_pop(y)"),
        ("xz", "covar_pop(x, z)"), ("xy", "covar_pop(x, y)"), ("zy", "covar_pop(z, y)"),
    )}
    det = m["xx"] * m["zz"] - m["xz"] * m["xz"]
    explained = (m["xy"] * m["zz"] - m["zy"] * m["xz"]) * m["xy"] + (m["zy"] * m["xx"] - m["xy"] * m["xz"]) * m["zy"]
    return F.when((F.count("x") >= least) & (m["xx"] > 0) & (m["yy"] > 0), F.try_divide(explained, det) / m["yy"])


def window_panel(base: DataFrame, freq_us: int, window_us: int, *, shift: int = 5, least: int = MIN_OBSERVATIONS, max_lags: int = 8) -> DataFrame:
    """One row per window of a base grid (with ti): the regressions, features and controls of the study.

    Coarsens to freq_us, drops funding times, and returns symbol, day0, window, beta, t_nw, r2_flow, n, r2_quad,
    r2_ti, r2_plc_p5, r2_plc_m5, depth_mean, frac_spread_gt1, block, weekend, day and events (of the whole day).
    Rows with a missing value are left out. The grid is read once and shuffled by stream once: windows give the moved
    flow, the events of the day, the means and slope of each row's window and its lagged scores, and one aggregation
    takes every co-moment.
    """
    from tobflow.operators.buckets import drop_funding, resample

    day, keys = Window.partitionBy(*STREAM), [*STREAM, "window"]
    coarse = resample(base, freq_us).withColumn("events", F.sum("n_events").over(day))
    rows = drop_funding(coarse, freq_us).withColumn("window", S.floor_to(F.col("t"), window_us))
    known = F.col("flow").isNotNull() & F.col("dmid_ticks").isNotNull()
    rows = rows.withColumns({
        "plc_p": shifted(rows, "flow", shift * freq_us),
        "plc_m": shifted(rows, "flow", -shift * freq_us),
        "x": F.when(known, F.col("flow")),
        "y": F.when(known, F.col("dmid_ticks")),
        "z": F.when(known, F.col("flow") * F.abs("flow")),
    }).sortWithinPartitions(*keys, "t")
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({
        "n": F.count("x").over(whole),
        "mx": F.avg("x").over(whole),
        "my": F.avg("y").over(whole),
        "slope": F.try_divide(F.covar_pop("x", "y").over(whole), F.var_pop("x").over(whole)),
    })
    own = F.col("x") - F.col("mx")
    rows = rows.withColumns({"own2": own * own, "psi": own * (F.col("y") - F.col("my") - F.col("slope") * own)})
    # lags count known rows: a row's place among them orders it, others have no score
    order = Window.partitionBy(*keys).orderBy(F.col("psi").isNull(), "t")
    lags = F.least(S.newey_west_lags(F.col("n")), F.lit(max_lags))
    meat = F.col("psi") * F.col("psi")
    for lag in range(1, max_lags + 1):
        weight = F.greatest(F.lit(0.0), 1 - F.lit(lag) / (lags + 1))
        meat = meat + 2 * weight * F.col("psi") * F.coalesce(F.lag("psi", lag).over(order), F.lit(0.0))
    wide = F.coalesce((F.col("spread_ticks") > 1).cast("double"), F.lit(0.0))
    panel = rows.withColumn("meat", meat).groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("slope").alias("beta"),
        F.sum("own2").alias("own2"),
        F.sum("meat").alias("meat"),
        _r2_of_pair("x", least).alias("r2_flow"),
        _r2_with_square(least).alias("r2_quad"),
        _r2_of_pair("ti", least).alias("r2_ti"),
        _r2_of_pair("plc_p", least).alias("r2_plc_p5"),
        _r2_of_pair("plc_m", least).alias("r2_plc_m5"),
        F.avg("depth").alias("depth_mean"),
        F.avg(wide).alias("frac_spread_gt1"),
        F.max("events").alias("events"),
    )
    t_nw = F.try_divide(F.col("beta") * F.col("own2"), F.sqrt(F.when(F.col("meat") > 0, F.col("meat"))))
    panel = panel.where(F.col("n") >= least).withColumns({
        "t_nw": t_nw,
        "block": S.four_hour_block(F.col("window")),
        "weekend": S.is_weekend(F.col("day0")),
        "day": S.iso_day(F.col("day0")),
    })
    names = ["beta", "t_nw", "r2_flow", "n", "r2_quad", "r2_ti", "r2_plc_p5", "r2_plc_m5", "depth_mean", "frac_spread_gt1", "events", "block", "weekend", "day"]
    return panel.select(*keys, *names).dropna("any")

"""The results explorer's data, from reports and window tables alone, and the data behind the figures."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow import config as C
from tobflow.functions import scalars as S
from tobflow.operators import buckets as K
from tobflow.operators import depthfit, explore
from tobflow.plans import study
from tobflow.schema import SECOND
from tobflow.sources import market, reports

INTERVAL = "struct<lo:double,hi:double>"
SUMMARY = (
    "spec string, windows long, days long, frac_beta_pos double, n_beta_nonpos long, r2_flow_median double, r2_flow_q25 double, r2_flow_q75 double, "
    "r2_quad_median double, r2_ti_median double, placebo_m5_median double, placebo_p5_median double, h2_diff double, h4_diff double, "
    f"r2_ci {INTERVAL}, h2_ci {INTERVAL}, h4_ci {INTERVAL}, lam double, lam_ci {INTERVAL}, converged boolean, rho double, h1 string, h2 string, h3 string, h4 string"
)
EVALUATION = (
    f"model string, latency_ms double, oos_r2 double, oos_r2_ci {INTERVAL}, gross_bps_per_bucket double, break_even_bps double, "
    "net_bps_per_day double, turnover_per_day double, median_half_spread_bps double"
)
CANDIDATE = "symbol string, quote_volume_musd double, frac_spread_gt1 double, median_updates_per_s double, rows long, tick double, eligible boolean"


def _tables(path: Path) -> dict[str, list[list[dict[str, str]]]]:
    return reports.markdown_tables(path.read_text()) if path.exists() else {}


def _first(spark: SparkSession, tables: dict, heading: str, schema: str) -> DataFrame | None:
    found = next((t for name, all_ in tables.items() if name.startswith(heading) for t in all_), None)
    return None if found is None else reports.typed(spark, found, schema)


def summary(spark: SparkSession, paths: C.Paths, symbol: str) -> DataFrame | None:
    """The summary rows of a windows report, typed; None without a report."""
    return _first(spark, _tables(paths.reports() / study.SUMMARY_FILE.format(symbol)), "Summary", SUMMARY)


def validation(spark: SparkSession, paths: C.Paths, symbol: str) -> DataFrame | None:
    return _first(spark, _tables(paths.reports() / study.MODELS_FILE.format(symbol)), "Validation", EVALUATION)


def held_out(spark: SparkSession, paths: C.Paths, symbol: str) -> DataFrame | None:
    """A symbol's rows of the final test with its verdict."""
    tables = _tables(paths.reports() / study.TEST_FILE)
    heading = next((h for h in tables if h.startswith(f"{symbol}: ")), None)
    rows = _first(spark, tables, heading, EVALUATION) if heading else None
    return None if rows is None else rows.withColumn("verdict", F.lit(heading.rpartition(" ")[2]))


def selection(spark: SparkSession, paths: C.Paths) -> DataFrame | None:
    return _first(spark, _tables(paths.reports() / "selection.md"), "Candidates", CANDIDATE)


def windows(spark: SparkSession, paths: C.Paths, symbol: str) -> DataFrame | None:
    """The window table of the deciding specification."""
    path = study.windows_path(paths, symbol, C.SPECS[0][1])
    return market.read_windows(spark, path).withColumn("symbol", F.lit(symbol)) if Path(path).exists() else None


def _rows(df: DataFrame | None) -> list[dict] | None:
    return None if df is None else [r.asDict(recursive=True) for r in df.collect()]


def explored(panel: DataFrame) -> dict:
    """Per-day medians, each window's slope, depth and R2, the depth fit, and medians by spread quintile, of one symbol."""
    days = explore.day_summary(panel).drop("symbol", "events", "beta_pos").orderBy("day")
    points = panel.select("window", "beta", F.col("depth_mean").alias("depth"), F.col("r2_flow").alias("r2"), "day").orderBy("window").drop("window").toPandas()
    fit = depthfit.fit_panel(panel).select("a", "lam").first()
    parts = explore.quintile_medians(explore.quintiles(panel, "frac_spread_gt1", "window"), "r2_flow", "frac_spread_gt1").orderBy("quintile")
    by_part = parts.select(F.col("r2_flow_median").alias("r2"), F.col("frac_spread_gt1_median").alias("share")).toPandas()
    return {"per_day": _rows(days), "windows": points.to_dict("list"), "depth_fit": fit.asDict(), "spread_quintiles": by_part.to_dict("list")}


def predictive(spark: SparkSession, paths: C.Paths, symbol: str) -> dict | None:
    """Held-out, validation and walk-forward figures of a symbol; what has no report yet is left out."""
    out = {"held_out": _rows(held_out(spark, paths, symbol)), "validation": _rows(validation(spark, paths, symbol))}
    pooled = _first(spark, _tables(paths.reports() / study.MODELS_FILE.format(symbol)), "Walk-forward, pooled", "model string, latency_ms double, pooled_oos_r2 double")
    out["walk_forward"] = _rows(pooled)
    return {k: v for k, v in out.items() if v} or None


def export(spark: SparkSession, symbols: list[str], paths: C.Paths, split: C.Split) -> dict:
    """All sections of the explorer for the symbols that have results; the same results give the same data."""
    frozen = json.loads(paths.models().read_text()) if paths.models().exists() else {}
    panels = {s: windows(spark, paths, s) for s in symbols}
    return {
        "symbols": symbols,
        "sample": {"train": split.train, "validation": split.valid, "test": split.test},
        "fee_bps": frozen.get("fee_bps", C.FEE_BPS),
        "contemporaneous": {s: rows for s in symbols if (rows := _rows(summary(spark, paths, s)))},
        "predictive": {s: found for s in symbols if (found := predictive(spark, paths, s))},
        "explore": {s: explored(p) for s, p in panels.items() if p is not None},
        "selection": _rows(selection(spark, paths)) or [],
    }


# ---- data behind the figures


def example_window(grid: DataFrame, panel: DataFrame, freq_us: int, window_us: int) -> DataFrame:
    """symbol, t, flow and dmid_ticks of the buckets of each symbol's window whose R2 is closest to the median."""
    chosen = explore.closest_to_median(panel)
    rows = K.drop_funding(K.resample(grid, freq_us), freq_us).withColumn("window", S.floor_to(F.col("t"), window_us))
    return rows.join(F.broadcast(chosen), ["symbol", "window"]).select("symbol", "window", "t", "flow", "dmid_ticks")


def fitted_line(points: DataFrame) -> DataFrame:
    """symbol, slope and intercept of dmid_ticks on flow."""
    return points.groupBy("symbol").agg(F.regr_slope("dmid_ticks", "flow").alias("slope"), F.regr_intercept("dmid_ticks", "flow").alias("intercept"))


def depth_curve(panel: DataFrame, fits: DataFrame, points: int = 50) -> DataFrame:
    """symbol, depth and slope: a power law of the fitted exponent through the geometric means, over the 1 % to 99 % range of depth in equal ratios."""
    middle = panel.where("beta > 0").groupBy("symbol").agg(F.exp(F.avg(F.log("beta"))).alias("_beta"))
    span = explore.depth_summary(panel).join(middle, "symbol").join(fits.select("symbol", "lam"), "symbol")
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    rows = span.select("*", at.alias("_k"))
    depth = F.col("q01") * F.pow(F.col("q99") / F.col("q01"), F.col("_k") / (points - 1))
    return rows.select("symbol", depth.alias("depth"), (F.col("_beta") * F.pow(depth / F.col("geometric_mean"), -F.col("lam"))).alias("slope"))


def figures(spark: SparkSession, symbols: list[str], paths: C.Paths, split: C.Split) -> dict:
    """The four figures' data for the symbols that have grids, windows and reports."""
    name, freq_s, window_s = C.SPECS[0]
    out: dict = {}
    for symbol in symbols:
        panel = windows(spark, paths, symbol)
        if panel is None:
            continue
        days = sorted(d for s, d in market.committed(spark, paths.buckets()) if s == symbol)
        points = example_window(market.read_days(spark, paths.buckets(), symbol, days).drop("day", "tick"), panel, freq_s * SECOND, window_s * SECOND)
        fits = depthfit.fit_panel(panel)
        own = {"example": _rows(points.drop("symbol", "window").orderBy("t")), "line": _rows(fitted_line(points).drop("symbol"))}
        own["r2_over_time"] = _rows(explore.day_summary(panel).select("day", "r2", "r2_ti").orderBy("day"))
        own["depth"] = _rows(panel.select("depth_mean", "beta").orderBy("window"))
        own["depth_curve"] = _rows(depth_curve(panel, fits).drop("symbol").orderBy("depth"))
        framed = [d for d in split.in_sample if (symbol, d) in market.committed(spark, paths.frames())]
        if framed:
            same = explore.pooled_r2(market.read_days(spark, paths.frames(), symbol, framed), "x", "ar_lag").first().r2
            next_ = [r["oos_r2"] for r in _rows(held_out(spark, paths, symbol)) or [] if (r["model"], r["latency_ms"]) == study.MAIN]
            own["explain_or_predict"] = {"same_interval": same, "next_interval": next_[0] if next_ else None}
        out[symbol] = own
    return out

"""Ranks, quintiles, rank correlation, selection and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S


def quintiles(rows: DataFrame, value: str, *ties: str, keys: tuple[str, ...] = ("symbol",), parts: int = 5) -> DataFrame:
    """Adds quintile (0 to parts - 1): equal parts of the rank of value, cut at interpolated rank quantiles; ties in the order of ``ties``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value, *ties))
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.withColumn("_rank", rank).withColumn("_n", n)
    part = F.greatest(F.lit(0), F.ceil((F.col("_rank") - 1) * parts / F.greatest(F.lit(1), F.col("_n") - 1)) - 1)
    return ranked.withColumn("quintile", part.cast("int")).drop("_rank", "_n")


def quintile_medians(rows: DataFrame, *values: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return rows.groupBy(*keys, "quintile").agg(*[F.median(v).alias(f"{v}_median") for v in values], F.count("*").alias("n"))


def average_rank(column: str, keys: tuple[str, ...]) -> Column:
    """Rank, ties sharing the mean of their ranks."""
    order = Window.partitionBy(*keys).orderBy(column)
    same = Window.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, rho and n of the rank correlation over rows where both are known."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k, num in enumerate((m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
            if k and abs(d * c - 1) < 1e-15:
                return h
    return h


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation, by Student's t with n - 2 degrees of freedom."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    x = df / (df + rho * rho * df / (1 - rho * rho))
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def spearman_p_column(rho: str, n: str) -> Column:
    """spearman_p of two columns, for results of a row a group."""
    return F.udf(spearman_p, "double")(rho, n)


def day_summary(panel: DataFrame) -> DataFrame:
    """Per day of a window panel: events, windows, share of positive betas and medians."""
    medians = {"r2": "r2_flow", "r2_ti": "r2_ti", "depth": "depth_mean", "gt1": "frac_spread_gt1"}
    return panel.groupBy("symbol", "day").agg(
        F.max("events").alias("events"),
        F.count("*").alias("windows"),
        F.avg((F.col("beta") > 0).cast("double")).alias("beta_pos"),
        *[F.median(c).alias(name) for name, c in medians.items()],
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    """Per symbol: counts, share of positive betas, medians, quartiles and differences of medians."""
    medians = {"r2_flow_median": "r2_flow", "r2_quad_median": "r2_quad", "r2_ti_median": "r2_ti", "placebo_m5_median": "r2_plc_m5", "placebo_p5_median": "r2_plc_p5"}
    q = F.percentile("r2_flow", F.array(F.lit(0.25), F.lit(0.75)))
    out = panel.groupBy("symbol").agg(
        F.count("*").alias("windows"),
        F.countDistinct("day").alias("days"),
        F.avg((F.col("beta") > 0).cast("double")).alias("frac_beta_pos"),
        F.count_if(F.col("beta") <= 0).alias("n_beta_nonpos"),
        q[0].alias("r2_flow_q25"),
        q[1].alias("r2_flow_q75"),
        *[F.median(c).alias(name) for name, c in medians.items()],
    )
    return out.withColumns({"h2_diff": F.col("r2_quad_median") - F.col("r2_flow_median"), "h4_diff": F.col("r2_flow_median") - F.col("r2_ti_median")})


HYPOTHESES = ("h1", "h2", "h3", "h4")


def verdicts(summary: DataFrame) -> DataFrame:
    """Adds h1 to h4 to rows with frac_beta_pos, h2_diff, lam, lam_ci and h4_ci (structs lo, hi)."""
    rules = (
        F.col("frac_beta_pos") >= 0.95,
        F.col("h2_diff") < 0.02,
        F.col("lam").between(0.7, 1.3) & (F.col("lam_ci.hi") - F.col("lam_ci.lo") < 0.6),
        F.col("h4_ci.lo") > 0,
    )
    return summary.withColumns({h: S.passed(rule) for h, rule in zip(HYPOTHESES, rules, strict=True)})


def closest_to_median(panel: DataFrame, value: str = "r2_flow") -> DataFrame:
    """Per symbol the window whose value is closest to the median; the first of equals."""
    middle = panel.groupBy("symbol").agg(F.median(value).alias("median"))
    return panel.join(F.broadcast(middle), "symbol").groupBy("symbol").agg(F.min_by("window", F.struct(F.abs(F.col(value) - F.col("median")), "window")).alias("window"))


def depth_summary(panel: DataFrame) -> DataFrame:
    """Range, geometric mean and 1 % and 99 % quantiles of depth, for a fitted curve."""
    q = F.percentile("depth_mean", F.array(F.lit(0.01), F.lit(0.99)))
    return panel.groupBy("symbol").agg(F.min("depth_mean").alias("lo"), F.max("depth_mean").alias("hi"), F.exp(F.avg(F.log("depth_mean"))).alias("geometric_mean"), q[0].alias("q01"), q[1].alias("q99"))


def lower_quantile(rows: DataFrame, value: str, p: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys and q: the element at the floor of p * (n - 1) of the sorted values, without interpolation."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, rank.alias("_r"), n.alias("_n"))
    return ranked.where(F.col("_r") - 1 == F.floor(F.lit(p) * (F.col("_n") - 1))).select(*keys, F.col(value).alias("q"))


def pooled_r2(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Squared correlation over all rows."""
    return rows.groupBy(*keys).agg(F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"))


def universe(symbols: DataFrame, excluded: tuple[str, ...] = ("BTCUSDT", "ETHUSDT")) -> DataFrame:
    return symbols.where(F.col("symbol").rlike("^[A-Z0-9]+USDT$") & ~F.col("symbol").isin(*excluded))


def largest(symbols: DataFrame, n: int = 20) -> DataFrame:
    """The n symbols of largest quote volume; of equals, the last by name."""
    return symbols.where("quote_volume IS NOT NULL").orderBy(F.desc("quote_volume"), F.desc("symbol")).limit(n)


def selection(candidates: DataFrame, least_updates: float = 1.0, place: str | None = None) -> DataFrame:
    """candidates (symbol, quote_volume_musd, frac_spread_gt1, median_updates_per_s) with eligible, best first.

    ``place`` names a column for the row's place in that order; candidates are a handful (the largest symbols).
    """
    order = [F.desc("eligible"), F.desc("frac_spread_gt1"), F.desc("quote_volume_musd")]
    marked = candidates.withColumn("eligible", F.col("median_updates_per_s") >= least_updates)
    if place:
        marked = marked.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return marked.orderBy(*order)

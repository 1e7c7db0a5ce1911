"""Registered queries over the events table, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tobflow.config import BOOTSTRAP_DRAWS, FEE_BPS, WALK_FORWARD_DAYS
from tobflow.functions import scalars as S
from tobflow.operators import bootstrap as B
from tobflow.operators import buckets as K
from tobflow.operators import depthfit, explore, predict, quality, strategy
from tobflow.operators.events import event_flow, with_days, with_median_day
from tobflow.operators.regress import shifted, window_features, window_panel, window_regressions
from tobflow.operators import quality_fold as fold
from tobflow.plans import explorer, study
from tobflow.plans.fixture import BASE, COARSE, LATENCIES, TICK, WINDOW, book, streamed_book, trades
from tobflow.schema import DAY, HOUR, STREAM
from tobflow.sources.market import first_days
from tobflow.streaming.dense import dense_buckets
from tobflow.streaming.flow import stream_flow
from tobflow.streaming.run import drained, rocksdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLIT = ("2024-01-21", "2024-01-26")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats to so many decimals: sums in another order differ in the last bits. Adding 0 makes -0 plain 0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# ---- inputs

_BOOK = """book AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts, epoch_us(ts) + 3000 AS lts, bid AS bp, bid + 0.5 * CASE user_id % 6 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 1 END AS ap,
         round(value * 100) AS bs, CAST(1 + (event_id * 7919) % 1000 AS DOUBLE) AS az,
         CASE event_type WHEN 'purchase' THEN round(value * 100) WHEN 'signup' THEN -round(value * 100) ELSE 0 END AS signed
  FROM (SELECT *, CAST(0.5 AS DOUBLE) * (200 + floor(CAST(json_extract_string(props, '$.k') AS INT) / 10)) AS bid FROM events))"""
_FLOW = f"""{_BOOK},
fl AS (
  SELECT *, CASE WHEN lag(seq) OVER w IS NOT NULL THEN
    CASE WHEN bp >= lag(bp) OVER w THEN bs ELSE 0 END - CASE WHEN bp <= lag(bp) OVER w THEN lag(bs) OVER w ELSE 0 END
    - CASE WHEN ap <= lag(ap) OVER w THEN az ELSE 0 END + CASE WHEN ap >= lag(ap) OVER w THEN lag(az) OVER w ELSE 0 END END AS flow
  FROM book WINDOW w AS (ORDER BY seq))"""


def _grid(freq: int, clock: str = "ts", name: str = "grid") -> str:
    """Day grid {name} of freq microseconds: day0, t, flow, n_events, mid, depth, spread_ticks, dmid_ticks, ti."""
    return f"""{_FLOW},
{name}_agg AS (
  SELECT {clock} // {freq} * {freq} AS t, sum(flow) AS flow, count(*) AS n, last((bp + ap) / 2 ORDER BY seq) AS mid, last((bs + az) / 2 ORDER BY seq) AS depth,
         last(ap - bp ORDER BY seq) AS spread, sum(signed) AS ti
  FROM fl GROUP BY 1),
{name}_days AS (SELECT DISTINCT {clock} // {DAY} * {DAY} AS day0 FROM fl),
{name}_all AS (SELECT day0, day0 + i * {freq} AS t FROM (SELECT day0, unnest(range({DAY // freq})) AS i FROM {name}_days)),
{name}_filled AS (
  SELECT day0, t, coalesce(flow, 0) AS flow, coalesce(n, 0) AS n_events, coalesce(ti, 0) AS ti,
         last_value(mid IGNORE NULLS) OVER w AS mid, last_value(depth IGNORE NULLS) OVER w AS depth, last_value(spread IGNORE NULLS) OVER w AS spread
  FROM {name}_all LEFT JOIN {name}_agg USING (t) WINDOW w AS (ORDER BY t)),
{name} AS (
  SELECT day0, t, flow, n_events, ti, mid, depth, round_even(spread / {TICK}, 9) AS spread_ticks,
         round_even((mid - lag(mid) OVER (ORDER BY t)) / {TICK}, 9) AS dmid_ticks FROM {name}_filled)"""


def _funding(start: str, end: str) -> str:
    p, m = 8 * HOUR, 120_000_000
    return f"({start} % {p} < {m} OR {start} % {p} + ({end} - {start}) > {p - m})"


_COARSE = f"""{_grid(BASE)},
coarse_all AS (
  SELECT day0, t // {COARSE} * {COARSE} AS t, sum(flow) AS flow, sum(n_events) AS n_events, sum(ti) AS ti, round_even(coalesce(sum(dmid_ticks), 0), 9) AS dmid_ticks,
         last(depth ORDER BY t) AS depth, last(spread_ticks ORDER BY t) AS spread_ticks, last(mid ORDER BY t) AS mid
  FROM (SELECT day0, t AS t, flow, n_events, ti, dmid_ticks, depth, spread_ticks, mid FROM grid) GROUP BY day0, t // {COARSE} * {COARSE}),
coarse AS (SELECT * FROM coarse_all WHERE NOT {_funding('t', f't + {COARSE}')})"""


def base(spark: SparkSession, sf_dir: str, clock: str = "timestamp") -> DataFrame:
    grid = K.bucketize(with_days(book(spark, sf_dir), clock), BASE, TICK, clock)
    return K.with_imbalance(grid, trades(spark, sf_dir, clock), BASE, clock)


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.drop_funding(K.resample(base(spark, sf_dir), COARSE), COARSE)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_panel(base(spark, sf_dir), COARSE, WINDOW)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.predictive_frame(base(spark, sf_dir, "local_timestamp"), TICK, BASE, COARSE, LATENCIES)


def rows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.long_frame(frame(spark, sf_dir), LATENCIES)


# ---- buckets


@query(f"WITH {_FLOW} SELECT seq, flow FROM fl")
def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_flow(with_days(book(spark, sf_dir)))
    return rows.where(S.day_start(F.col("timestamp")) == F.col("day0")).select("seq", "flow")


@query(f"WITH {_FLOW} SELECT ts // {COARSE} * {COARSE} AS t, coalesce(sum(flow), 0) AS flow, count(*) AS n_events FROM fl GROUP BY 1")
def bucket_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.bucket_flow(with_days(book(spark, sf_dir)), COARSE)
    return out.select((F.col("day0") + F.col("k") * COARSE).alias("t"), "flow", "n_events")


@query(f"WITH {_grid(COARSE)} SELECT day0, t, flow, dmid_ticks, depth, spread_ticks, n_events, mid FROM grid")
def bucket_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bucketize(with_days(book(spark, sf_dir)), COARSE, TICK).drop("symbol")


@query(f"WITH {_COARSE} SELECT t, flow, CAST(n_events AS BIGINT) AS n_events, ti, dmid_ticks, depth, spread_ticks, mid FROM coarse_all")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.resample(base(spark, sf_dir), COARSE).drop(*STREAM)


@query(f"WITH {_grid(BASE)} SELECT t, ti FROM grid")
def trade_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.trade_imbalance(trades(spark, sf_dir), BASE).select("t", "ti")


@query(f"WITH {_COARSE} SELECT t, flow FROM coarse")
def funding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse(spark, sf_dir).select("t", "flow")


# ---- regressions


def _fit(x: str, source: str, name: str, y: str = "dmid_ticks") -> str:
    return f"""{name} AS (
  SELECT t // {WINDOW} * {WINDOW} AS "window", regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS beta, regr_intercept({y}, {x}) AS alpha,
         CASE WHEN regr_syy({y}, {x}) > 0 THEN regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / (regr_sxx({y}, {x}) * regr_syy({y}, {x})) END AS r2
  FROM {source} GROUP BY 1 HAVING regr_count({y}, {x}) >= 30 AND regr_sxx({y}, {x}) > 0)"""


@query(f"""WITH {_COARSE}, {_fit('flow', 'coarse', 'ols')} SELECT "window", round(alpha, 6) + 0 AS alpha, round(beta, 6) + 0 AS beta, round(r2, 6) AS r2, n FROM ols""")
def window_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_regressions(coarse(spark, sf_dir), WINDOW).select("window", "alpha", "beta", "r2", "n"))


_QUAD = f"""sums AS (
  SELECT t // {WINDOW} * {WINDOW} AS "window", var_pop(flow) AS xx, var_pop(flow * abs(flow)) AS zz, covar_pop(flow, flow * abs(flow)) AS xz,
         covar_pop(dmid_ticks, flow) AS xy, covar_pop(dmid_ticks, flow * abs(flow)) AS zy, var_pop(dmid_ticks) AS yy, count(*) AS n
  FROM coarse WHERE dmid_ticks IS NOT NULL GROUP BY 1 HAVING count(*) >= 30 AND var_pop(flow) > 0),
quad AS (
  SELECT "window", n, ((xy * zz - zy * xz) * xy + (zy * xx - xy * xz) * zy) / (xx * zz - xz * xz) / yy AS r2 FROM sums WHERE yy > 0)"""


@query(f"""WITH {_COARSE}, {_QUAD} SELECT "window", round(r2, 6) AS r2, n FROM quad""")
def window_ols_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coarse(spark, sf_dir).withColumn("flow_abs", F.col("flow") * F.abs("flow"))
    return rounded(window_regressions(rows, WINDOW, z="flow_abs").where("r2 IS NOT NULL").select("window", "r2", "n"))


_PLACEBO = f"""moved AS (
  SELECT a.t, a.dmid_ticks, p.flow AS plc_p, m.flow AS plc_m FROM coarse a
  LEFT JOIN coarse p ON p.t = a.t - {5 * COARSE} AND p.day0 = a.day0 LEFT JOIN coarse m ON m.t = a.t + {5 * COARSE} AND m.day0 = a.day0)"""


@query(f"""WITH {_COARSE}, {_PLACEBO}, {_fit('plc_p', 'moved', 'p')}, {_fit('plc_m', 'moved', 'm')}
SELECT 'p5' AS side, "window", round(beta, 6) + 0 AS beta, round(r2, 6) AS r2, n FROM p UNION ALL SELECT 'm5', "window", round(beta, 6) + 0, round(r2, 6), n FROM m""")
def window_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coarse(spark, sf_dir)
    out = None
    for side, sign in (("p5", 5), ("m5", -5)):
        one = window_regressions(rows, WINDOW, shift_us=sign * COARSE).select(F.lit(side).alias("side"), "window", "beta", "r2", "n")
        out = one if out is None else out.union(one)
    return rounded(out)


_HAC_LAGS = "least(floor(4 * power(n / 100.0, 2.0 / 9.0)), 8)"
_HAC = f"""{_fit('flow', 'coarse', 'ols')},
res AS (
  SELECT c.t, o."window", o.n, o.beta, c.flow - avg(c.flow) OVER (PARTITION BY o."window") AS own,
         c.dmid_ticks - o.alpha - o.beta * c.flow AS u
  FROM coarse c JOIN ols o ON c.t // {WINDOW} * {WINDOW} = o."window" WHERE c.dmid_ticks IS NOT NULL),
psi AS (SELECT *, own * u AS psi, {_HAC_LAGS} AS l FROM res),
lagged AS (
  SELECT *, {', '.join(f'coalesce(lag(psi, {i}) OVER w, 0) AS p{i}' for i in range(1, 9))} FROM psi WINDOW w AS (PARTITION BY "window" ORDER BY t)),
hac AS (
  SELECT "window", any_value(beta) * sum(own * own) / sqrt(sum(psi * psi + 2 * psi * ({' + '.join(f'greatest(0, 1 - {i} / (l + 1)) * p{i}' for i in range(1, 9))}))) AS t_nw
  FROM lagged GROUP BY "window")"""


@query(f"""WITH {_COARSE}, {_HAC} SELECT "window", round(t_nw, 5) AS t_nw FROM hac""")
def window_hac_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_regressions(coarse(spark, sf_dir), WINDOW).select("window", "t_nw"), 5)


_FEATURES = f"""feats AS (
  SELECT t // {WINDOW} * {WINDOW} AS "window", avg(depth) AS depth_mean, avg(CASE WHEN spread_ticks > 1 THEN 1.0 ELSE 0.0 END) AS frac_spread_gt1 FROM coarse GROUP BY 1)"""


@query(f"""WITH {_COARSE}, {_FEATURES} SELECT "window", round(depth_mean, 6) AS depth_mean, round(frac_spread_gt1, 6) AS frac_spread_gt1 FROM feats""")
def window_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(window_features(coarse(spark, sf_dir), WINDOW).drop(*STREAM))


_PANEL = f"""{_COARSE}, {_HAC}, {_QUAD}, {_PLACEBO}, {_FEATURES},
{_fit('ti', 'coarse', 'fti')}, {_fit('plc_p', 'moved', 'fp')}, {_fit('plc_m', 'moved', 'fm')},
evts AS (SELECT day0, CAST(sum(n_events) AS BIGINT) AS events FROM grid GROUP BY day0),
panel AS (
  SELECT o."window", o.beta, h.t_nw, o.r2 AS r2_flow, o.n, q.r2 AS r2_quad, i.r2 AS r2_ti, p.r2 AS r2_plc_p5, m.r2 AS r2_plc_m5, f.depth_mean, f.frac_spread_gt1,
         o."window" // {HOUR} % 24 // 4 AS block, CASE WHEN dayofweek(make_timestamp(o."window")) IN (0, 6) THEN 1 ELSE 0 END AS weekend,
         strftime(make_timestamp(o."window"), '%Y-%m-%d') AS day, e.events
  FROM ols o JOIN hac h USING ("window") JOIN quad q USING ("window") JOIN fti i USING ("window") JOIN fp p USING ("window") JOIN fm m USING ("window")
  JOIN feats f USING ("window") JOIN evts e ON e.day0 = o."window" // {DAY} * {DAY}
  WHERE o.r2 IS NOT NULL AND h.t_nw IS NOT NULL AND q.r2 IS NOT NULL AND i.r2 IS NOT NULL AND p.r2 IS NOT NULL AND m.r2 IS NOT NULL)"""


@query(f"""WITH {_PANEL} SELECT "window", round(beta, 6) + 0 AS beta, round(t_nw, 5) AS t_nw, round(r2_flow, 6) AS r2_flow, n, round(r2_quad, 6) AS r2_quad, round(r2_ti, 6) AS r2_ti,
  round(r2_plc_p5, 6) AS r2_plc_p5, round(r2_plc_m5, 6) AS r2_plc_m5, round(depth_mean, 6) AS depth_mean, round(frac_spread_gt1, 6) AS frac_spread_gt1,
  CAST(block AS INT) AS block, CAST(weekend AS INT) AS weekend, day, events FROM panel""")
def windows_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = panel(spark, sf_dir).drop(*STREAM)
    return rounded(out.withColumn("t_nw", F.round("t_nw", 5)))


# ---- summaries of the panel


@query(f"""WITH {_PANEL} SELECT day, events, count(*) AS windows, round(avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END), 6) AS beta_pos, round(median(r2_flow), 6) AS r2,
  round(median(r2_ti), 6) AS r2_ti, round(median(depth_mean), 6) AS depth, round(median(frac_spread_gt1), 6) AS gt1 FROM panel GROUP BY day, events""")
def day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.day_summary(panel(spark, sf_dir)).drop("symbol"))


@query(f"""WITH {_PANEL} SELECT count(*) AS windows, count(DISTINCT day) AS days, round(avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_beta_pos,
  count(*) FILTER (WHERE beta <= 0) AS n_beta_nonpos, round(median(r2_flow), 6) AS r2_flow_median, round(quantile_cont(r2_flow, 0.25), 6) AS r2_flow_q25,
  round(quantile_cont(r2_flow, 0.75), 6) AS r2_flow_q75, round(median(r2_quad), 6) AS r2_quad_median, round(median(r2_ti), 6) AS r2_ti_median,
  round(median(r2_plc_m5), 6) AS placebo_m5_median, round(median(r2_plc_p5), 6) AS placebo_p5_median, round(median(r2_quad) - median(r2_flow), 6) AS h2_diff,
  round(median(r2_flow) - median(r2_ti), 6) AS h4_diff FROM panel HAVING count(*) > 0""")
def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.panel_summary(panel(spark, sf_dir)).drop("symbol"))


@query(f"""WITH {_PANEL}, r AS (SELECT *, row_number() OVER (ORDER BY round(frac_spread_gt1, 9), "window") AS rn, count(*) OVER () AS n_all FROM panel)
SELECT CAST(greatest(0, ceil((rn - 1) * 5 / greatest(1, n_all - 1)) - 1) AS INT) AS quintile, round(median(r2_flow), 6) AS r2_flow_median,
  round(median(frac_spread_gt1), 6) AS frac_spread_gt1_median, count(*) AS n FROM r GROUP BY 1""")
def spread_quintiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumn("_key", F.round("frac_spread_gt1", 9))
    cut = explore.quintiles(rows, "_key", "window")
    return rounded(explore.quintile_medians(cut, "r2_flow", "frac_spread_gt1").drop("symbol"))


@query(f"""WITH {_PANEL}, k AS (SELECT round(r2_flow, 9) AS x, round(frac_spread_gt1, 9) AS y FROM panel),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM k)
SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r HAVING count(*) > 0""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumns({"r2_flow": F.round("r2_flow", 9), "frac_spread_gt1": F.round("frac_spread_gt1", 9)})
    return rounded(explore.spearman(rows, "r2_flow", "frac_spread_gt1").drop("symbol"))


@query(f"""WITH {_PANEL} SELECT min("window") AS "window" FROM panel WHERE round(abs(r2_flow - (SELECT median(r2_flow) FROM panel)), 9) =
  (SELECT min(round(abs(r2_flow - (SELECT median(r2_flow) FROM panel)), 9)) FROM panel) HAVING count(*) > 0""")
def example_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.closest_to_median(panel(spark, sf_dir).withColumn("r2_flow", F.round("r2_flow", 9))).select("window")


@query(f"""WITH {_PANEL} SELECT round(min(depth_mean), 6) AS lo, round(max(depth_mean), 6) AS hi, round(exp(avg(ln(depth_mean))), 6) AS geometric_mean,
  round(quantile_cont(depth_mean, 0.01), 6) AS q01, round(quantile_cont(depth_mean, 0.99), 6) AS q99 FROM panel HAVING count(*) > 0""")
def depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.depth_summary(panel(spark, sf_dir)).drop("symbol"))


@query(f"""WITH {_PANEL}, r AS (SELECT depth_mean, row_number() OVER (ORDER BY depth_mean) AS rn, count(*) OVER () AS n_all FROM panel)
SELECT round(depth_mean, 6) AS q FROM r WHERE rn - 1 = floor(0.25 * (n_all - 1))""")
def lower_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.lower_quantile(panel(spark, sf_dir), "depth_mean", 0.25).drop("symbol"))


@query()
def depth_nls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coefficient of the nonlinear fit; its optimality is the query depth_gradient."""
    return depthfit.fit_panel(panel(spark, sf_dir)).drop("symbol")


@query(f"""WITH {_PANEL} SELECT unnest(['a', 'lam', 'weekend', 'blk_1', 'blk_2', 'blk_3', 'blk_4', 'blk_5']) AS parameter,
  unnest([true, true, stddev_pop(weekend) > 0, {', '.join(f"stddev_pop(CASE WHEN block = {j} THEN 1 ELSE 0 END) > 0" for j in range(1, 6))}]) AS optimal FROM panel HAVING count(*) > 0""")
def depth_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the loss is flat at the fit in each parameter; false for a control that is constant and so left out."""
    rows = panel(spark, sf_dir)
    slopes = depthfit.gradient(rows, depthfit.fit_panel(rows))
    names = ["a", "lam", *depthfit.CONTROLS]
    pairs = F.array(*[F.struct(F.lit(c).alias("parameter"), F.coalesce(F.abs(c) < 1e-4, F.lit(False)).alias("optimal")) for c in names])
    return slopes.select(F.inline(pairs))


@query(f"""WITH {_PANEL} SELECT "window", {', '.join(f'CAST(CASE WHEN block = {j} THEN 1 ELSE 0 END AS DOUBLE) AS blk_{j}' for j in range(1, 6))}, CAST(weekend AS DOUBLE) AS weekend FROM panel""")
def depth_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depthfit.controls(panel(spark, sf_dir)).select("window", *depthfit.CONTROLS)


def _draws(blocks: int) -> str:
    """CTE mult (draw, i, m): the multiplicity of block i in each draw, one digit each, for so many blocks."""
    table = B.multiplicities(blocks)
    digits = "".join(map(str, table.ravel().tolist()))
    if len(digits) != table.size:
        raise ValueError("a block is drawn more than nine times")
    return f"""mult AS (
  SELECT draw, i, CAST(substr(s, draw * {blocks} + i + 1, 1) AS BIGINT) AS m
  FROM (SELECT '{digits}' AS s), (SELECT unnest(range({len(table)})) AS draw), (SELECT unnest(range({blocks})) AS i))"""


@query(f"""WITH {_PANEL}, {_draws(30)},
days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM panel)),
reps AS (SELECT draw, r2_flow, r2_ti FROM (SELECT draw, i, unnest(range(m)) FROM mult) JOIN days USING (i) JOIN panel USING (day)),
draws AS (SELECT draw, median(r2_flow) AS r2, median(r2_flow) - median(r2_ti) AS h4 FROM reps GROUP BY draw)
SELECT round(quantile_cont(r2, 0.025), 6) AS lo, round(quantile_cont(r2, 0.975), 6) AS hi, round(quantile_cont(h4, 0.025), 6) AS h4_lo, round(quantile_cont(h4, 0.975), 6) AS h4_hi
FROM draws HAVING count(*) > 0""")
def bootstrap_median_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws of the study over the days of the panel."""
    statistics = {"r2": B.Median("r2_flow"), "h4": B.Difference(B.Median("r2_flow"), B.Median("r2_ti"))}
    draws = B.bootstrap(panel(spark, sf_dir), "day", statistics, keys=["symbol"], columns=["r2_flow", "r2_ti"], order="window")
    ci = B.percentile_ci(draws, "r2", "h4", keys=["symbol"])
    return rounded(ci.select("r2.lo", "r2.hi", F.col("h4.lo").alias("h4_lo"), F.col("h4.hi").alias("h4_hi")))


@query(f"""WITH {_PANEL} SELECT CASE WHEN avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS h1,
  CASE WHEN median(r2_quad) - median(r2_flow) < 0.02 THEN 'PASS' ELSE 'FAIL' END AS h2 FROM panel HAVING count(*) > 0""")
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts that need no interval."""
    nothing = F.struct(F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    summary = explore.panel_summary(panel(spark, sf_dir)).withColumns({"lam": F.lit(None).cast("double"), "lam_ci": nothing, "h4_ci": nothing})
    return explore.verdicts(summary).select("h1", "h2")


@query(f"""WITH {_COARSE}, {_HAC}, {_PLACEBO}, {_fit('plc_p', 'moved', 'fp')}, {_fit('plc_m', 'moved', 'fm')},
w AS (SELECT strftime(make_timestamp(o."window"), '%Y-%m-%d') AS day, o.beta, o.r2, h.t_nw, p.r2 AS r2_p5, m.r2 AS r2_m5
      FROM ols o LEFT JOIN hac h USING ("window") LEFT JOIN fp p USING ("window") LEFT JOIN fm m USING ("window")),
u AS (SELECT * FROM w UNION ALL SELECT 'pooled', beta, r2, t_nw, r2_p5, r2_m5 FROM w)
SELECT day, count(*) AS windows, round(avg(CASE WHEN beta > 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_beta_pos, count(*) FILTER (WHERE beta <= 0) AS n_beta_nonpos,
  round(median(r2), 6) AS r2_median, round(median(t_nw), 5) AS t_nw_median, round(median(r2_m5), 6) AS r2_m5_median, round(median(r2_p5), 6) AS r2_p5_median,
  round(quantile_cont(r2, 0.25), 6) AS r2_q25, round(quantile_cont(r2, 0.75), 6) AS r2_q75 FROM u GROUP BY day""")
def pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot's summary of each day and of all days."""
    grid = K.resample(base(spark, sf_dir), COARSE)
    windows = study.pilot_windows(grid, COARSE, WINDOW).withColumn("day", S.iso_day(F.col("day0")))
    out = study.pilot_summary(windows, "day").unionByName(study.pilot_summary(windows.withColumn("day", F.lit("pooled")), "day"))
    return rounded(out.withColumn("t_nw_median", F.round("t_nw_median", 5)))


@query(f"""WITH {_PANEL}, best AS (SELECT min("window") AS "window" FROM panel WHERE round(abs(r2_flow - (SELECT median(r2_flow) FROM panel)), 9) =
  (SELECT min(round(abs(r2_flow - (SELECT median(r2_flow) FROM panel)), 9)) FROM panel))
SELECT t, flow, dmid_ticks, round(regr_slope(dmid_ticks, flow) OVER (), 6) + 0 AS slope FROM coarse JOIN best ON t // {WINDOW} * {WINDOW} = "window" WHERE dmid_ticks IS NOT NULL""")
def example_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of the window closest to the median, with the slope of their line."""
    grid = base(spark, sf_dir).persist()
    rows = window_panel(grid, COARSE, WINDOW).withColumn("r2_flow", F.round("r2_flow", 9))
    points = explorer.example_window(grid, rows, COARSE, WINDOW)
    line = explorer.fitted_line(points).select("symbol", F.round("slope", 6).alias("slope"))
    return points.where("dmid_ticks IS NOT NULL").join(line, "symbol").select("t", "flow", "dmid_ticks", (F.col("slope") + 0).alias("slope"))


@query(f"""WITH {_PANEL}, s AS (SELECT quantile_cont(depth_mean, 0.01) AS lo, quantile_cont(depth_mean, 0.99) AS hi, exp(avg(ln(depth_mean))) AS mid,
  exp(avg(ln(CASE WHEN beta > 0 THEN beta END))) AS b FROM panel)
SELECT k, round(lo * power(hi / lo, k / 9.0), 6) AS depth, round(b * power(lo * power(hi / lo, k / 9.0) / mid, -1.0), 6) AS slope FROM s, (SELECT unnest(range(10)) AS k)""")
def depth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten points of the power law of exponent 1 through the geometric means."""
    rows = panel(spark, sf_dir)
    out = explorer.depth_curve(rows, rows.select("symbol").distinct().withColumn("lam", F.lit(1.0)), 10)
    return rounded(out.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("depth")).cast("long") - 1).drop("symbol"))


# ---- quality


@query(f"""WITH {_BOOK}, b AS (SELECT *, ts // {DAY} * {DAY} AS day0 FROM book),
l AS (SELECT *, lag(ts) OVER w AS pts, lag(lts) OVER w AS plts, bp = lag(bp) OVER w AND ap = lag(ap) OVER w AND bs = lag(bs) OVER w AND az = lag(az) OVER w AND ts = lag(ts) OVER w AND lts = lag(lts) OVER w AS dup
      FROM b WINDOW w AS (PARTITION BY day0 ORDER BY seq)),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY day0 ORDER BY ts) AS gap, CAST(round_even((ap - bp) / {TICK}, 0) AS INT) AS spread,
        bp IS NOT NULL AND ap IS NOT NULL AND bs IS NOT NULL AND az IS NOT NULL AS ok FROM l),
p AS (SELECT DISTINCT day0, unnest([bp, ap]) AS price FROM g WHERE ok),
pg AS (SELECT day0, price - lag(price) OVER (PARTITION BY day0 ORDER BY price) AS step FROM p),
tick AS (SELECT day0, round(min(step), 10) AS inferred_tick FROM pg GROUP BY day0)
SELECT day0, count(*) AS "rows", count(*) FILTER (WHERE NOT ok) AS rows_with_nan, count(*) FILTER (WHERE dup) AS duplicate_rows, count(*) FILTER (WHERE ts < pts) AS ts_backwards,
  count(*) FILTER (WHERE lts < plts) AS local_ts_backwards, count(*) FILTER (WHERE ok AND bp >= ap) AS crossed_or_locked,
  count(*) FILTER (WHERE ok AND NOT (abs(bp / {TICK} - round_even(bp / {TICK}, 0)) < 1e-6 AND abs(ap / {TICK} - round_even(ap / {TICK}, 0)) < 1e-6)) AS off_grid_rows,
  any_value(inferred_tick) AS inferred_tick,
  CAST(floor(quantile_cont(spread, 0.5)) AS INT) AS spread_p50, CAST(floor(quantile_cont(spread, 0.99)) AS INT) AS spread_p99, max(spread) AS spread_max,
  round(avg(CASE WHEN spread = 1 THEN 1.0 ELSE 0.0 END), 6) AS frac_spread_1tick, round(quantile_cont((lts - ts) / 1000, 0.5), 6) AS recv_delay_ms_p50,
  round(quantile_cont((lts - ts) / 1000, 0.99), 6) AS recv_delay_ms_p99, round(avg(CASE WHEN lts < ts THEN 1.0 ELSE 0.0 END), 6) AS frac_recv_delay_negative,
  round(coalesce(max(gap), 0) / 1000000, 6) AS max_gap_s FROM g JOIN tick USING (day0) GROUP BY day0""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir).withColumn("day0", S.day_start(F.col("timestamp")))
    spread = F.col("spread_ticks_p50_p99_max")
    out = quality.quality_report(rows, TICK).withColumns({"spread_p50": spread[0], "spread_p99": spread[1], "spread_max": spread[2]})
    return rounded(out.drop("symbol", "spread_ticks_p50_p99_max", "rows_per_hour"))


@query(ORACLES["quality_report"])
def quality_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report from merged states of chunks of 100 updates."""
    rows = book(spark, sf_dir).withColumns({"day0": S.day_start(F.col("timestamp")), "chunk": F.floor(F.col("seq") / 100)})
    spread = F.col("spread_ticks_p50_p99_max")
    out = fold.merged_report(fold.chunk_states(rows, TICK, "chunk"), "chunk").withColumns({"spread_p50": spread[0], "spread_p99": spread[1], "spread_max": spread[2]})
    return rounded(out.drop("symbol", "spread_ticks_p50_p99_max", "rows_per_hour"))


@query(f"""WITH {_BOOK}, b AS (SELECT ts // {DAY} * {DAY} AS day0, abs(bp / 1.0 - round_even(bp / 1.0, 0)) < 1e-6 AND abs(ap / 1.0 - round_even(ap / 1.0, 0)) < 1e-6 AS ok FROM book)
SELECT day0, count(*) AS "rows", count(*) FILTER (WHERE NOT ok) AS off_grid_rows FROM b GROUP BY day0 HAVING count(*) FILTER (WHERE NOT ok) > {quality.OFF_GRID_SHARE} * count(*)""")
def off_grid_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that the gate refuses for a tick of 1."""
    rows = book(spark, sf_dir).withColumn("day0", S.day_start(F.col("timestamp")))
    return quality.refused(quality.value_report(rows, 1.0)).select("day0", "rows", "off_grid_rows")


@query(f"""WITH {_BOOK}, m AS (SELECT e.event_type AS source, b.ts, b.lts FROM book b JOIN events e ON e.event_id = b.seq)
SELECT source, CAST(median(ts) AS BIGINT) // {DAY} * {DAY} AS day0, count(*) AS "rows" FROM m GROUP BY source""")
def median_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each group of rows by its median time, rows of other days staying with their group."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("event_type").alias("source"))
    rows = with_median_day(book(spark, sf_dir).join(kinds, "seq"), ["source"])
    return rows.groupBy("source", "day0").agg(F.count("*").alias("rows"))


@query(f"""WITH {_BOOK}, b AS (SELECT ts // {DAY} * {DAY} AS day0, ts // {HOUR} % 24 AS hour FROM book),
c AS (SELECT day0, hour, count(*) AS n FROM b GROUP BY ALL), g AS (SELECT day0, unnest(range(24)) AS hour FROM (SELECT DISTINCT day0 FROM b))
SELECT day0, CAST(hour AS INT) AS hour, coalesce(n, 0) AS "rows" FROM g LEFT JOIN c USING (day0, hour)""")
def rows_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir).withColumn("day0", S.day_start(F.col("timestamp")))
    return quality.rows_per_hour(rows).drop("symbol")


@query(f"""WITH {_BOOK}, p AS (SELECT bp AS p FROM book UNION ALL SELECT ap FROM book),
c(tick) AS (VALUES {', '.join(f'(CAST({t!r} AS DOUBLE))' for t in quality.TICKS)})
SELECT round(max(tick), 12) AS tick FROM (SELECT tick FROM c, p GROUP BY tick HAVING tick <= min(p) AND avg(CASE WHEN abs(p / tick - round_even(p / tick, 0)) < 1e-6 THEN 1.0 ELSE 0.0 END) >= 0.9999)""")
def infer_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book(spark, sf_dir)
    return quality.infer_tick(rows.select("symbol", F.explode(F.array("bid_price", "ask_price")).alias("price"))).drop("symbol")


@query(f"""WITH {_grid(COARSE)} SELECT day0, round(avg(CASE WHEN n_events = 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_empty, round(avg(CASE WHEN dmid_ticks = 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_dmid_zero,
  round(avg(CASE WHEN spread_ticks > 1 THEN 1.0 ELSE 0.0 END), 6) AS frac_spread_gt1 FROM grid GROUP BY day0""")
def bucket_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.bucket_shares(K.bucketize(with_days(book(spark, sf_dir)), COARSE, TICK)).drop("symbol"))


@query("""WITH s AS (SELECT upper(event_type) || (user_id % 40) || CASE WHEN user_id % 5 = 0 THEN 'EUR' ELSE 'USDT' END AS symbol, value FROM events),
v AS (SELECT symbol, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 2) AS quote_volume FROM s WHERE regexp_full_match(symbol, '[A-Z0-9]+USDT') GROUP BY symbol)
SELECT symbol, quote_volume FROM v ORDER BY quote_volume DESC, symbol DESC LIMIT 20""")
def symbol_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.concat(F.upper("event_type"), (F.col("user_id") % 40).cast("string"), F.when(F.col("user_id") % 5 == 0, "EUR").otherwise("USDT"))
    volumes = e.groupBy(symbol.alias("symbol")).agg(F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("quote_volume"))
    return explore.largest(explore.universe(volumes))


_CANDIDATES = """u AS (SELECT upper(event_type) || (user_id % 12) || 'USDT' AS symbol, value, epoch_us(ts) // 60000000 AS minute FROM events),
f AS (SELECT symbol, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 2) AS DOUBLE) / 1e6 AS quote_volume_musd, count(*) AS n,
        avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS frac_spread_gt1, CAST(count(*) AS DOUBLE) / count(DISTINCT minute) AS median_updates_per_s FROM u GROUP BY symbol)"""


@query(f"""WITH {_CANDIDATES} SELECT symbol, round(quote_volume_musd, 9) AS quote_volume_musd, round(frac_spread_gt1, 9) AS frac_spread_gt1, round(median_updates_per_s, 9) AS median_updates_per_s,
  median_updates_per_s >= 1.01 AS eligible, row_number() OVER (ORDER BY median_updates_per_s >= 1.01 DESC, round(frac_spread_gt1, 9) DESC, round(quote_volume_musd, 9) DESC) AS place FROM f""")
def symbol_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of the selection rule."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.concat(F.upper("event_type"), (F.col("user_id") % 12).cast("string"), F.lit("USDT"))
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (60 * 1_000_000))
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    rows = e.groupBy(symbol.alias("symbol")).agg(
        F.round(F.round(cents / 100, 2) / 1e6, 9).alias("quote_volume_musd"),
        F.round(F.avg((F.col("value") > 50).cast("double")), 9).alias("frac_spread_gt1"),
        F.round(F.count("*") / F.countDistinct(minute), 9).alias("median_updates_per_s"),
    )
    return explore.selection(rows, 1.01, place="place")


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT min(day) AS lo, max(day) AS hi FROM d)
SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS day FROM r, range(date_trunc('month', lo), CAST(hi AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 MONTH) t(m) WHERE CAST(m AS DATE) >= lo""")
def month_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of every month within the closed range of days of the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return first_days(e.agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end")))


# ---- prediction

_FRAME = f"""{_grid(BASE, 'lts', 'fine')},
wide AS (
  SELECT day0, t, (SELECT NULL) AS z,
    sum(flow) OVER (PARTITION BY day0 ORDER BY t RANGE BETWEEN {COARSE} PRECEDING AND 1 PRECEDING) AS x, sum(ti) OVER (PARTITION BY day0 ORDER BY t RANGE BETWEEN {COARSE} PRECEDING AND 1 PRECEDING) AS ti_lag,
    lag(mid, 1) OVER w AS m0, lag(mid, {1 + COARSE // BASE}) OVER w AS m1, lag(depth, 1) OVER w AS depth_t,
    {', '.join(f"lead(mid, {lat // BASE - 1 + COARSE // BASE}) OVER w AS a{lat // BASE}, " + (f"lead(mid, {lat // BASE - 1}) OVER w AS e{lat // BASE}, lead(spread_ticks, {lat // BASE - 1}) OVER w AS s{lat // BASE}" if lat else "lag(mid, 1) OVER w AS e0, lag(spread_ticks, 1) OVER w AS s0") for lat in LATENCIES)}
  FROM fine WINDOW w AS (PARTITION BY day0 ORDER BY t)),
frame AS (
  SELECT t, strftime(make_timestamp(day0), '%Y-%m-%d') AS day, x, ti_lag, (m0 - m1) / {TICK} AS ar_lag, depth_t,
    {', '.join(f"round_even((a{lat // BASE} - e{lat // BASE}) / {TICK}, 9) AS y{lat // BASE}, e{lat // BASE} AS me{lat // BASE}, s{lat // BASE} * {TICK} / 2 / e{lat // BASE} * 10000 AS hs{lat // BASE}" for lat in LATENCIES)}
  FROM wide WHERE (t - day0) % {COARSE} = 0 AND t >= day0 + {COARSE} AND t < day0 + {(DAY // COARSE - 1) * COARSE} AND NOT {_funding(f'(t - {COARSE})', f'(t + {COARSE + max(LATENCIES)})')}
    AND m0 IS NOT NULL AND m1 IS NOT NULL AND depth_t IS NOT NULL AND {' AND '.join(f'a{lat // BASE} IS NOT NULL AND e{lat // BASE} IS NOT NULL AND s{lat // BASE} IS NOT NULL' for lat in LATENCIES)}),
longer AS (
  SELECT t, day, m.model, m.x, g.latency_ms, g.y, g.me AS mid_entry, g.hs AS half_spread_bps FROM (
    SELECT t, day, unnest([{{'model': 'flow', 'x': x}}, {{'model': 'flow_over_depth', 'x': x / nullif(depth_t, 0)}}, {{'model': 'ar1', 'x': ar_lag}}, {{'model': 'ti', 'x': ti_lag}}]) AS m,
           [{', '.join(f"{{'latency_ms': CAST({lat / 1000} AS DOUBLE), 'y': y{lat // BASE}, 'me': me{lat // BASE}, 'hs': hs{lat // BASE}}}" for lat in LATENCIES)}] AS gs FROM frame), unnest(gs) AS u(g)),
fits AS (SELECT model, latency_ms, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM longer WHERE day < '{SPLIT[0]}' GROUP BY ALL),
pred AS (SELECT l.*, f.a + f.b * l.x AS yhat FROM longer l JOIN fits f USING (model, latency_ms) WHERE day >= '{SPLIT[0]}' AND day < '{SPLIT[1]}')"""


@query(f"""WITH {_FRAME} SELECT t, x, ti_lag, ar_lag, depth_t, day, {', '.join(f'y{lat // BASE} AS "y_{lat / 1000:g}", me{lat // BASE} AS "mid_entry_{lat / 1000:g}", round(hs{lat // BASE}, 6) AS "half_spread_bps_{lat / 1000:g}"' for lat in LATENCIES)} FROM frame""")
def predict_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{lat / 1000:g}" for lat in LATENCIES]
    out = frame(spark, sf_dir).select("t", "x", "ti_lag", "ar_lag", "depth_t", "day", *[f"{c}_{n}" for n in names for c in ("y", "mid_entry", "half_spread_bps")])
    return out.withColumns({f"half_spread_bps_{n}": F.round(f"half_spread_bps_{n}", 6) for n in names})


@query(f"WITH {_FRAME} SELECT model, latency_ms, round(a, 6) + 0 AS a, round(b, 6) + 0 AS b FROM fits")
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(predict.fit_models(rows_long(spark, sf_dir).where(F.col("day") < SPLIT[0])).drop("symbol"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_long(spark, sf_dir)
    models = predict.fit_models(rows.where(F.col("day") < SPLIT[0]))
    return predict.predictions(rows.where((F.col("day") >= SPLIT[0]) & (F.col("day") < SPLIT[1])), models)


@query(f"WITH {_FRAME} SELECT model, latency_ms, round(1 - sum((y - yhat) * (y - yhat)) / sum(y * y), 6) AS oos_r2, count(*) AS n FROM pred GROUP BY ALL")
def oos_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).groupBy("model", "latency_ms")
    return rounded(rows.agg(predict.out_of_sample_r2(F.col("y"), F.col("yhat")).alias("oos_r2"), F.count("*").alias("n")))


@query(f"""WITH {_FRAME}, {_draws(5)},
e AS (SELECT model, latency_ms, day, sum((y - yhat) * (y - yhat)) AS sse, sum(y * y) AS sst FROM pred GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY model, latency_ms ORDER BY day) - 1 AS i FROM e),
d AS (SELECT model, latency_ms, draw, 1 - sum(m * sse) / sum(m * sst) AS r2 FROM n JOIN mult USING (i) GROUP BY ALL)
SELECT model, latency_ms, round(quantile_cont(r2, 0.025), 6) AS lo, round(quantile_cont(r2, 0.975), 6) AS hi FROM d GROUP BY ALL""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All draws of the study over the days that are scored."""
    keys = ["model", "latency_ms"]
    errors = predict.day_errors(predicted(spark, sf_dir))
    draws = B.bootstrap(errors, "day", {"r2": B.Explained("sse", "sst0")}, keys=keys, columns=["sse", "sst0"], order="day", batch=5000)
    return rounded(B.percentile_ci(draws, "r2", keys=keys).select(*keys, "r2.lo", "r2.hi"))


@query(f"""WITH {_FRAME}, main AS (SELECT * FROM longer WHERE model = 'flow' AND latency_ms = {LATENCIES[1] / 1000}),
days AS (SELECT DISTINCT day, dense_rank() OVER (ORDER BY day) AS i FROM main),
fit AS (SELECT d.day, regr_intercept(m.y, m.x) AS a, regr_slope(m.y, m.x) AS b FROM days d JOIN main m ON m.day < d.day WHERE d.i > {WALK_FORWARD_DAYS} GROUP BY d.day)
SELECT day, round(any_value(b), 6) + 0 AS b, round(sum((y - a - b * x) * (y - a - b * x)), 4) AS sse, round(sum(y * y), 4) AS sst0,
  round(1 - sum((y - a - b * x) * (y - a - b * x)) / sum(y * y), 6) AS oos_r2 FROM main JOIN fit USING (day) GROUP BY day""")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_long(spark, sf_dir).where((F.col("model") == "flow") & (F.col("latency_ms") == LATENCIES[1] / 1000))
    out = predict.walk_forward(rows, WALK_FORWARD_DAYS).select("day", "b", F.round("sse", 4).alias("sse"), F.round("sst0", 4).alias("sst0"), "oos_r2")
    return rounded(out)


@query(f"""WITH {_FRAME},
p AS (SELECT *, sign(yhat) AS p, coalesce(t - lag(t) OVER w = {COARSE}, false) AS joins, coalesce(lead(t) OVER w - t = {COARSE}, false) AS goes_on, lag(sign(yhat)) OVER w AS before
      FROM pred WINDOW w AS (PARTITION BY model, latency_ms ORDER BY t)),
q AS (SELECT *, p * y * {TICK} / mid_entry * 10000 AS gross, abs(p - CASE WHEN joins THEN before ELSE 0 END) + CASE WHEN goes_on THEN 0 ELSE abs(p) END AS turn FROM p)
SELECT model, latency_ms, round(sum(gross), 4) AS gross_bps, sum(turn) AS turnover, round(sum(gross) - sum(turn * ({FEE_BPS} + half_spread_bps)), 4) AS net_bps,
  round(sum(gross) / nullif(sum(turn), 0), 6) AS break_even_bps, round(avg(gross), 6) AS gross_bps_per_bucket, count(*) AS buckets, count(DISTINCT day) AS days,
  round(median(half_spread_bps), 6) AS median_half_spread_bps FROM q GROUP BY ALL""")
def strategy_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strategy.sign_strategy(predicted(spark, sf_dir), COARSE, FEE_BPS).drop("symbol")
    return rounded(out.withColumns({"gross_bps": F.round("gross_bps", 4), "net_bps": F.round("net_bps", 4)}))


@query(f"""WITH {_FRAME}, {_draws(5)},
e AS (SELECT model, latency_ms, day, sum((y - yhat) * (y - yhat)) AS sse, sum(y * y) AS sst FROM pred GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY model, latency_ms ORDER BY day) - 1 AS i FROM e WHERE model = 'flow' AND latency_ms = {LATENCIES[1] / 1000}),
d AS (SELECT model, latency_ms, draw, 1 - sum(m * sse) / sum(m * sst) AS r2 FROM n JOIN mult USING (i) GROUP BY ALL),
ci AS (SELECT model, latency_ms, round(quantile_cont(r2, 0.025), 6) AS lo, round(quantile_cont(r2, 0.975), 6) AS hi FROM d GROUP BY ALL),
r AS (SELECT model, latency_ms, round(1 - sum(sse) / sum(sst), 6) AS oos_r2, CASE WHEN 1 - sum(sse) / sum(sst) > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM e GROUP BY ALL),
p AS (SELECT *, sign(yhat) AS p, coalesce(t - lag(t) OVER w = {COARSE}, false) AS joins, coalesce(lead(t) OVER w - t = {COARSE}, false) AS goes_on, lag(sign(yhat)) OVER w AS before
      FROM pred WINDOW w AS (PARTITION BY model, latency_ms ORDER BY t)),
q AS (SELECT *, p * y * {TICK} / mid_entry * 10000 AS gross, abs(p - CASE WHEN joins THEN before ELSE 0 END) + CASE WHEN goes_on THEN 0 ELSE abs(p) END AS turn FROM p),
x AS (SELECT model, latency_ms, round(avg(gross), 6) AS gross_bps_per_bucket, round(sum(gross) / nullif(sum(turn), 0), 6) AS break_even_bps,
        round((sum(gross) - sum(turn * ({FEE_BPS} + half_spread_bps))) / count(DISTINCT day), 4) AS net_bps_per_day, round(sum(turn) / count(DISTINCT day), 6) AS turnover_per_day,
        round(median(half_spread_bps), 6) AS median_half_spread_bps FROM q GROUP BY ALL)
SELECT * FROM r JOIN x USING (model, latency_ms) LEFT JOIN ci USING (model, latency_ms)""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample R2 with the interval of the main row, economics a day, and the verdict of the held-out test."""
    rows = rows_long(spark, sf_dir)
    models = predict.fit_models(rows.where(F.col("day") < SPLIT[0]))
    later = rows.where((F.col("day") >= SPLIT[0]) & (F.col("day") < SPLIT[1]))
    out = study.evaluate(later, models, BOOTSTRAP_DRAWS, main=("flow", LATENCIES[1] / 1000), freq_us=COARSE)
    out = out.withColumns({"net_bps_per_day": F.round("net_bps_per_day", 4), "lo": F.col("oos_r2_ci.lo"), "hi": F.col("oos_r2_ci.hi"), "verdict": S.passed(F.col("oos_r2") > 0)})
    return rounded(out.drop("symbol", "oos_r2_ci"))


@query(f"WITH {_FRAME} SELECT round(power(corr(x, ar_lag), 2), 6) AS r2 FROM frame")
def explain_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explore.pooled_r2(frame(spark, sf_dir), "x", "ar_lag").drop("symbol"))


@query(f"""WITH {_COARSE} SELECT a.t, b.flow AS flow_before FROM coarse a LEFT JOIN coarse b ON b.day0 = a.day0 AND b.t = a.t - {5 * COARSE}""")
def shifted_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coarse(spark, sf_dir)
    return rows.select("t", shifted(rows, "flow", 5 * COARSE).alias("flow_before"))


# ---- streams


@query(ORACLES["event_flows"])
def stream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow of each update, from a stream that carries the last book row."""
    return drained(stream_flow(streamed_book(spark, sf_dir))).select("seq", "flow")


LATE_S = 600


@query(f"""WITH {_grid(COARSE)}, seen AS (SELECT (max(ts) // 1000 - {LATE_S * 1000}) * 1000 AS until FROM book)
SELECT t, flow, dmid_ticks, depth, spread_ticks, CAST(n_events AS BIGINT) AS n_events, mid FROM grid, seen WHERE t + {COARSE} <= until""")
def stream_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid that timers give out up to the watermark."""
    with rocksdb(spark):
        return drained(dense_buckets(streamed_book(spark, sf_dir), COARSE, TICK, f"{LATE_S} seconds")).drop("symbol")

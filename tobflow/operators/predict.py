"""Latency-aware prediction frames, models, out-of-sample scores and walk-forward fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.schema import DAY, STREAM

MODELS = ("flow", "flow_over_depth", "ar1", "ti")


def predictive_frame(fine: DataFrame, tick, step_us: int, freq_us: int, latencies_us: tuple[int, ...]) -> DataFrame:
    """A row per decision time t: what is known at t, and the price move over [t + L, t + freq + L) for each latency L.

    fine is a dense day grid of step_us with flow, ti, mid, depth and spread_ticks; tick is a number or a column
    of it. The state at T is that at the
    end of the bucket ending at T; each value comes from a frame of one instant, so all come from one sort.
    Frames that meet a funding time and rows with a missing value are left out. Latency columns carry L in ms.
    """
    if freq_us % step_us or any(lat % step_us for lat in latencies_us):
        raise ValueError("the frequency and the latencies are multiples of the step")
    order = Window.partitionBy(*STREAM).orderBy("t")

    def state(column: str, ahead: int) -> Column:
        return F.max(column).over(order.rangeBetween(ahead - step_us, ahead - step_us))

    def before(column: str) -> Column:
        return F.sum(column).over(order.rangeBetween(-freq_us, -1))

    columns: dict[str, Column] = {"x": before("flow"), "ti_lag": before("ti"), "ar_lag": (state("mid", 0) - state("mid", -freq_us)) / tick, "depth_t": state("depth", 0)}
    for lat in latencies_us:
        name = f"{lat / 1000:g}"
        entry = state("mid", lat)
        columns[f"y_{name}"] = S.in_ticks(state("mid", freq_us + lat) - entry, tick)
        columns[f"mid_entry_{name}"] = entry
        columns[f"half_spread_bps_{name}"] = state("spread_ticks", lat) * tick / 2 / entry * 1e4
    rows = fine.select(*STREAM, "t", F.lit(tick).cast("double").alias("tick"), *[v.alias(k) for k, v in columns.items()])
    t = F.col("t")
    inside = (F.pmod(t - F.col("day0"), F.lit(freq_us)) == 0) & (t >= F.col("day0") + freq_us) & (t < F.col("day0") + (DAY // freq_us - 1) * freq_us)
    rows = rows.where(inside & ~S.overlaps_funding(t - freq_us, t + freq_us + max(latencies_us))).dropna("any")
    spans = {"feat_start": t - freq_us, "feat_end": t}
    for lat in latencies_us:
        spans |= {f"tgt_start_{lat / 1000:g}": t + lat, f"tgt_end_{lat / 1000:g}": t + freq_us + lat}
    return rows.withColumns({**spans, "day": S.iso_day(F.col("day0"))})


def long_frame(frame: DataFrame, latencies_us: tuple[int, ...]) -> DataFrame:
    """A row per decision time, model and latency: symbol, day, t, model, latency_ms, x, y, mid_entry, half_spread_bps, tick."""
    names = [f"{lat / 1000:g}" for lat in latencies_us]
    features = {"flow": F.col("x"), "flow_over_depth": F.try_divide(F.col("x"), F.col("depth_t")), "ar1": F.col("ar_lag"), "ti": F.col("ti_lag")}
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), v.cast("double").alias("x")) for m, v in features.items()]))
    targets = F.explode(F.array(*[F.struct(F.lit(float(n)).alias("latency_ms"), F.col(f"y_{n}").alias("y"), F.col(f"mid_entry_{n}").alias("mid_entry"), F.col(f"half_spread_bps_{n}").alias("half_spread_bps")) for n in names]))
    wide = frame.select("symbol", "day", "t", "tick", models.alias("m"), *[f"{c}_{n}" for n in names for c in ("y", "mid_entry", "half_spread_bps")])
    out = wide.select("symbol", "day", "t", "tick", "m.*", targets.alias("g"))
    return out.select("symbol", "day", "t", "model", "g.latency_ms", "x", "g.y", "g.mid_entry", "g.half_spread_bps", "tick")


def line(n: Column, sx: Column, sy: Column, sxx: Column, sxy: Column) -> tuple[Column, Column]:
    """Intercept and slope from sums; where x is constant, the shortest pair that fits the mean."""
    det = n * sxx - sx * sx
    mean_x, mean_y = sx / n, sy / n
    flat = det <= 1e-12 * n * sxx
    slope = F.when(flat, mean_y * mean_x / (1 + mean_x * mean_x)).otherwise(F.try_divide(n * sxy - sx * sy, det))
    return mean_y - slope * mean_x, slope


def _sums() -> list[Column]:
    return [F.count("*").cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy")]


def fit_models(rows: DataFrame) -> DataFrame:
    """symbol, model, latency_ms, a and b of y = a + b x over a long frame."""
    sums = rows.groupBy("symbol", "model", "latency_ms").agg(*_sums())
    a, b = line(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    return sums.select("symbol", "model", "latency_ms", a.alias("a"), b.alias("b"))


def predictions(rows: DataFrame, models: DataFrame) -> DataFrame:
    """The long frame with yhat. Models are a row per symbol, model and latency, and so are broadcast."""
    joined = rows.join(F.broadcast(models), ["symbol", "model", "latency_ms"])
    return joined.withColumn("yhat", F.col("a") + F.col("b") * F.col("x")).drop("a", "b")


def out_of_sample_r2(y: Column, yhat: Column) -> Column:
    """1 - SSE / sum of y squared: against the forecast of no change."""
    return 1 - F.try_divide(F.sum((y - yhat) * (y - yhat)), F.sum(y * y))


def day_errors(predicted: DataFrame) -> DataFrame:
    """symbol, model, latency_ms, day, sse and sst0: all that a bootstrap over days needs."""
    off = F.col("y") - F.col("yhat")
    return predicted.groupBy("symbol", "model", "latency_ms", "day").agg(F.sum(off * off).alias("sse"), F.sum(F.col("y") * F.col("y")).alias("sst0"))


def walk_forward(rows: DataFrame, warm_up: int) -> DataFrame:
    """symbol, model, latency_ms, day, b, sse, sst0, oos_r2: each day after the first warm_up, scored by a fit on all earlier days.

    Fits come from running sums over days, so every row is read twice, not once a day.
    """
    keys = ["symbol", "model", "latency_ms"]
    days = rows.groupBy(*keys, "day").agg(*_sums())
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    running = days.select(*keys, "day", F.count("*").over(earlier).alias("before"), *[F.sum(c).over(earlier).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")]).where(F.col("before") >= warm_up)
    a, b = line(*(F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    fits = running.select(*keys, "day", a.alias("a"), b.alias("b"))
    scored = rows.join(F.broadcast(fits), [*keys, "day"])
    off = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    out = scored.groupBy(*keys, "day").agg(F.first("b").alias("b"), F.sum(off * off).alias("sse"), F.sum(F.col("y") * F.col("y")).alias("sst0"))
    return out.withColumn("oos_r2", 1 - F.try_divide(F.col("sse"), F.col("sst0")))


def pooled_r2(walked: DataFrame) -> DataFrame:
    return walked.groupBy("symbol", "model", "latency_ms").agg((1 - F.try_divide(F.sum("sse"), F.sum("sst0"))).alias("pooled_oos_r2"))

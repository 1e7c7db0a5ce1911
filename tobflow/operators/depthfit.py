"""Depth scaling: beta = exp(a + Z gamma) * depth ** -lambda by least squares on beta, so that betas below zero stay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ["blk_1", "blk_2", "blk_3", "blk_4", "blk_5", "weekend"]
FIT = "a double, lam double, gamma map<string,double>, n long, converged boolean"


def control_matrix(block: np.ndarray, weekend: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """Dummies of the 4-hour blocks 1 to 5 and the weekend, without those constant where the weight is positive."""
    z = np.column_stack([*[(block == j).astype(float) for j in range(1, 6)], weekend.astype(float)])
    seen = z if weight is None else z[weight > 0]
    keep = [j for j in range(z.shape[1]) if len(seen) and seen[:, j].min() != seen[:, j].max()]
    return z[:, keep], [CONTROLS[j] for j in keep]


def fit_depth(beta: np.ndarray, depth: np.ndarray, z: np.ndarray, weight: np.ndarray | None = None, *, steps: int = 200, tolerance: float = 1e-13) -> tuple[np.ndarray, bool]:
    """(a, gamma..., lambda) by Levenberg-Marquardt from a log-log start on positive betas, and whether it converged."""
    w = np.ones(len(beta)) if weight is None else weight.astype(float)
    x = np.column_stack([np.ones(len(beta)), z, -np.log(depth)])
    use = w > 0
    x, y, root = x[use], beta[use], np.sqrt(w[use])
    start = y > 0
    p = np.linalg.lstsq(x[start] * root[start, None], np.log(y[start]) * root[start], rcond=None)[0]
    f = np.exp(x @ p)
    loss, damp, scale = float(np.sum((root * (f - y)) ** 2)), 1e-3, np.zeros(x.shape[1])
    for _ in range(steps):
        jac = x * f[:, None] * root[:, None]
        gram, slope = jac.T @ jac, jac.T @ (root * (f - y))
        scale = np.maximum(scale, np.diag(gram))
        step = np.linalg.solve(gram + damp * np.diag(scale), -slope)
        with np.errstate(over="ignore"):
            g = np.exp(x @ (p + step))
        new = float(np.sum((root * (g - y)) ** 2))
        if np.isfinite(new) and new <= loss:
            done = loss - new <= tolerance * max(loss, 1e-300)
            p, f, loss, damp = p + step, g, new, damp / 9
            if done:
                return p, True
        else:
            damp *= 11
            if damp > 1e12:
                return p, True
    return p, False


def fit_panel(panel: DataFrame) -> DataFrame:
    """One row per symbol of a window panel: a, lam, gamma (map of controls), n and converged."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z, names = control_matrix(rows["block"].to_numpy(), rows["weekend"].to_numpy())
        p, ok = fit_depth(rows["beta"].to_numpy(), rows["depth_mean"].to_numpy(), z)
        return pd.DataFrame([{"symbol": key[0], "a": p[0], "lam": p[-1], "gamma": dict(zip(names, p[1:-1], strict=True)), "n": len(rows), "converged": ok}])

    return panel.select("symbol", "window", "beta", "depth_mean", "block", "weekend").groupBy("symbol").applyInPandas(one, "symbol string, " + FIT)


def exponent(rows: pd.DataFrame, weight: np.ndarray) -> float:
    """lambda of weighted panel rows: the statistic of one bootstrap draw."""
    z, _ = control_matrix(rows["block"].to_numpy(), rows["weekend"].to_numpy(), weight)
    return fit_depth(rows["beta"].to_numpy(), rows["depth_mean"].to_numpy(), z, weight)[0][-1]


def controls(panel: DataFrame) -> DataFrame:
    """panel with the control columns: a dummy per 4-hour block from 1 to 5 (0 is the baseline) and the weekend, as numbers."""
    dummies = {f"blk_{j}": (F.col("block") == j).cast("double") for j in range(1, 6)}
    return panel.withColumns({**dummies, "weekend": F.col("weekend").cast("double")})


def gradient(panel: DataFrame, fits: DataFrame) -> DataFrame:
    """symbol and one column per parameter (a, lam, controls): the slope of half the squared loss at the fit over the loss's own scale.

    Zero in every fitted parameter marks an optimum; a control that was constant has no parameter and gives null.
    """
    gamma = {c: F.element_at("gamma", F.lit(c)) for c in CONTROLS}
    power = F.col("a") - F.col("lam") * F.log("depth_mean")
    for c, g in gamma.items():
        power = power + F.coalesce(g, F.lit(0.0)) * F.col(c)
    rows = controls(panel).join(fits.select("symbol", "a", "lam", "gamma"), "symbol").withColumn("_f", F.exp(power))
    pull = F.col("_f") * (F.col("_f") - F.col("beta"))
    x = {"a": F.lit(1.0), "lam": -F.log("depth_mean")} | {c: F.when(gamma[c].isNotNull(), F.col(c)) for c in CONTROLS}
    return rows.groupBy("symbol").agg(*[(F.sum(pull * v) / F.sum(F.abs(pull * v))).alias(c) for c, v in x.items()])

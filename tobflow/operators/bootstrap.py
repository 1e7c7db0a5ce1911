"""Bootstrap over whole blocks (days): a draw is a row of multiplicities of blocks, so no row is ever repeated.

A task takes a batch of draws of one group. Statistics of all its draws come from matrices: a median from one sorted
pass over the values with running sums of their multiplicities, a ratio from sums per block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tobflow.config import BOOTSTRAP_DRAWS, BOOTSTRAP_SEED
from tobflow.operators.percentiles import counted, percentiles

#: Draws of a task's batch, and cells (draws times rows) of one matrix.
BATCH, CELLS = 500, 1 << 22


def multiplicities(blocks: int, draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED) -> np.ndarray:
    """How often each draw (row) picks each of so many blocks; blocks are numbered in the order of their first row."""
    rng = np.random.default_rng(seed)
    return np.stack([np.bincount(rng.integers(0, blocks, blocks), minlength=blocks) for _ in range(draws)]) if draws else np.zeros((0, blocks), int)


@dataclass(frozen=True)
class Median:
    """Median of a column over the drawn rows; two middle values are averaged."""

    column: str

    def of(self, rows: pd.DataFrame, block: np.ndarray, times: np.ndarray) -> np.ndarray:
        values = rows[self.column].to_numpy(float)
        order = np.argsort(values, kind="stable")
        order = order[~np.isnan(values[order])]
        if not len(order):
            return np.full(len(times), np.nan)
        values, block, out = values[order], block[order], np.empty(len(times))
        step = max(1, CELLS // len(order))
        for at in range(0, len(times), step):
            running = np.cumsum(times[at : at + step][:, block], axis=1)
            total = running[:, -1]
            low, high = (values[(running > k[:, None]).argmax(axis=1)] for k in ((total - 1) // 2, total // 2))
            out[at : at + step] = np.where(total > 0, (low + high) / 2, np.nan)
        return out


@dataclass(frozen=True)
class Difference:
    left: Median
    right: Median

    def of(self, rows: pd.DataFrame, block: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.left.of(rows, block, times) - self.right.of(rows, block, times)


@dataclass(frozen=True)
class Explained:
    """1 - sum(error) / sum(total)."""

    error: str
    total: str

    def of(self, rows: pd.DataFrame, block: np.ndarray, times: np.ndarray) -> np.ndarray:
        sums = [times @ np.bincount(block, rows[c].to_numpy(float), times.shape[1]) for c in (self.error, self.total)]
        return 1 - np.divide(*sums, out=np.full(len(times), np.nan), where=sums[1] != 0)


@dataclass(frozen=True)
class Each:
    """Any statistic: function(rows, weight of each row) of every draw."""

    function: Callable[[pd.DataFrame, np.ndarray], float]

    def of(self, rows: pd.DataFrame, block: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.array([self.function(rows, t[block]) for t in times])


def bootstrap(rows: DataFrame, block: str, statistics: dict[str, Median | Difference | Explained | Each], *, keys: list[str], columns: list[str], order: str, draws: int = BOOTSTRAP_DRAWS, seed: int = BOOTSTRAP_SEED, batch: int = BATCH) -> DataFrame:
    """keys, draw and one column per statistic.

    rows has keys, block, columns and order, which puts blocks in the order of their first row. Rows are few (windows
    or days of one group); they go to each of the group's tasks, one per ``batch`` draws.
    """
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), "draw int", *(f"`{name}` double" for name in statistics)])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable", ignore_index=True)
        number, names = pd.factorize(frame[block])
        first = int(key[-1]) * batch
        times = multiplicities(len(names), min(draws, first + batch), seed)[first:]
        out = {k: key[i] for i, k in enumerate(keys)} | {"draw": np.arange(first, first + len(times))}
        return pd.DataFrame(out | {name: s.of(frame, number, times) for name, s in statistics.items()})

    needed = list(dict.fromkeys([*keys, block, order, *columns]))
    dealt = rows.select(*needed, F.explode(F.sequence(F.lit(0), F.lit(max(0, draws - 1) // batch))).alias("_batch"))
    return dealt.groupBy(*keys, "_batch").applyInPandas(run, schema)


def percentile_ci(draws: DataFrame, *columns: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """keys and a struct (lo, hi) per column; quantiles interpolate."""
    a, out = (1 - level) / 2, None
    for c in columns:
        one = percentiles(counted(draws.where(~F.isnan(c)), keys, c), keys, {"lo": a, "hi": 1 - a}).select(*keys, F.struct("lo", "hi").alias(c))
        out = one if out is None else out.join(one, keys)
    return out

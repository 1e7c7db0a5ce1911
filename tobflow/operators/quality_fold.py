"""The quality report as a fold: a state per chunk of rows, and a merge of the states of consecutive chunks.

A state has counters, the first and last row, the border times, the widest gaps between times, and how often each price,
spread and delay occurs; it grows with distinct values, not with rows. The same state serves batches split anyhow and a
stream. Times may come late: a merged gap is what is free in both chunks. ``GAPS`` of them are kept, so the widest one
is exact unless more gaps than that of one chunk are wider than it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tobflow.schema import BOOK_COLUMNS, HOUR, SECOND

GAPS = 64
COUNTERS = ("rows", "rows_with_nan", "duplicate_rows", "ts_backwards", "local_ts_backwards", "crossed_or_locked", "off_grid_rows")
MAPS = ("prices", "spreads", "delays")
REPORT = (
    "rows long, rows_with_nan long, duplicate_rows long, ts_backwards long, local_ts_backwards long, crossed_or_locked long, off_grid_rows long, "
    "spread_ticks_p50_p99_max array<int>, frac_spread_1tick double, recv_delay_ms_p50 double, recv_delay_ms_p99 double, "
    "frac_recv_delay_negative double, max_gap_s double, inferred_tick double, rows_per_hour array<long>"
)
STATE = "state string"


def _counts(values: np.ndarray) -> dict[str, int]:
    found, n = np.unique(values, return_counts=True)
    return dict(zip(map(repr, found.tolist()), n.tolist(), strict=True))


def _widest(gaps: np.ndarray) -> list[list[int]]:
    order = np.argsort(gaps[:, 0] - gaps[:, 1], kind="stable")[:GAPS]
    return gaps[order].tolist()


def state_of(rows: pd.DataFrame, tick: float) -> dict | None:
    """The state of rows in the order of seq; None of no rows."""
    if rows.empty:
        return None
    values = rows[BOOK_COLUMNS].to_numpy(float)
    full = ~np.isnan(values).any(axis=1)
    bid, ask = (rows[c].to_numpy(float)[full] for c in ("bid_price", "ask_price"))
    times, local = rows["timestamp"].to_numpy(np.int64), rows["local_timestamp"].to_numpy(np.int64)
    on = np.ones(len(bid), bool)
    for price in (bid, ask):
        on &= np.abs(price / tick - np.rint(price / tick)) < 1e-6
    sorted_times = np.unique(times)
    ends = [[None if np.isnan(x) else x for x in values[k].tolist()] for k in (0, -1)]
    return {
        "rows": len(rows),
        "rows_with_nan": int((~full).sum()),
        "duplicate_rows": int((values[1:] == values[:-1]).all(axis=1).sum()),
        "ts_backwards": int((np.diff(times) < 0).sum()),
        "local_ts_backwards": int((np.diff(local) < 0).sum()),
        "crossed_or_locked": int((bid >= ask).sum()),
        "off_grid_rows": int((~on).sum()),
        "prices": _counts(np.concatenate([bid, ask])),
        "spreads": _counts(np.rint((ask - bid) / tick).astype(np.int64)),
        "delays": _counts(local - times),
        "hours": np.bincount(times // HOUR % 24, minlength=24).tolist(),
        "first": ends[0],
        "last": ends[1],
        "lo": int(sorted_times[0]),
        "hi": int(sorted_times[-1]),
        "gaps": _widest(np.column_stack([sorted_times[:-1], sorted_times[1:]])),
    }


def _free(state: dict) -> np.ndarray:
    """Open intervals without times of the state, those before and after it included."""
    far = np.iinfo(np.int64).max // 4
    return np.array([[-far, state["lo"]], *state["gaps"], [state["hi"], far]], np.int64)


def merge(a: dict | None, b: dict | None) -> dict | None:
    """The state of a's rows and, behind them, b's."""
    if a is None or b is None:
        return a or b
    out = {c: a[c] + b[c] for c in COUNTERS}
    out["duplicate_rows"] += None not in a["last"] and a["last"] == b["first"]
    for place, name in ((0, "ts_backwards"), (1, "local_ts_backwards")):
        out[name] += b["first"][place] < a["last"][place]
    for name in MAPS:
        more, into = sorted((a[name], b[name]), key=len)
        into = dict(into)
        for value, n in more.items():
            into[value] = into.get(value, 0) + n
        out[name] = into
    out["hours"] = [x + y for x, y in zip(a["hours"], b["hours"], strict=True)]
    x, y = _free(a), _free(b)
    both = np.stack([np.maximum(x[:, None, 0], y[None, :, 0]), np.minimum(x[:, None, 1], y[None, :, 1])], axis=-1).reshape(-1, 2)
    out["lo"], out["hi"] = min(a["lo"], b["lo"]), max(a["hi"], b["hi"])
    inside = (both[:, 0] < both[:, 1]) & (both[:, 0] >= out["lo"]) & (both[:, 1] <= out["hi"])
    return out | {"first": a["first"], "last": b["last"], "gaps": _widest(both[inside])}


def _percentile(counts: dict[str, int], ps: tuple[float, ...], scale: float = 1.0) -> list[float]:
    values = np.array([float(v) for v in counts])
    order = np.argsort(values)
    to = np.cumsum(np.array(list(counts.values()))[order])
    out = []
    for p in ps:
        rank = p * (to[-1] - 1)
        low, high = (values[order[np.searchsorted(to, r, "right")]] for r in (np.floor(rank), np.ceil(rank)))
        out.append(float((low + (rank - np.floor(rank)) * (high - low)) / scale))
    return out


def report(state: dict) -> dict:
    """The figures of quality_report."""
    spreads, delays, prices = (state[m] for m in ("spreads", "delays", "prices"))
    share = lambda counts, f: sum(n for v, n in counts.items() if f(float(v))) / sum(counts.values()) if counts else None
    steps = np.diff(np.sort([float(p) for p in prices]))
    delay = _percentile(delays, (0.5, 0.99), 1000)
    return {c: state[c] for c in COUNTERS} | {
        "spread_ticks_p50_p99_max": [int(x) for x in _percentile(spreads, (0.5, 0.99, 1.0))] if spreads else None,
        "frac_spread_1tick": share(spreads, lambda v: v == 1),
        "recv_delay_ms_p50": delay[0],
        "recv_delay_ms_p99": delay[1],
        "frac_recv_delay_negative": share(delays, lambda v: v < 0),
        "max_gap_s": max((hi - lo for lo, hi in state["gaps"]), default=0) / SECOND,
        "inferred_tick": round(float(steps.min()), 10) if len(steps) else None,
        "rows_per_hour": state["hours"],
    }


def chunk_states(book: DataFrame, tick: float, chunk: str, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """keys, chunk and state of every chunk of rows (a chunk goes to one task; chunks follow each other by their number)."""
    kinds = dict(book.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{chunk} {kinds[chunk]}", STATE])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, json.dumps(state_of(rows.sort_values("seq", ignore_index=True), tick))]], columns=[*keys, chunk, "state"])

    return book.select(*keys, chunk, "seq", *BOOK_COLUMNS).groupBy(*keys, chunk).applyInPandas(run, schema)


def merged_report(states: DataFrame, chunk: str, keys: tuple[str, ...] = ("symbol", "day0")) -> DataFrame:
    """The quality report of each group from its chunks' states, in the order of chunk."""
    schema = ", ".join([*(f"{k} {dict(states.dtypes)[k]}" for k in keys), REPORT])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = reduce(merge, map(json.loads, rows.sort_values(chunk)["state"]))
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | report(whole)])

    return states.groupBy(*keys).applyInPandas(run, schema)


def stream_quality(book: DataFrame, tick: float) -> DataFrame:
    """symbol, day0 and the quality report so far of each stream that a micro-batch has rows of (an extension).

    Rows of a micro-batch are taken by seq; micro-batches follow each other.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
        state = merge(json.loads(kept.get[0]) if kept.exists else None, state_of(rows, tick))
        kept.update((json.dumps(state),))
        yield pd.DataFrame([{"symbol": key[0], "day0": key[1]} | report(state)])

    rows = book.select("symbol", "day0", "seq", *BOOK_COLUMNS)
    return rows.groupBy("symbol", "day0").applyInPandasWithState(run, f"symbol string, day0 long, {REPORT}", STATE, "update", GroupStateTimeout.NoTimeout)

"""Streaming forms, extensions of the batch operators: flow per update with the last book row as state, and bucket sums.

Late rows are handled by the watermark; within a micro-batch rows of a symbol are worked on in the order of seq.

No task holds a symbol's whole micro-batch: chunks of consecutive seq are worked on apart from each other, and only the
first and last row of each chunk meet in the symbol's task, where the last row before a chunk gives its first row's flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PRICES = ["bid_price", "bid_amount", "ask_price", "ask_amount"]
LAST = [f"last_{c}" for c in PRICES]
FLOWS = "symbol string, seq long, timestamp long, flow double"
BORDERS = f"symbol string, seq long, timestamp long, {', '.join(f'{c} double' for c in [*PRICES, *LAST])}"
#: Chunks are of 2**CHUNK_BITS numbers of seq.
CHUNK_BITS = 16


def _side(rows: pd.DataFrame, was: pd.DataFrame, price: str, size: str, sign: int) -> pd.Series:
    """What a side adds: its size now where its price is as good or better, less its size before where that is as good or worse."""
    step = sign * (rows[price] - was[price])
    return rows[size].where(step >= 0, 0.0) - was[size].where(step <= 0, 0.0)


def flows_of(rows: pd.DataFrame, before: list | tuple | None) -> pd.Series:
    """Flow of each update of rows in the order of seq; before is the book row that precedes them."""
    was = rows[PRICES].shift()
    if before is not None and len(rows):
        was.iloc[0] = [np.nan if x is None else x for x in before]
    return flow_after(rows, was)


def flow_after(rows: pd.DataFrame, was: pd.DataFrame) -> pd.Series:
    """Flow of each of rows, where was has the book row before it."""
    sizes = ["bid_amount", "ask_amount"]
    known = rows[sizes].notna().all(axis=1) & was[sizes].notna().all(axis=1)
    return (_side(rows, was, "bid_price", "bid_amount", 1) - _side(rows, was, "ask_price", "ask_amount", -1)).where(known)


def border(rows: pd.DataFrame) -> pd.DataFrame:
    """The first of rows in the order of seq, with the prices and sizes of the last one."""
    return pd.concat([rows.iloc[:1].reset_index(drop=True), rows[PRICES].iloc[-1:].add_prefix("last_").reset_index(drop=True)], axis=1)


def joined_flows(borders: pd.DataFrame, before: list | tuple | None) -> tuple[pd.Series, tuple]:
    """Flow of each chunk's first row from its borders in the order of seq, and the book row that all of them leave behind.

    before is the book row that precedes them.
    """
    was = borders[LAST].set_axis(PRICES, axis=1)
    left = tuple(float(x) for x in was.iloc[-1])
    was = was.shift()
    if before is not None:
        was.iloc[0] = [np.nan if x is None else x for x in before]
    return flow_after(borders, was), left


def _inner_flows(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seq", ignore_index=True)
    return rows.assign(flow=flows_of(rows, None))[["symbol", "seq", "timestamp", "flow"]].iloc[1:]


def _border(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return border(rows.sort_values("seq", ignore_index=True))[["symbol", "seq", "timestamp", *PRICES, *LAST]]


def _first_flows(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("seq", ignore_index=True)
    flow, left = joined_flows(rows, state.get if state.exists else None)
    state.update(left)
    yield rows.assign(symbol=key[0], flow=flow)[["symbol", "seq", "timestamp", "flow"]]


def chunked(rows: DataFrame, bits: int) -> GroupedData:
    """rows by symbol and chunk: seq numbers them, so a chunk of 2**bits numbers has no more rows."""
    return rows.groupBy("symbol", F.shiftright("seq", bits))


def stream_flow(book: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """symbol, seq, timestamp and flow of every update of a stream (symbol, seq, timestamp and the book's prices and sizes).

    seq should number rows without wide gaps: each chunk of 2**bits numbers that has rows sends one row to its symbol's task.
    """
    state = ", ".join(f"{c} double" for c in PRICES)
    chunks = chunked(book.select("symbol", "seq", "timestamp", *PRICES), bits)
    inner = chunks.applyInPandas(_inner_flows, FLOWS)
    borders = chunks.applyInPandas(_border, BORDERS)
    return inner.unionByName(borders.groupBy("symbol").applyInPandasWithState(_first_flows, FLOWS, state, "append", GroupStateTimeout.NoTimeout))


def stream_buckets(flows: DataFrame, width: str, late: str) -> DataFrame:
    """symbol, start, flow and n_events of tumbling buckets; a bucket is given out when the watermark passes its end."""
    timed = flows.withColumn("at", F.timestamp_micros("timestamp")).withWatermark("at", late)
    sums = timed.groupBy("symbol", F.window("at", width)).agg(F.coalesce(F.sum("flow"), F.lit(0.0)).alias("flow"), F.count("*").alias("n_events"))
    return sums.select("symbol", F.unix_micros("window.start").alias("t"), "flow", "n_events")

"""Dense time buckets of a stream: timers close buckets, fill those without rows and carry the state over them (an extension).

A bucket is given out once the watermark passes its end, so a quiet symbol's buckets come as long as time moves on.

No task holds a symbol's rows: chunks of consecutive seq are summed by bucket, the sums of a span of buckets are united,
and the symbol's task adds them to its open spans, a span at a time. Only the first flow of a chunk, which needs the row
before it, is found there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tobflow.schema import DAY
from tobflow.streaming.flow import CHUNK_BITS, LAST, PRICES, border, chunked, flows_of, joined_flows

GRID = "symbol string, t long, flow double, dmid_ticks double, depth double, spread_ticks double, n_events long, mid double"
STATES = ("mid", "depth", "spread")
#: Sums of a bucket (seq: the first row's, lo: the earliest time), and, where border is set, the border of a chunk.
PARTS = f"symbol string, span long, k long, border boolean, seq long, lo long, flow double, n long, {', '.join(f'{c} double' for c in [*STATES, *PRICES, *LAST])}"
COLUMNS = [x.split()[0] for x in PARTS.split(", ")]
#: Buckets of a span, and spans of a frame of the grid.
SPAN, SPANS = 128, 64


def _parts(freq_us: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", ignore_index=True)
        known = pd.DataFrame({
            "k": rows["timestamp"] // freq_us,
            "seq": rows["seq"],
            "lo": rows["timestamp"],
            "flow": flows_of(rows, None).fillna(0.0),
            "mid": (rows["bid_price"] + rows["ask_price"]) / 2,
            "depth": (rows["bid_amount"] + rows["ask_amount"]) / 2,
            "spread": rows["ask_price"] - rows["bid_price"],
        })
        sums = _united(known.assign(n=1))
        first = border(rows).assign(k=known["k"].iloc[0], lo=rows["timestamp"].iloc[0], n=0, border=True)
        out = pd.concat([sums.assign(border=False), first], ignore_index=True)
        return out.assign(symbol=key[0], span=out["k"] // SPAN).reindex(columns=COLUMNS)

    return run


def _united(sums: pd.DataFrame) -> pd.DataFrame:
    """Sums by bucket, and the last known state in the order of rows."""
    return sums.groupby("k", as_index=False).agg({"seq": "first", "lo": "min", "flow": "sum", "n": "sum", **dict.fromkeys(STATES, "last")})


def _spans(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    borders, sums = parts[parts["border"]], parts[~parts["border"]].sort_values("seq", ignore_index=True)
    united = _united(sums).assign(symbol=key[0], span=key[1], border=False).reindex(columns=COLUMNS)
    return pd.concat([x for x in (united, borders) if len(x)], ignore_index=True)


class DenseBuckets(StatefulProcessor):
    """State of a symbol: its last book row, the next bucket to give out and the market before it, and its open buckets by span."""

    def __init__(self, freq_us: int, tick: float):
        self.freq_us, self.tick = freq_us, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("buckets", "state string")
        self.open = handle.getMapState("open", "span long", "sums string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else {"row": None, "next": None, "was": dict.fromkeys(STATES)}
        borders, lo = [], []
        for frame in rows:
            lo.append(frame["lo"].min())
            borders.append(frame[frame["border"]])
            for span, own in self._due(frame[~frame["border"]], state):
                sums = self._span(span)
                at = own["k"].to_numpy(np.int64) - span * SPAN
                sums["flow"][at] += own["flow"].to_numpy()
                sums["n"][at] += own["n"].to_numpy()
                for c in STATES:
                    known = own[c].notna().to_numpy()
                    sums[c][at[known]] = own[c].to_numpy()[known]
                self._put(span, sums)
        first = pd.concat(borders).sort_values("seq", ignore_index=True)
        flow, state["row"] = joined_flows(first, state["row"])
        for span, own in self._due(first.assign(flow=flow.fillna(0.0)), state):
            sums = self._span(span)
            np.add.at(sums["flow"], own["k"].to_numpy(np.int64) - span * SPAN, own["flow"].to_numpy())
            self._put(span, sums)
        if state["next"] is None:
            state["next"] = int(np.nanmin(lo)) // DAY * DAY // self.freq_us
        self._keep(state)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0])
        end = timerValues.getCurrentWatermarkInMs() * 1000 // self.freq_us  # buckets before this one are over
        begin, was, out = state["next"], {c: np.nan if x is None else x for c, x in state["was"].items()}, []
        while begin < end:
            span = begin // SPAN
            to = min(end, (span + 1) * SPAN)
            own = {c: x[begin - span * SPAN : to - span * SPAN] for c, x in self._span(span).items()}
            now = {c: pd.Series(np.append(was[c], own[c])).ffill().to_numpy() for c in STATES}
            out.append(pd.DataFrame({
                "symbol": key[0],
                "t": np.arange(begin, to) * self.freq_us,
                "flow": own["flow"],
                "dmid_ticks": np.round(np.diff(now["mid"]) / self.tick, 9),
                "depth": now["depth"][1:],
                "spread_ticks": np.round(now["spread"][1:] / self.tick, 9),
                "n_events": own["n"],
                "mid": now["mid"][1:],
            }))
            if to == (span + 1) * SPAN and self.open.containsKey((span,)):
                self.open.removeKey((span,))
            begin, was = to, {c: float(x[-1]) for c, x in now.items()}
            if len(out) == SPANS:
                yield pd.concat(out, ignore_index=True)
                out = []
        self._keep(state | {"next": begin, "was": was})
        if out:
            yield pd.concat(out, ignore_index=True)

    def _due(self, rows: pd.DataFrame, state: dict) -> Iterator[tuple[int, pd.DataFrame]]:
        """Rows of buckets that were not given out, by span."""
        return iter((rows if state["next"] is None else rows[rows["k"] >= state["next"]]).groupby("span"))

    def _span(self, span: int) -> dict[str, np.ndarray]:
        span = int(span)
        if not self.open.containsKey((span,)):
            return {"flow": np.zeros(SPAN), "n": np.zeros(SPAN, np.int64), **{c: np.full(SPAN, np.nan) for c in STATES}}
        return {c: np.array(x, np.int64 if c == "n" else float) for c, x in json.loads(self.open.getValue((span,))[0]).items()}

    def _put(self, span: int, sums: dict[str, np.ndarray]) -> None:
        self.open.updateValue((int(span),), (json.dumps({c: x.tolist() for c, x in sums.items()}),))

    def _keep(self, state: dict) -> None:
        """Save the state, with one timer at the end of the next bucket to give out."""
        self.kept.update((json.dumps(state),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(state["next"] + 1) * self.freq_us // 1000))


def dense_buckets(book: DataFrame, freq_us: int, tick: float, late: str, bits: int = CHUNK_BITS) -> DataFrame:
    """The gap-free grid of each symbol of a streaming book (symbol, seq, timestamp, prices and sizes), from its first midnight on.

    A bucket is given out when the newest row is ``late`` past its end; rows that come for it later count nothing in it.
    seq should number rows without wide gaps, see stream_flow. The session needs the RocksDB state store.
    """
    timed = book.select("symbol", "seq", "timestamp", *PRICES, F.timestamp_micros("timestamp").alias("at")).withWatermark("at", late).drop("at")
    parts = chunked(timed, bits).applyInPandas(_parts(freq_us), PARTS)
    spans = parts.groupBy("symbol", "span").applyInPandas(_spans, PARTS)
    return spans.groupBy("symbol").transformWithStateInPandas(DenseBuckets(freq_us, tick), GRID, "append", "EventTime")

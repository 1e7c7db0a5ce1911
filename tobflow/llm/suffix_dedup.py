"""Suffix-array dedup: remove every byte covered by a string of ``size`` bytes that also starts anywhere else.

The suffix array is sparse. Every window of ``size`` bytes has an anchor, its gram of GRAM bytes with the least hash, so
equal windows have equal anchors at equal places, and only suffixes at anchors need sorting. Anchors whose gram
occurs once are dropped. Windows that share an anchor make up its context; equal contexts repeat as a whole.
Distinct contexts of one gram are sorted by what follows the gram and by what precedes it, reversed (deep-shallow
sorting, see deep_shallow). With the common prefixes of neighbours in both orders, two windows are equal just
if they are in one class of each order: enough bytes in common before the anchor, and enough behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import BROADCAST_BYTES, documents, keyed, table
from tobflow.llm.deep_shallow import sort_strings
from tobflow.llm.near_dup import mix

U = np.uint64
GRAM = 64
#: Bytes hashed at a time; longer texts are read in overlapping segments.
SEGMENT = 1 << 18
#: Distinct contexts of a gram beyond which they are dealt over blocks of its windows, and windows of such a block.
HOT, BLOCK = 2000, 20
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
#: Bases of the two rolling hashes: of grams, and of contexts.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
ANCHORS = "doc_id long, row_hash long, starts array<int>, windows array<int>, behind array<int>, grams array<long>, contexts array<long>"


CUT = "gram long, many boolean, doc_id long, row_hash long, anchor int, low int, high int, block int, key long, left binary, right binary"
SPANS = "doc_id long, row_hash long, start int, stop int"


class _Rolling:
    """Hashes of ranges of a buffer, modulo 2 ** 64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        if base not in self.powers or len(self.powers[base][0]) < n:
            m = max(n, 2 * SEGMENT)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.powers[base] = tuple(both)
        up, self.down = self.powers[base]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUES[data] * up[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k))


def find_anchors(data: np.ndarray, ok: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(start of the first window, windows, bytes from it to the anchor, gram hash, context hash) of each anchor.

    ok: which of the starts of data begin a window.
    """
    rolled = _Rolling(data, BASES[0])
    g = rolled.grams(GRAM)
    n, width = len(ok), size - GRAM + 1
    x = (g & ~U((1 << 24) - 1)) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < width:
        x = np.minimum(x[: n], x[width - span : width - span + n])
    anchor = (x[:n] & U((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(ok)
    anchor = anchor[starts]
    # a run of windows with one anchor; windows of different texts never share one
    new = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    p = anchor[new]
    return first, last - first + 1, p - first, g[p], _Rolling(data, BASES[1]).of(first, last + size) ^ mix((p - first).astype(np.uint64))


def _anchors(size: int):
    kinds = [pa.int64(), pa.int64(), *([pa.list_(pa.int32())] * 3), *([pa.list_(pa.int64())] * 2)]
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def flush(batch: pa.RecordBatch, parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        lengths = np.array([len(p[2]) for p in parts])
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        begins = np.cumsum(lengths) - lengths
        ok = np.zeros(len(data) - size + 1, bool)
        for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
            ok[b : b + n - size + 1] = True
        first, count, behind, grams, contexts = find_anchors(data, ok, size)
        part = np.searchsorted(begins, first, "right") - 1
        cuts = np.searchsorted(part, np.arange(len(parts) + 1))
        where = first - begins[part] + np.array([p[1] for p in parts])[part]
        rows = pa.array([p[0] for p in parts], pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, k.value_type)) for v, k in zip((where, count, behind, grams.view(np.int64), contexts.view(np.int64)), kinds[2:], strict=True)]
        return pa.record_batch([batch.column("doc_id").take(rows), batch.column("row_hash").take(rows), *lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for row, text in enumerate(batch.column("bytes")):
                text = text.as_py()
                for at in range(0, len(text) - size + 1, SEGMENT):
                    parts.append((row, at, text[at : at + SEGMENT + size - 1]))
                    held += len(parts[-1][2])
                    if held >= SEGMENT:
                        yield flush(batch, parts)
                        parts, held = [], 0
            if parts:
                yield flush(batch, parts)

    return run


def _cut_contexts(size: int):
    """The bytes of contexts, around the part that all windows of a block share."""
    names = [x.split()[0] for x in CUT.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *([pa.int32()] * 4), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, row_hash, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "bytes", "wanted")), strict=True):
                for w in wanted:
                    start, count, behind = w["start"], w["windows"], w["behind"]
                    p, width = start + behind, BLOCK if w["hot"] else size - GRAM + 1
                    low, high = behind - count + 1, behind  # bytes before the anchor, over the windows
                    for a in range(low // width * width, high + 1, width):
                        b = min(a + width - 1, size - GRAM)
                        # windows with a to b bytes before the anchor share text[p - a : p + size - b]
                        lo, hi = max(low, a), min(high, b)
                        left = text[p - hi : p - a][::-1]
                        shared = text[p - a : p + size - b]
                        rows.append((w["gram"], w["many"], doc_id, row_hash, p, lo, hi, a, xxhash.xxh3_64_intdigest(shared, a) >> 1, left, text[p - a : p + size - lo]))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def repeated_windows(left: list[bytes], right: list[bytes], many: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Which windows of each row repeat: those equal to a window of another row, or of a context with copies.

    left: the bytes before a row's shared part, reversed; right: the shared part and what follows it. Window t of
    a row (low <= t <= high) takes t bytes of left and size - t of right.
    """
    n = len(left)
    order_left, prefix_left = sort_strings(left)
    order_right, prefix_right = sort_strings(right)
    out = np.zeros((n, int(high.max()) + 1), bool)
    class_left, class_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for t in range(out.shape[1]):
        rows = np.flatnonzero((low <= t) & (t <= high))
        class_left[order_left] = np.cumsum(prefix_left < t)
        class_right[order_right] = np.cumsum(prefix_right < size - t)
        _, place, count = np.unique(class_left[rows] * (n + 1) + class_right[rows], return_inverse=True, return_counts=True)
        out[rows, t] = (count[place] > 1) | many[rows]
    return out


def _repeats(size: int, batch_rows: int = 20_000):
    """Spans of single contexts (those of no copies) whose windows repeat; rows come sorted by key."""

    def spans(table_: pa.Table) -> pa.RecordBatch:
        gram, block, key = (table_.column(c).to_numpy() for c in ("gram", "block", "key"))
        group = np.cumsum(np.append(False, (np.diff(gram) != 0) | (np.diff(block) != 0) | (np.diff(key) != 0)))
        table_ = table_.filter(pa.array(np.bincount(group)[group] > 1))
        rows: list[tuple] = []
        if table_.num_rows:
            many = table_.column("many").to_numpy(zero_copy_only=False)
            anchor, low, high, block = (table_.column(c).to_numpy().astype(np.int64) for c in ("anchor", "low", "high", "block"))
            found = repeated_windows(table_.column("left").to_pylist(), table_.column("right").to_pylist(), many, low - block, high - block, size)
            doc, row_hash = table_.column("doc_id").to_pylist(), table_.column("row_hash").to_pylist()
            for i in np.flatnonzero(found.any(axis=1) & ~many).tolist():
                t = np.flatnonzero(found[i])
                for r in np.split(t, np.flatnonzero(np.diff(t) > 1) + 1):
                    # window t starts block + t bytes before the anchor
                    begin = int(anchor[i] - block[i])
                    rows.append((doc[i], row_hash[i], begin - int(r[-1]), begin - int(r[0]) + size))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "row_hash", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < batch_rows:
                continue
            whole = pa.Table.from_batches(held)
            gram, block, key = (whole.column(c).to_numpy() for c in ("gram", "block", "key"))
            # the last key may go on in the next batch
            last = np.flatnonzero((gram != gram[-1]) | (block != block[-1]) | (key != key[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield spans(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            runs: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            out.append([{"start": a, "stop": b} for a, b in runs])
        yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(out, kind)], names=["doc_id", "row_hash", "spans"])


def repeated_spans(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, row_hash, spans (start, stop in bytes): the maximal runs of repeated bytes of a keyed() table, where there are any."""
    source = docs.select("doc_id", "row_hash", F.col("text").cast("binary").alias("bytes"))
    anchors = table(source.where(F.octet_length("bytes") >= size).mapInArrow(_anchors(size), ANCHORS), "anchors")
    single = anchors.select("doc_id", "row_hash", F.explode(F.arrays_zip("starts", "windows", "behind", "grams", "contexts")).alias("a"))
    single = single.select("doc_id", "row_hash", F.col("a.starts").alias("start"), F.col("a.windows").alias("windows"), F.col("a.behind").alias("behind"), F.col("a.grams").alias("gram"), F.col("a.contexts").alias("context"))
    grams = single.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
    grams = table(grams.where("n > 1").select("gram", (F.col("low") == F.col("high")).alias("one")), "grams")
    repeated = table(single.join(grams, "gram"), "repeated")
    contexts = repeated.where("NOT one").groupBy("gram", "context").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "row_hash", "start", "windows", "behind")])
    contexts = table(contexts, "contexts")
    copied = repeated.where("NOT one").join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"])
    whole = repeated.where("one").select("doc_id", "row_hash", "start", "windows").union(copied.select("doc_id", "row_hash", "start", "windows"))
    whole = whole.select("doc_id", "row_hash", "start", (F.col("start") + F.col("windows") + size - 1).cast("int").alias("stop"))

    crowds = table(contexts.groupBy("gram").agg((F.count("*") > HOT).alias("hot")), "crowds")
    one = contexts.join(crowds, "gram").select("doc_id", "row_hash", F.struct("gram", "context", (F.col("n") > 1).alias("many"), "start", "windows", "behind", "hot").alias("w"))
    wanted = table(one.groupBy("doc_id", "row_hash").agg(F.collect_list("w").alias("wanted")), "wanted")
    few = contexts.count() * 64 <= BROADCAST_BYTES
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.row_hash") == F.col("b.row_hash")]
    found = source.alias("a").join((F.broadcast(wanted) if few else wanted).alias("b"), same).select("a.doc_id", "a.row_hash", "a.bytes", "b.wanted")
    cut = found.mapInArrow(_cut_contexts(size), CUT).repartition("gram", "block", "key").sortWithinPartitions("gram", "block", "key")
    parts = cut.mapInArrow(_repeats(size), SPANS)
    every = whole.union(parts).groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return every.mapInArrow(_merge, "doc_id long, row_hash long, spans array<struct<start:int,stop:int>>")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            at, parts = 0, []
            for s in spans:
                parts.append(text[at : s["start"]])
                at = s["stop"]
            kept.append(b"".join([*parts, text[at:]]))
        yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), batch.column("bytes"), batch.column("spans"), pa.array(kept, pa.binary())], names=["doc_id", "row_hash", "bytes", "spans", "kept"])


def dedup_substrings(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, row_hash, n_bytes, n_removed, n_spans and kept (binary), a row per row of docs.

    Texts are UTF-8 bytes; matches never cross rows; strings are judged on the input. Null and empty texts, and
    those shorter than ``size``, stay as they are (null as empty); repeated rows repeat as a whole and lose all
    bytes that a string of ``size`` covers; a null doc_id is carried; a very long text is cut at anchors like
    any other; equal strings are all removed, so no tie arises; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs)
    spans = table(repeated_spans(rows, size), "spans")
    small = (spans.agg(F.sum(F.size("spans") * 8 + 32)).first()[0] or 0) <= BROADCAST_BYTES
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.row_hash") == F.col("b.row_hash")]
    joined = rows.select("doc_id", "row_hash", F.col("text").cast("binary").alias("bytes")).alias("a")
    joined = joined.join((F.broadcast(spans) if small else spans).alias("b"), same, "left").select("a.doc_id", "a.row_hash", "a.bytes", F.coalesce("b.spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"))
    out = joined.mapInArrow(_remove, "doc_id long, row_hash long, bytes binary, spans array<struct<start:int,stop:int>>, kept binary")
    n_bytes = F.octet_length("bytes").cast("long")
    return out.select("doc_id", "row_hash", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

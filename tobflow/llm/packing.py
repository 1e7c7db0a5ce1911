"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of a seed, which fill its window.

Documents are encoded once; document frequencies are counted over all of them. Full windows of long documents are
cut off where they are encoded. What remains of each document, with the terms of its whole text, is dealt over
shards by lexical closeness: documents are put in the order of a min-hash over their most telling terms, so those
that share such terms lie side by side, and any group, copies included, is split wherever a shard is full. A shard
packs: the longest unused remainder is the seed, the shard's inverted index ranks unused documents by BM25 against
the seed's most telling terms, and these fill the window, the last one cut where it is full. A window left open
goes on into the next shard of its partition; the last one is cut into sequences whose lengths are powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import documents, drop_tables, keyed, table
from tobflow.llm.encoding import encoder as shared_encoder
from tobflow.llm.encoding import slices
from tobflow.llm.near_dup import mix

U = np.uint64
WINDOWS = "windows array<struct<start:long,ids_crc32:long,ids:binary>>"
ENCODED = f"doc_id long, row_hash long, n_tokens long, start long, ids binary, terms binary, {WINDOWS}, term_docs array<long>"
ROUTED = "doc_id long, row_hash long, n_tokens long, start long, ids binary, terms binary, place long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Usual constants of BM25.
K1, B = 1.2, 0.75
#: Most telling terms of a document that its place among the shards depends on.
TELLING = 8
#: Added to the sequence_id of windows that one document fills.
OWN = 1 << 62


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    s = np.sort(ids, kind="stable")
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]), len(s) - 1)[: len(s)]
    return s[ends], np.diff(ends, prepend=-1)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(path: str | None, end_id: int, width: int, window: int, with_ids: bool):
    """A row per document: the remainder of its ids, the terms of a longer text, its full windows; at the end a row of document frequencies."""
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2
    kinds += [pa.list_(pa.struct([("start", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])), pa.list_(pa.int64())]
    names = ["doc_id", "row_hash", "n_tokens", "start", "ids", "terms", "windows", "term_docs"]
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path or default_tokenizer())
        docs = np.zeros(max(encoder.n_ids, end_id + 1), np.int64)
        if len(docs) > 1 << (8 * width):
            raise ValueError(f"ids do not fit {width} bytes")
        for whole in batches:
            for batch in slices(whole, "text", 2048):
                flat, counts = encoder.encode(batch.column("text"))
                flat, ends = flat.astype(dtype), np.cumsum(counts)
                starts, rest, terms, windows = [], [], [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    ids = np.append(flat[a:b], np.array(end_id, dtype))
                    docs[ids] += 1  # once for each distinct id
                    full = len(ids) // window * window
                    starts.append(full)
                    rest.append(ids[full:].tobytes())
                    terms.append(b"".join(x.astype("<u4").tobytes() for x in counted(ids)) if full else None)
                    parts = ((s, ids[s : s + window]) for s in range(0, full, window))
                    windows.append([{"start": s, "ids_crc32": _crc(x), "ids": x.astype("<u4").tobytes() if with_ids else None} for s, x in parts])
                found = [counts + 1, starts, rest, terms, windows]
                columns = [pa.array(x, k) for x, k in zip(found, kinds[2:7], strict=True)]
                yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), *columns, pa.nulls(len(rest), kinds[7])], names=names)
        yield pa.record_batch([*(pa.nulls(1, k) for k in kinds[:7]), pa.array([docs], kinds[7])], names=names)

    return run


@dataclass
class Ranking:
    """What BM25 needs of all documents: a weight for each term, and their mean length."""

    idf: np.ndarray
    mean_tokens: float

    def weights(self, terms: np.ndarray, tf: np.ndarray, length) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean_tokens))


def _terms(ids: np.ndarray, terms: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a whole document and their counts."""
    if terms is None:
        return counted(ids)
    both = np.frombuffer(terms, "<u4").reshape(2, -1)
    return both[0].astype(ids.dtype), both[1]


def lexical_place(ranking: Ranking, order: np.ndarray, terms: np.ndarray, tf: np.ndarray, length: int) -> int:
    """Where a document stands among the shards: the three of its most telling terms that come first in ``order``, a random order of all terms."""
    w = ranking.weights(terms, tf, length)
    top = np.argpartition(-w, TELLING)[:TELLING] if len(w) > TELLING else np.arange(len(w))
    first = np.sort(order[terms[top]])[:3].tolist()
    place = 0
    for x in (*first, *[first[-1]] * (3 - len(first))):
        place = place << 20 | x & 0xFFFFF
    return place


def term_order(n: int) -> np.ndarray:
    return np.argsort(mix(np.arange(n, dtype=np.uint64) + U(11))).argsort()


def _route(ranking: Ranking, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = term_order(len(ranking.idf))
        for batch in batches:
            rows = zip(batch.column("ids").to_pylist(), batch.column("terms").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)
            places = [lexical_place(ranking, order, *_terms(np.frombuffer(x, f"<u{width}"), t), n) for x, t, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])

    return run


@dataclass
class Remainder:
    """Ids of a document that are still to be packed; ``start``: how many of the document come before them."""

    doc_id: int | None
    n_tokens: int
    start: int
    ids: np.ndarray
    terms: np.ndarray
    tf: np.ndarray


def _top(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest positive scores, best first; ties by place."""
    found = np.flatnonzero(scores > 0)
    if len(found) > n:
        found = found[np.argpartition(-scores[found], n)[:n]]
    return found[np.lexsort((found, -scores[found]))]


class Index:
    """Inverted index of a shard."""

    def __init__(self, docs: list[Remainder], ranking: Ranking):
        n = np.array([len(d.terms) for d in docs], np.int64)
        self.n_docs, self.bounds = len(docs), np.append(0, np.cumsum(n))
        doc = np.repeat(np.arange(len(docs)), n)
        self.term = np.concatenate([d.terms for d in docs])
        lengths = np.array([d.n_tokens for d in docs], float)
        self.weight = ranking.weights(self.term, np.concatenate([d.tf for d in docs]), lengths[doc])
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.its_doc, self.its_weight = self.term[order], doc[order], self.weight[order]

    def scores(self, seed: int, query_terms: int) -> np.ndarray:
        """BM25 of every document of the shard against the seed's most telling terms."""
        lo, hi = int(self.bounds[seed]), int(self.bounds[seed + 1])
        asked = self.term[lo + _top(self.weight[lo:hi], query_terms)]
        first, last = np.searchsorted(self.by_term, asked), np.searchsorted(self.by_term, asked, "right")
        spots = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]) if len(asked) else np.empty(0, np.int64)
        return np.bincount(self.its_doc[spots], self.its_weight[spots], self.n_docs)


def pack_shard(docs: list[Remainder], ranking: Ranking, window: int, query_terms: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Full windows as lists of (document, offset in its remainder, length), and the pieces of the window left open."""
    sequences: list[list[tuple[int, int, int]]] = []
    index = Index(docs, ranking)
    start, left = [0] * len(docs), [len(d.ids) for d in docs]
    alive = np.array(left) > 0
    queue = [d for d in np.lexsort((np.arange(len(docs)), -np.array(left))).tolist() if alive[d]]  # longest first
    at = 0

    def next_unused() -> int | None:
        nonlocal at
        while at < len(queue) and not alive[queue[at]]:
            at += 1
        return queue[at] if at < len(queue) else None

    now: list[tuple[int, int, int]] = []
    while (seed := next_unused()) is not None:
        now, room = [(seed, start[seed], left[seed])], window - left[seed]
        alive[seed] = False
        for d in (*_top(index.scores(seed, query_terms) * alive, 64).tolist(), None):
            while room:
                other = d if d is not None else next_unused()
                if other is None:
                    break
                take = min(room, left[other])
                now.append((other, start[other], take))
                start[other], left[other], room = start[other] + take, left[other] - take, room - take
                alive[other] = left[other] > 0
                if d is not None:
                    break
        if not room:
            sequences.append(now)
            now = []
    return sequences, now


def powers_of_two(now: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces cut into sequences of 2 ** k ids."""
    sequences, now = [], list(now)
    while now:
        room = 1 << (sum(p[2] for p in now).bit_length() - 1)
        out = []
        while room:
            d, s, k = now.pop(0)
            take = min(k, room)
            out.append((d, s, take))
            room -= take
            if take < k:
                now.insert(0, (d, s + take, k - take))
        sequences.append(out)
    return sequences


def _pack(ranking: Ranking, window: int, shard_tokens: int, query_terms: int, with_ids: bool, width: int):
    """Packs a partition shard by shard, in the order of its rows."""
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        docs: list[Remainder] = []
        held = 0

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal docs, held, sequence
            sequences, still = pack_shard(docs, ranking, window, query_terms)
            if last:
                sequences, still = sequences + powers_of_two(still), []
            rows = []
            for pieces in sequences:
                offset = 0
                for d, s, n in pieces:
                    doc = docs[d]
                    ids = doc.ids[s : s + n]
                    rows.append((doc.doc_id, doc.start + s, n, _crc(ids), doc.n_tokens, sequence, offset) + ((ids.astype("<u4").tobytes(),) if with_ids else ()))
                    offset += n
                sequence += 1
            docs = [Remainder(docs[d].doc_id, docs[d].n_tokens, docs[d].start + s, docs[d].ids[s : s + n], docs[d].terms, docs[d].tf) for d, s, n in still]
            held = sum(len(d.ids) for d in docs)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "n_tokens", "start", "ids", "terms")]
            for doc_id, n, start, raw, terms in zip(*columns, strict=True):
                ids = np.frombuffer(raw, f"<u{width}")
                docs.append(Remainder(doc_id, n, start, ids, *_terms(ids, terms)))
                held += len(ids)
                if held >= shard_tokens:
                    yield packed(False)
        if docs:
            yield packed(True)

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, window: int = 2048, shard_tokens: int = 2_000_000, query_terms: int = 24, width: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids; with_ids adds the ids (little-endian unsigned 32-bit).

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Each id of each row lies in
    exactly one piece. Null text counts as empty and is its end id alone; a null doc_id is carried as null;
    repeated rows are packed as often as they occur; very long documents fill windows of their own, and only
    what remains of them is dealt to a shard; documents of one lexical place are ordered by a hash of their text
    and by doc_id; an empty table gives no rows; other columns are ignored. tokenizer: a file that executors
    can read, by default that of the installed public tokenizers; width: bytes of an id between the steps.
    """
    encoded = table(keyed(docs).mapInArrow(_encode(tokenizer, end_id, width, window, with_ids), ENCODED), "encoded")
    rows = encoded.where("term_docs IS NULL")
    n_docs, total, before = rows.agg(F.count("*"), F.sum("n_tokens"), F.sum("start")).first()
    # as many rows as the tokenizer has ids
    counts = encoded.where("term_docs IS NOT NULL").select(F.posexplode("term_docs").alias("term", "docs")).groupBy("term").agg(F.sum("docs").alias("docs")).orderBy("term").toPandas()
    df = counts["docs"].to_numpy(dtype=float)
    ranking = Ranking(np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) if len(df) else np.zeros(1), (total or 1) / max(1, n_docs))
    own = rows.select("doc_id", F.explode("windows").alias("w"), "n_tokens")
    own = table(own.select("doc_id", "w.start", F.lit(window).cast("long").alias("length"), "w.ids_crc32", F.col("n_tokens").alias("doc_tokens"), (F.monotonically_increasing_id() + OWN).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["w.ids"] * with_ids), "own-windows")
    left = rows.where(F.length("ids") > 0).select("doc_id", "row_hash", "n_tokens", "start", "ids", "terms")
    routed = table(left.mapInArrow(_route(ranking, width), ROUTED), "routed")
    drop_tables(encoded)
    shards = max(1, round(((total or 0) - (before or 0)) / shard_tokens))
    dealt = routed.repartitionByRange(shards, "place", "row_hash", "doc_id").sortWithinPartitions("place", "row_hash", "doc_id").drop("row_hash", "place")
    schema = PIECES + (", ids binary" if with_ids else "")
    return own.unionByName(dealt.mapInArrow(_pack(ranking, window, shard_tokens, query_terms, with_ids, width), schema))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))

"""Byte-pair encoding by speculation and verification, and decoding.

A word's ids are proposed by greedy longest match. A proposal is what exact merging gives if and only if each two
neighbours, merged alone, stay apart; that is tested for all neighbours of a batch at once, on arrays: the last pieces
of the left token and the first pieces of the right one, as they are before each merge, are looked up in the merge
table from the latest time to the earliest. Only words with a pair that fails are merged exactly. Normalizing and
splitting into words follow the tokenizer's file through the library, which encodes nothing here.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import documents, keyed, table
from tobflow.llm.encoding import PieceEncoder, slices
from tobflow.llm.token_store import default_tokenizer

#: Rank of what is never merged; pairs and words whose verdict or ids a worker keeps.
NEVER = np.iinfo(np.int64).max
KEPT_PAIRS = 2_000_000
IDS = "doc_id long, row_hash long, ids array<int>"
#: Words of printable ASCII text in lower case; fixed values: the pattern of the tokenizer's file.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PRINTABLE = re.compile(r"[\x21-\x7e]*\Z")


class MergeTable:
    """Merge ranks of a BPE model, the two parts of each token, and exact, greedy and verified encoding of words."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only a plain BPE model has verified proposals")
        self.size = max(self.vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([self.vocabulary[a + b] for a, b in pairs], np.int64)
        self.merges = {(a, b): (rank, m) for rank, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        order = np.argsort(keys := left * self.size + right)
        self.keys, self.ranks = keys[order], order
        #: By token: the rank of the merge that makes it (-1: a symbol), and its parts.
        self.rank, self.left, self.right = (np.full(self.size, -1, np.int64) for _ in range(3))
        self.rank[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        sound = np.ones(self.size, bool)
        sound[made] = self.apart(left, right, np.arange(len(made)))
        for m in np.argsort(self.rank).tolist():
            sound[m] &= self.rank[m] < 0 or (sound[self.left[m]] and sound[self.right[m]])
        #: Tokens that merging their own text gives; no other is ever proposed.
        self.proposed = {t: i for t, i in self.vocabulary.items() if sound[i]}
        self.longest = max(len(t) for t in self.proposed)
        self.pair_keys, self.pair_apart = np.empty(0, np.int64), np.empty(0, bool)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b side by side stay apart (counting merges ranked before ``before``).

        Going back in time, i is the last piece of a until its parent (rank ti) is merged, j the first piece of b until
        its parent (rank tj) is. A merge of (i, j) happens if it ranks before both; at equal ranks the leftmost place
        goes first, which is the parent in a, and (i, j) before the parent in b.
        """
        out = np.ones(len(a), bool)
        rows, i, j = np.arange(len(a)), a.copy(), b.copy()
        ti, tj = np.full(len(a), NEVER), np.full(len(a), NEVER)
        limit = np.full(len(a), NEVER) if before is None else before
        while len(rows):
            m = self.merge_rank(i, j)
            joined = (m < ti) & (m <= tj) & (m < limit[rows])
            out[rows[joined]] = False
            go = ~joined & ((self.rank[i] >= 0) | (self.rank[j] >= 0))
            rows, i, j, ti, tj = rows[go], i[go], j[go], ti[go], tj[go]
            later = self.rank[i] >= self.rank[j]
            ti, i = np.where(later, self.rank[i], ti), np.where(later, self.right[i], i)
            tj, j = np.where(later, tj, self.rank[j]), np.where(later, j, self.left[j])
        return out

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` by a table of the pairs met so far."""
        keys, back = np.unique(a * self.size + b, return_inverse=True)
        if len(self.pair_keys) > KEPT_PAIRS:
            self.pair_keys, self.pair_apart = np.empty(0, np.int64), np.empty(0, bool)
        at = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            known = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys
        if not known.all():
            new = keys[~known]
            self.pair_keys = np.insert(self.pair_keys, at[~known], new)
            self.pair_apart = np.insert(self.pair_apart, at[~known], self.apart(new // self.size, new % self.size))
        return self.pair_apart[np.searchsorted(self.pair_keys, keys)][back]

    def propose(self, word: str) -> list[int]:
        """Ids of the longest tokens from left to right; the last ends the word."""
        n, at, out, get = len(word), 0, [], self.proposed.get
        while at < n:
            end = min(n, at + self.longest)
            while (found := get(word[at:end] if end < n else word[at:] + self.suffix)) is None:
                end -= 1
                if end == at:
                    raise ValueError(f"no token for {word[at]!r}")
            out.append(found)
            at = end
        return out

    def exact(self, word: str) -> list[int]:
        """Ids by merging the best-ranked, leftmost pair until none is left."""
        ids = [self.vocabulary[c] for c in word[:-1]] + [self.vocabulary[word[-1] + self.suffix]]
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, made = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt], after[k] = made, -1, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if found := get((made, ids[after[k]])):
                    heapq.heappush(heap, (found[0], k, made, ids[after[k]], found[1]))
            if (p := before[k]) >= 0 and (found := get((ids[p], made))):
                heapq.heappush(heap, (found[0], p, ids[p], made, found[1]))
        return [x for x in ids if x >= 0]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (a non-empty string of the model's symbols)."""
        out = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(out)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            failed = inside[~self.verified(flat[inside], flat[inside + 1])]
            for k in np.unique(owner[failed]).tolist():
                out[k] = self.exact(words[k])
        return out


class SpeculativeEncoder(PieceEncoder):
    """A PieceEncoder whose pieces are encoded by a MergeTable."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        self.table = MergeTable(spec)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        super().__init__(path)
        if self.kind != "drops":
            raise ValueError("this encoder is for tokenizers that match words and drop white space")

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text, as strings of the model's symbols."""
        if _PRINTABLE.match(piece):
            return _ASCII_WORDS.findall(piece.lower())
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(piece))]

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        words = [self.words(p) for p in pieces]
        distinct = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        ids = self.table.encode(list(distinct))
        return [ids[distinct[own[0]]] if len(own) == 1 else [i for w in own for i in ids[distinct[w]]] for own in words]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; an added token is one id wherever it stands."""
        parts = [self.marks.split(t) if self.marks else [t] for t in texts]
        found = iter(self._encoded([p for own in parts for p in own[::2]]))
        return [[i for k, p in enumerate(own) for i in ([self.added[p]] if k % 2 else next(found))] for own in parts]

    def _encode_new(self, pieces: list[str]) -> np.ndarray:
        ids = self._encoded(pieces)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self._learn(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), np.cumsum(counts))
        return np.arange(first, first + len(pieces))


@cache
def speculative_encoder(path: str) -> SpeculativeEncoder:
    return SpeculativeEncoder(path)


@cache
def _tokens(path: str) -> pa.Array:
    """The token of each id; ids without one are null."""
    spec = json.loads(Path(path).read_text())
    if spec.get("decoder") is not None:
        raise ValueError("this decoder is for tokenizers whose tokens are joined by spaces")
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = speculative_encoder(path or default_tokenizer())
        for whole in batches:
            for batch in slices(whole, "text", 2048):
                flat, counts = encoder.encode(batch.column("text"))
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), ids], names=["doc_id", "row_hash", "ids"])

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path or default_tokenizer())
        for batch in batches:
            lists = batch.column("ids")
            ids = np.asarray(pc.fill_null(lists.flatten(), -1), np.int64)
            known = (ids >= 0) & (ids < len(tokens))
            known[known] = np.asarray(tokens.is_valid())[ids[known]]
            ends = np.append(0, np.cumsum(np.asarray(pc.fill_null(lists.value_lengths(), 0), np.int64)))
            kept = np.append(0, np.cumsum(known))[ends]
            words = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), tokens.take(pa.array(ids[known])))
            text = pc.if_else(lists.is_valid(), pc.binary_join(words, " "), pa.scalar(None, pa.string()))
            yield pa.record_batch([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """doc_id, row_hash and ids of every row of docs, as the tokenizer gives them without special tokens of its own.

    A null or empty text has no ids; null doc_ids and repeated rows are encoded like others; a text is encoded whole,
    however long, from its distinct pieces (at most 8 MB of texts at a time, unless one is longer); an empty table gives
    no rows; other columns are ignored.
    """
    return keyed(docs).select("doc_id", "row_hash", "text").mapInArrow(_encode(tokenizer), IDS)


def decode(encoded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Adds decoded, the tokens of ids joined by spaces, to rows with ids array<int>.

    Special tokens are kept; ids without a token are left out; no ids give an empty text, null ids a null one.
    """
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(tokenizer), f"{ddl}, decoded string")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids its text has, and the digests of the ids and of the text decoded from them."""
    rows = decode(encode(documents(spark, sf_dir)))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return table(rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")), "bpe")

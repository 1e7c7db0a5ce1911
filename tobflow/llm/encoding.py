"""Encoding many texts with a public tokenizer, one piece between spaces at a time.

Two kinds of tokenizer are told by their files: byte-level ones that keep a space with the word behind it, and
those that match words and drop white space. Both always part a text before a single space or line feed, and
between a letter and punctuation, so the pieces between such places have the same ids wherever they stand. A worker
encodes each distinct piece once and knows it by a 128-bit hash in sorted arrays. Texts of any other white space,
texts that hold an added token, and all texts of any other tokenizer go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tobflow.llm.near_dup import mix

U = np.uint64
#: Pieces kept by a worker's cache (about 50 bytes each), and how many are encoded in one string.
CACHE = 1_500_000
TOGETHER = 256
#: Begins a piece that has no space before it; texts that hold it are encoded whole.
MARK = "\x01"
#: Where a letter meets ASCII punctuation, and the word pattern of the space-dropping tokenizer.
_LETTER_PUNCT = "([0-9A-Za-zÀ-ÖØ-öø-\u012f\u0131-ſ])([!-/:-@\\[-`{-~])"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space that a space-keeping tokenizer does not treat one by one, control characters included.
_NOT_PLAIN = "  | \\n|\\n |\\n\\n\\n|\\n\\n$|^ | $|[\\x00-\\x09\\x0b-\\x1f\x85\xa0  -     　]"


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch: at most ``rows`` rows, and ``size`` bytes of the column unless one row has more."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def _kind(spec: dict) -> str:
    """``keeps`` or ``drops`` spaces, for the tokenizers whose pieces are known to be apart; else ``whole``."""
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normalizer is None:
        return "keeps"
    parts = pre.get("pretokenizers") or [{}]
    if pre.get("type") == "Sequence" and parts[0].get("pattern") == {"Regex": _WORDS} and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
        return "drops" if {"type": "Lowercase"} in (normalizer or {}).get("normalizers", []) else "whole"
    return "whole"


def piece_hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string: sums of hashes of its (byte, place) pairs."""
    lengths = np.asarray(pc.binary_length(pieces), np.int64)
    data = np.frombuffer(b"".join(pieces.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths)
    cells = data + U(1) + ((np.arange(len(data)) - np.repeat(ends - lengths, lengths)).astype(np.uint64) << U(9))
    cells = mix(cells * U(0x9E3779B97F4A7C15))
    out = []
    for of_cells in (cells, cells * (cells >> U(7) | U(1))):
        total = np.append(U(0), np.cumsum(of_cells))  # modulo 2 ** 64
        out.append(mix(total[ends] - total[ends - lengths] + lengths.astype(np.uint64)))
    return out[0], out[1]


class PieceEncoder:
    """encode(texts) gives the ids of all texts (an Arrow string array), one after another, and how many each has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(json.loads(Path(path).read_text()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Matches texts that go through the library whole: an added token is one id wherever it stands.
        self.apart = "(?i)" + "|".join(map(re.escape, [*added, MARK]))
        if self.kind == "keeps":
            self.apart += "|" + _NOT_PLAIN
        vocabulary = self.tokenizer.get_vocab()
        self.n_ids = max(vocabulary.values()) + 1
        #: Bytes of each id (a byte-level vocabulary spells a byte as one character).
        self.id_bytes = np.zeros(self.n_ids, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token)
        #: What parts pieces that are encoded together, where they have no spaces of their own, and its id.
        self.between = "\n" if self.kind == "keeps" else " \0 "
        self.between_id = self._ids([self.between])[0][-1]
        self.forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.h1, self.h2, self.at = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.ends = array("I"), array("Q", [0])

    def _encode_new(self, pieces: list[str]) -> np.ndarray:
        """Encode pieces, many in one string, add their ids to the cache, and return their places there."""
        places = np.empty(len(pieces), np.int64)
        spaced = self.kind == "keeps"
        groups: dict[str, list[int]] = {"alone": [], "spaced": [], "parted": []}
        for i, p in enumerate(pieces):
            if spaced:
                groups["spaced" if p[0] != MARK else "alone" if len(p) == 1 or p[1] == "\n" else "parted"].append(i)
            else:
                groups["alone" if "\0" in p else "parted"].append(i)
        for i in groups["alone"]:
            ids = np.array(self._ids([pieces[i].removeprefix(MARK)])[0], np.uint32)
            places[i] = self._learn(ids, np.array([len(ids)]))
        for kind in ("spaced", "parted"):
            parts = [groups[kind][a : a + TOGETHER] for a in range(0, len(groups[kind]), TOGETHER)]
            words = [[pieces[i] for i in part] for part in parts]
            if spaced and kind == "parted":
                words = [[w[1:] for w in group] for group in words]
            texts = [" " + " ".join(g) if kind == "spaced" else self.between.join(g) for g in words]
            for part, group, ids in zip(parts, words, self._ids(texts), strict=True):
                found = np.array(ids, np.uint32)
                if kind == "spaced":
                    bytes_to = np.cumsum(np.fromiter(map(len, map(str.encode, group)), np.int64, len(group)) + 1)
                    ends = np.searchsorted(np.cumsum(self.id_bytes[found]), bytes_to) + 1
                else:
                    marks = np.flatnonzero(found == self.between_id)
                    found, ends = np.delete(found, marks), np.append(marks, len(found)) - np.arange(len(marks) + 1)
                if len(ends) != len(part) or ends[-1] != len(found):
                    raise ValueError("ids do not follow the pieces")
                first = self._learn(found, ends)
                places[part] = np.arange(first, first + len(part))
        return places

    def _learn(self, ids: np.ndarray, ends: np.ndarray) -> int:
        first, base = len(self.ends) - 1, len(self.ids)
        self.ids.frombytes(ids.tobytes())
        self.ends.frombytes((ends + base).astype(np.uint64).tobytes())
        return first

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of texts, and how many each text has."""
        if self.kind == "keeps":
            texts = pc.replace_substring_regex(texts, _LETTER_PUNCT, f"\\1 {MARK}\\2")
            texts = pc.replace_substring(texts, "\n", f" {MARK}\n {MARK}")
            # the first piece has no space before it
            texts = pc.binary_join_element_wise(pa.scalar(MARK, texts.type), texts, pa.scalar("", texts.type))
        else:
            texts = pc.replace_substring_regex(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), _LETTER_PUNCT, "\\1 \\2")
        lists = pc.split_pattern(texts, " ")
        flat, counts = lists.flatten(), np.asarray(lists.value_lengths(), np.int64)
        if self.kind == "keeps":
            return flat, counts
        full = np.asarray(pc.binary_length(flat)) > 0
        return flat.filter(pa.array(full)), np.diff(np.append(0, full.cumsum())[np.append(0, counts.cumsum())])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = np.ones(len(texts), bool) if self.kind == "whole" else np.asarray(pc.match_substring_regex(texts, self.apart), bool)
        if not apart.any():
            return self._encode_pieces(texts)
        found = self._ids(texts.filter(pa.array(apart)).to_pylist())
        ids, n = self._encode_pieces(texts.filter(pa.array(~apart)))
        counts = np.zeros(len(texts), np.int64)
        counts[apart], counts[~apart] = list(map(len, found)), n
        out, whole = np.empty(int(counts.sum()), np.uint32), np.repeat(apart, counts)
        out[whole], out[~whole] = np.fromiter(chain.from_iterable(found), np.uint32), ids
        return out, counts

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        flat, counts = self._split(texts)
        if not len(flat):
            return np.empty(0, np.uint32), counts
        coded = flat.dictionary_encode()
        if len(self.ends) > CACHE:
            self.forget()
        h1, h2 = piece_hashes(coded.dictionary)
        spot = np.searchsorted(self.h1, h1)
        inside = np.minimum(spot, max(0, len(self.h1) - 1))
        hit = (self.h1[inside] == h1) & (self.h2[inside] == h2) if len(self.h1) else np.zeros(len(h1), bool)
        at = np.empty(len(h1), np.int64)
        at[hit] = self.at[inside[hit]]
        fresh = np.flatnonzero(~hit)
        if len(fresh):
            at[fresh] = self._encode_new(coded.dictionary.take(pa.array(fresh)).to_pylist())
            order = fresh[np.argsort(h1[fresh], kind="stable")]
            where = np.searchsorted(self.h1, h1[order])
            self.h1, self.h2, self.at = (np.insert(old, where, new[order]) for old, new in ((self.h1, h1), (self.h2, h2), (self.at, at)))
        learned = pa.LargeListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int64)), pa.array(np.frombuffer(self.ids, np.uint32)))
        taken = learned.take(pa.array(at[np.asarray(coded.indices)]))
        total = np.append(0, np.asarray(taken.value_lengths()).cumsum())
        return taken.flatten().to_numpy(), np.diff(total[np.append(0, counts.cumsum())])


@cache
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer; its cache serves all tasks of the worker."""
    return PieceEncoder(path)

"""Plain single-machine versions of the corpus operators, and tables that tests share."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

DATA = "/root/testdata"
#: Columns beyond those of documents have names that operators use inside.
MESSY = "doc_id long, text string, lang string, source string, n_chars int, row_hash string, label string, node string, batch int, bytes string, shard int, hub int, t string"
LINE = "a line that many documents share, long enough"


def messy(spark):
    """Nulls, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 7000}" for i in range(60_000))
    texts = [
        (1, f"{LINE}\nfirst own line of text\n  {LINE.upper()}  "), (2, f"{LINE}\nsecond"), (3, LINE), (3, LINE),
        (4, None), (5, ""), (6, long_text), (7, long_text), (8, "one two three"), (9, "One TWO  three"),
        (None, f"{LINE}\nno id"), (None, None), (10, " \n\n \t"), (11, "x"), (12, "grüße " * 50), (13, "grüße " * 50),
    ]
    rows = [(i, t, "en", None, 5, "h", "l", "n", 0, "b", 1, 2, "t") for i, t in texts]
    return spark.createDataFrame(rows, MESSY)


def empty(spark):
    return spark.createDataFrame([], MESSY)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# ---- 1: lines


def line_dedup(docs: list[tuple], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    key = lambda line: ascii_lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
    holders: dict[str, set] = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    last = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


# ---- 4: shingles


def shingles(text: str | None, k: int) -> frozenset:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_dup(docs: list[tuple], k: int = 4, percent: int = 80) -> list[tuple]:
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


# ---- 5: substrings


def substring_dedup(docs: list[tuple], size: int = 200) -> list[tuple]:
    data = [(t or "").encode() for _, t in docs]
    starts = Counter(x[i : i + size] for x in data for i in range(len(x) - size + 1))
    out = []
    for (d, _), x in zip(docs, data, strict=True):
        gone = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - size + 1):
            if starts[x[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        covered = np.cumsum(gone)[: len(x)] > 0
        kept = bytes(b for b, c in zip(x, covered.tolist(), strict=True) if not c)
        runs = int(np.sum(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
        out.append((d, len(x), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


# ---- 10: vectors


def vector_dedup(rows: list[tuple], least: float = 0.98) -> list[tuple]:
    ok, unit = [], []
    for _, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v is not None else np.empty(0)
        good = label is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(np.any(x))
        ok.append(good)
        x = x / np.abs(x).max() if good else x
        unit.append(x / np.linalg.norm(x) if good else x)
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    seen: dict[int, int] = {}
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in seen:
                seen[j] = rows[i][0]
                stack += near[j]
    return sorted(((r[0], len(near[i]), seen[i], r[0] == seen[i]) for i, r in enumerate(rows)), key=str)

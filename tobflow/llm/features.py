"""Words of a text and hashed character n-grams, computed for many words at once, and bounded training samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tobflow.llm.common import keyed, training_fold
from tobflow.llm.near_dup import mix

U = np.uint64
BASE = U(0x100000001B3)


def char_grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): one entry per n-gram of each word between < and >, and one for the whole word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    owner_of = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))
    owners, ids = [], []
    rolled, size = data + U(1), 1
    for n in sorted(sizes):
        while size < n:
            rolled = rolled[:-1] * BASE + data[size:] + U(1)
            size += 1
        ok = np.flatnonzero(left[: len(rolled)] >= n)
        owners.append(owner_of[ok])
        ids.append(mix(rolled[ok] + U(n)) % U(buckets))
    powers = mix(np.arange(len(data), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64) + U(1)) | U(1)
    whole = np.add.reduceat((data + U(1)) * powers, starts) if len(words) else np.empty(0, np.uint64)
    owners.append(np.arange(len(words)))
    ids.append(mix(whole) % U(buckets))
    return np.concatenate(owners), np.concatenate(ids).astype(np.int64)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int) -> pd.DataFrame:
    """At most per_class labelled texts of each class, as a pandas table of text and label.

    The documented bound of what a classifier learns from: rows outside the held-out fold, in the order of a
    hash of their doc_id, with texts of at most ``longest`` characters, so that the sample fits the driver. A doc_id
    with labels of both classes has no class, and is left out; of several texts the least is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (training_fold() != 0))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where(F.col("label") == F.col("other"))
    picked = [known.where(F.col("label") == y).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = picked[0].union(picked[1])
    rows = keyed(docs).where(F.length("text") <= longest).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    out = rows.toPandas().sort_values(["doc_id", "text"]).drop_duplicates(["doc_id"], ignore_index=True)
    return out[["text", "label"]]

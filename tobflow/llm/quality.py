"""Quality classifier: learned vectors of hashed words, character n-grams and word pairs, averaged per document, softmax.

Training is plain numpy stochastic gradient descent on the vectors and the output layer. As the output is linear
in the average, scoring folds both into one number per bucket; a worker then keeps one sum per distinct word.
A pair of equal words has a bucket of its own, whatever the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import documents, keyed, training_fold
from tobflow.llm.features import char_grams, training_sample
from tobflow.llm.near_dup import mix

U = np.uint64
SIZES = (3, 4)
BUCKETS = 1 << 16
DIM = 16
CACHE = 600_000
PAIR = U(0x9E3779B97F4A7C15)


@dataclass
class Model:
    vectors: np.ndarray  # buckets x DIM
    output: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def word_keys(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_buckets(keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each pair of neighbouring words of consecutive documents; equal words give bucket 0."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    inside = doc[1:] == doc[:-1]
    a, b = keys[:-1][inside], keys[1:][inside]
    bucket = (U(1) + mix(a * PAIR + b) % U(BUCKETS - 1)).astype(np.int64)
    return doc[1:][inside], np.where(a == b, 0, bucket)


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 30, batch: int = 64, rate: float = 0.5, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    docs = [t.encode().split() for t in texts]
    vocabulary: dict[bytes, int] = {}
    flat = np.array([vocabulary.setdefault(w, len(vocabulary)) for d in docs for w in d], np.int64)
    words, lengths = list(vocabulary), np.array([len(d) for d in docs], np.int64)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32))
    if not words:
        return model
    owner, grams = char_grams(words, SIZES, BUCKETS)
    order = np.argsort(owner, kind="stable")
    grams, ends = grams[order], np.cumsum(np.bincount(owner, minlength=len(words)))
    begins = ends - np.bincount(owner, minlength=len(words))
    pair_doc, pair_bucket = pair_buckets(word_keys(words)[flat], lengths)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.cumsum(lengths) - lengths
    pair_ends = np.searchsorted(pair_doc, np.arange(len(docs)), "right")
    pair_starts = np.searchsorted(pair_doc, np.arange(len(docs)))
    for d in range(len(docs)):
        w, count = np.unique(flat[starts[d] : starts[d] + lengths[d]], return_counts=True)
        sizes = ends[w] - begins[w]
        at = np.repeat(begins[w] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids = np.concatenate([grams[at], pair_bucket[pair_starts[d] : pair_ends[d]]])
        weight = np.concatenate([np.repeat(count, sizes), np.ones(pair_ends[d] - pair_starts[d])])
        kept, place = np.unique(ids, return_inverse=True)
        total = np.bincount(place, weight, len(kept))
        rows.append((kept, (total / max(1.0, total.sum())).astype(np.float32)))
    target = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) * 20
        for part in np.array_split(rng.permutation(len(docs)), -(-len(docs) // batch)):
            ids = np.concatenate([rows[d][0] for d in part])
            share = np.concatenate([rows[d][1] for d in part])
            who = np.repeat(np.arange(len(part)), [len(rows[d][0]) for d in part])
            # the batch's averages, by document and dimension
            used, place = np.unique(ids, return_inverse=True)
            dense = np.zeros((len(part), len(used)), np.float32)
            dense[who, place] = share
            average = dense @ model.vectors[used]
            z = average @ model.output + model.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            off = (target[part] - z / z.sum(axis=1, keepdims=True)) / len(part)
            model.vectors[used] += step * 4 * (dense.T @ (off @ model.output.T))
            model.output += step * 0.1 * (average.T @ off)
            model.bias += step * 0.02 * off.sum(axis=0)
    return model


class Scorer:
    def __init__(self, model: Model):
        self.weights, self.bias = model.folded()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.sizes, self.keys = np.empty(0), np.empty(0), np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        tokens = [t.split() for t in texts]
        fresh = list(set().union(*tokens).difference(self.known))
        if len(self.known) > CACHE:
            self.forget()
            fresh = list(set().union(*tokens))
        if fresh:
            owner, grams = char_grams(fresh, SIZES, BUCKETS)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.weights[grams], len(fresh))])
            self.sizes = np.concatenate([self.sizes, np.bincount(owner, minlength=len(fresh))])
            self.keys = np.concatenate([self.keys, word_keys(fresh)])
        find, n = self.known.__getitem__, len(texts)
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        at = np.fromiter((find(w) for t in tokens for w in t), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(n), lengths)
        pair_doc, pair_bucket = pair_buckets(self.keys[at], lengths)
        total = np.bincount(doc, self.sums[at], n) + np.bincount(pair_doc, self.weights[pair_bucket], n)
        size = np.bincount(doc, self.sizes[at], n) + np.bincount(pair_doc, minlength=n)
        return 1 / (1 + np.exp(-(total / np.maximum(size, 1) + self.bias)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(scorer(batch.column("bytes").to_pylist()))], names=["doc_id", "row_hash", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, longest: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, row_hash, held_out, score and predicted, a row per row of docs.

    Learns from at most per_class labelled texts a class outside the held-out fold (see training_sample), whose
    texts come from docs; a score depends on the text alone. Null and empty texts get the score of an average of
    nothing; a null doc_id is held out; repeated rows score alike; a very long text is scored whole (only the
    sample leaves out texts above ``longest``); without labels the model is untrained; an empty table gives no rows; other columns are ignored.
    """
    sample = training_sample(docs, labels, "quality", per_class, longest)
    model = fit(sample["text"].tolist(), sample["label"].to_numpy(dtype=np.int64))
    source = keyed(docs).select("doc_id", "row_hash", F.col("text").cast("binary").alias("bytes"))
    out = source.mapInArrow(_score(model), "doc_id long, row_hash long, score double")
    return out.select("doc_id", "row_hash", F.coalesce(training_fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("row_hash")

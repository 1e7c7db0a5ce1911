"""Toxicity: a linear-chain conditional random field over tokens, with document scores from its marginals.

Two states, clean and toxic. A token's emission is the sum of learned weights of its hashed word and character
n-grams; a 2 x 2 table scores state changes. Training labels tokens first: a word is evidence where it is
far more frequent in toxic documents than in clean ones and has many different left neighbours there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import documents, keyed, training_fold
from tobflow.llm.features import char_grams, training_sample

EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SIZES = (4, 6, 8)
#: Bytes of the stems that training looks at.
STEM = (5, 9)
BUCKETS = 1 << 17
#: Tokens of a chain; longer documents are consecutive chains.
CHAIN = 96
CACHE = 1_000_000
#: Of a document, see document_features.
FEATURES = 8
TOKEN = re.compile(rb"[^\x09-\x0d\x20]+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    change: np.ndarray
    calibration: np.ndarray


def cores(tokens: list[bytes]) -> list[bytes]:
    """Tokens without outer punctuation (a token of nothing else stays)."""
    return [t.strip(EDGES) or t for t in tokens]


def emissions(words: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    owner, ids = char_grams(words, SIZES, BUCKETS)
    return np.bincount(owner, weights[ids], len(words)) + bias


def marginals(e: np.ndarray, mask: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains side by side: P(toxic) per token, expected changes (2 x 2), log Z per chain.

    e: emission of the toxic state, chains x tokens (clean scores 0); mask: which cells are tokens.
    """
    chains, length = e.shape
    x = np.stack([np.zeros_like(e), e], axis=2)
    top = x.max(axis=2, keepdims=True)
    x = np.exp(x - top)
    move = np.exp(change)
    alpha, scale = np.empty_like(x), np.ones((chains, length))
    now = None
    for t in range(length):
        step = x[:, 0] if t == 0 else (now @ move) * x[:, t]
        s = step.sum(axis=1)
        step = step / s[:, None]
        if t:
            step = np.where(mask[:, t, None], step, now)
            s = np.where(mask[:, t], s, 1.0)
        alpha[:, t], scale[:, t] = step, s
        now = step
    beta = np.ones((chains, 2))
    p, pairs = np.empty((chains, length)), np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        g = alpha[:, t] * beta
        p[:, t] = g[:, 1] / g.sum(axis=1)
        if t:
            ahead = x[:, t] * beta
            joint = alpha[:, t - 1, :, None] * move[None] * ahead[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[mask[:, t]].sum(axis=0)
            back = ahead @ move.T
            back /= back.sum(axis=1, keepdims=True)
            beta = np.where(mask[:, t, None], back, beta)
    p[~mask] = 0.0
    return p, pairs, (np.log(scale) * mask + top[:, :, 0] * mask).sum(axis=1)


def chains_of(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per-token values of consecutive documents as (chains x CHAIN, mask, document of each chain)."""
    counts = -(-lengths // CHAIN)
    doc = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.cumsum(counts) - counts, lengths) + within // CHAIN
    out, mask = np.zeros((len(doc), CHAIN)), np.zeros((len(doc), CHAIN), bool)
    out[row, within % CHAIN], mask[row, within % CHAIN] = values, True
    return out, mask, doc


def document_features(p: np.ndarray, mask: np.ndarray, doc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, logit of its largest marginal, log and root of its expected toxic tokens, their share, its length, and products."""
    peak, mass = np.zeros(len(lengths)), np.zeros(len(lengths))
    np.maximum.at(peak, doc, p.max(axis=1, initial=0.0))
    np.add.at(mass, doc, (p * (p > 0.02)).sum(axis=1))
    peak = np.clip(peak, 1e-6, 1 - 1e-6)
    share, size = np.sqrt(mass / np.maximum(lengths, 1)), np.log1p(lengths) / 5
    return np.stack([np.ones(len(lengths)), np.log(peak / (1 - peak)) / 4, np.log1p(mass), np.minimum(mass, 3), 10 * share, size, 10 * share * size, np.log1p(mass) * size], axis=1)


def _units(word: bytes) -> list[bytes]:
    return [b"<" + word + b">", *(b"<" + word[:n] for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))]


def evidence(docs: list[np.ndarray], words: list[bytes], labels: np.ndarray, neighbours: int, odds: float) -> np.ndarray:
    """Per word of the vocabulary, whether one of its units (the whole word, or a stem that starts many words) marks toxic texts.

    docs: word numbers per text. Such a unit's rate among the tokens of toxic texts is so many times that in clean
    ones, with so many different left neighbours there (copies of one text have the same), and a stem starts as
    many different words. Only units that toxic texts hold are kept, so clean texts cost no memory.
    """
    size, lengths = len(words), np.array([len(d) for d in docs], np.int64)
    marked = np.zeros(size, bool)
    if not lengths.sum():
        return marked
    flat, toxic = np.concatenate(docs), np.repeat(labels == 1, lengths)
    before = np.concatenate([[0], flat[:-1] + 1])
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
    count1, count0 = np.bincount(flat[toxic], minlength=size), np.bincount(flat[~toxic], minlength=size)
    number: dict[bytes, int] = {}
    owners, units = [], []
    for w in np.flatnonzero(count1).tolist():
        for u in _units(words[w]):
            owners.append(w)
            units.append(number.setdefault(u, len(number)))
    for w in np.flatnonzero(count1 == 0).tolist():
        for u in _units(words[w]):
            if (k := number.get(u)) is not None:
                owners.append(w)
                units.append(k)
    owner, unit = np.array(owners, np.int64), np.array(units, np.int64)
    whole = np.fromiter((u[-1:] == b">" for u in number), bool, len(number))
    n1, n0 = toxic.sum(), (~toxic).sum()
    rate1, rate0 = np.bincount(unit, count1[owner], len(number)) + 0.5, np.bincount(unit, count0[owner], len(number)) + 0.5
    frequent = rate1 / (n1 + 1) >= odds * rate0 / (n0 + 1)
    some = frequent[unit] & (count1[owner] > 0)
    kinds = np.bincount(unit[some], minlength=len(number))
    order = np.flatnonzero(some)[np.argsort(owner[some], kind="stable")]
    per_word = np.bincount(owner[order], minlength=size)
    pairs = np.unique(flat[toxic] * (size + 1) + before[toxic])
    word, left = pairs // (size + 1), pairs % (size + 1)
    times = per_word[word]
    at = np.repeat((np.cumsum(per_word) - per_word)[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    different = np.unique(unit[order[at]] * (size + 1) + np.repeat(left, times)) // (size + 1)
    telling = frequent & (np.bincount(different, minlength=len(number)) >= neighbours) & (whole | (kinds >= neighbours))
    marked[owner[telling[unit]]] = True
    return marked


def calibrate(x: np.ndarray, labels: np.ndarray, *, decay: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Coefficients of the logistic score of x: the optimum of the class-balanced likelihood, by Newton steps that are halved while they lead uphill."""
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((share * (np.logaddexp(0, z) - labels * z)).sum() + decay / 2 * (b @ b))

    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (share * (labels - p)) - decay * b
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(b)), slope)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-12:
            step = step / 2
        b = b + step
        if np.abs(step).max() <= 1e-9:
            break
    return b


def fit(texts: list[str], labels: np.ndarray, *, steps: int = 80, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit token weights and changes by the chain likelihood, then the document calibration; plain numpy."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in cores(t.encode().lower().split())], np.int64) for t in texts]
    words = list(vocabulary)
    del vocabulary
    is_bad = evidence(ids, words, labels, neighbours=8, odds=10.0)
    lengths = np.array([len(d) for d in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    token_ids, mask, doc = chains_of(flat.astype(float), lengths)
    token_ids = token_ids.astype(np.int64)
    # evidence words in clean documents are left clean; chains: all with a toxic token, and three times as many others
    gold = is_bad[token_ids] & mask & (labels[doc] == 1)[:, None]
    hit = np.flatnonzero(gold.any(axis=1))
    rest = np.flatnonzero(~gold.any(axis=1))
    take = np.concatenate([hit, rng.permutation(rest)[: 3 * len(hit) + 200]])
    token_ids, mask_t, gold = token_ids[take], mask[take], gold[take]
    owner, grams = char_grams(words, SIZES, BUCKETS) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
    weights, bias, change = np.zeros(BUCKETS), -3.0, np.array([[0.5, -0.5], [0.0, 0.0]])
    m1, m2 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    moves = np.zeros((2, 2))
    both = mask_t[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum()
    n = max(1, len(take))
    for step in range(1, steps + 1 if len(take) and len(words) else 1):
        e = (np.bincount(owner, weights[grams], len(words)) + bias)[token_ids] * mask_t
        p, pairs, _ = marginals(e, mask_t, change)
        slope = np.bincount(token_ids[mask_t], (gold - p)[mask_t], len(words))
        grad = np.bincount(grams, slope[owner], BUCKETS) / n - decay * weights
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        weights += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-4)
        bias += rate * float(slope.sum()) / n
        change = change + rate * (moves - pairs) / n
    model = Model(weights.astype(np.float32), bias, change, np.zeros(FEATURES))
    values = np.bincount(owner, model.weights[grams], len(words)) + bias
    x = np.zeros((len(ids), FEATURES))
    for at in range(0, len(ids), 256):
        block = lengths[at : at + 256]
        e, mask, doc = chains_of(values[np.concatenate(ids[at : at + 256])], block)
        x[at : at + 256] = document_features(marginals(e, mask, change)[0], mask, doc, block)
    model.calibration = calibrate(x, labels)
    return model


class _Scorer:
    """Scores and marginals of texts; emissions of words are kept for later batches."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score per text, P(toxic) per token of all texts, tokens per text)"""
        model = self.model
        tokens = [t.lower().split() for t in texts]
        fresh = list(set().union(*tokens).difference(self.known))
        if fresh:
            if len(self.known) > CACHE:
                self.known = {}
                fresh = list(set().union(*tokens))
            self.known.update(zip(fresh, emissions(cores(fresh), model.weights, model.bias).tolist(), strict=True))
        known = self.known
        lengths = np.array([len(t) for t in tokens], np.int64)
        values = np.fromiter((known[w] for t in tokens for w in t), np.float64, int(lengths.sum()))
        e, mask, doc = chains_of(values, lengths)
        p = marginals(e, mask, model.change)[0]
        return 1 / (1 + np.exp(-document_features(p, mask, doc, lengths) @ model.calibration)), p[mask], lengths


def toxic_spans(text: bytes, p: np.ndarray, threshold: float) -> list[dict]:
    """Runs of tokens whose marginal reaches the threshold: start and end in code points, and the largest marginal."""
    places, spans, last = [m.span() for m in TOKEN.finditer(text)], [], -2
    for i in np.flatnonzero(p >= threshold).tolist():
        start, end = (len(text[:x].decode("utf-8", "replace")) for x in places[i])
        if i == last + 1:
            spans[-1].update(end=end, p=max(spans[-1]["p"], float(p[i])))
        else:
            spans.append({"start": start, "end": end, "p": float(p[i])})
        last = i
    return spans


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, kind = _Scorer(model), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column("bytes").to_pylist()
                score, p, lengths = scorer(texts)
                parts = np.split(p, np.cumsum(lengths)[:-1])
                spans = [toxic_spans(t, x, threshold) if (x >= threshold).any() else [] for t, x in zip(texts, parts, strict=True)]
                yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(score), pa.array(spans, kind)], names=["doc_id", "row_hash", "score", "spans"])

    return run


def _keep(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                score = scorer([(t or "").encode() for t in batch.column("text").to_pylist()])[0]
                yield batch.filter(pa.array(score < 0.5))

    return run


def _learned(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> Model:
    sample = training_sample(docs, labels, "toxic", per_class, longest)
    return fit(sample["text"].tolist(), sample["label"].to_numpy(dtype=np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, longest: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, row_hash, held_out, score, predicted and spans (start, end in code points, p), a row per row of docs.

    Learns from at most per_class labelled texts a class outside the held-out fold (see training_sample), whose
    texts come from docs; a score depends on the text alone. Null and empty texts get the score of a document
    without tokens; a very long text is scored whole (only the sample leaves out texts above ``longest``);
    a null doc_id is held out; repeated rows score alike; without labels every score is that of
    an untrained model; an empty table gives no rows; other columns are ignored.
    """
    model = _learned(docs, labels, per_class, longest)
    source = keyed(docs).select("doc_id", "row_hash", F.col("text").cast("binary").alias("bytes"))
    out = source.mapInArrow(_score(model, threshold), "doc_id long, row_hash long, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", "row_hash", F.coalesce(training_fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, longest: int = 20_000) -> DataFrame:
    """The rows of docs that score_toxicity does not predict toxic, with all their columns."""
    return docs.mapInArrow(_keep(_learned(docs, labels, per_class, longest)), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.drop("row_hash")

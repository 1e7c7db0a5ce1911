"""Toxicity and quality: held-out accuracy, marginals by enumeration, and messy rows."""

from itertools import product

import numpy as np
import pytest
from brute import DATA, empty, held_out, messy

from tobflow.llm import quality, toxicity
from tobflow.llm.features import training_sample

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()


@pytest.mark.parametrize(("module", "name", "column", "least"), [(toxicity, "op3_toxicity", "toxic", 0.95), (quality, "op6_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, module, name, column, least):
    sf = f"{DATA}/sf0.1"
    got = {r["doc_id"]: r for r in getattr(module, name)(spark, sf).collect()}
    assert all(r["held_out"] == held_out(d) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if held_out(r["doc_id"]) and r["doc_id"] in got]
    assert auc([got[r["doc_id"]]["score"] for r in known], [r[column] for r in known]) >= least


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows = [(i, "good words here" if i % 2 else "bad words there") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2, 1 - i % 2) for i in range(60)]
    turned = [(i, 1 - q, 1 - t) if held_out(i) else (i, q, t) for i, q, t in labels]
    for module in (toxicity.score_toxicity, quality.score_quality):
        a, b = ({r["doc_id"]: r["score"] for r in module(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
        assert a == b


def test_a_sample_does_not_depend_on_the_order_of_rows(spark):
    """Ids with labels of both classes are left out; of two texts of an id the least is taken; repeated labels count once."""
    docs = [(i, f"text {i}") for i in range(40)] + [(3, "a text before"), (8, "z text after")]
    labels = [(i, i % 2, 0) for i in range(40)] + [(6, 1, 0), (9, 1, 0)]
    want = {("a text before" if i == 3 else f"text {i}", i % 2) for i in range(40) if not held_out(i) and i != 6}
    for turn in (1, -1):
        got = training_sample(spark.createDataFrame(docs[::turn], "doc_id long, text string"), spark.createDataFrame(labels[::turn], LABELS), "quality", 100, 1000)
        assert len(got) == len(want) and set(got.itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_messy_rows(spark, score):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, 1, None), (None, 1, 1), (99, 0, 1)], LABELS)
    got = score(messy(spark), labels).collect()
    assert len(got) == 16 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert score(empty(spark), labels).count() == 0
    assert score(messy(spark), labels.limit(0)).count() == 16


def test_rejected_rows_go_and_others_keep_their_columns(spark):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.schema == docs.schema
    scored = toxicity.score_toxicity(docs, labels)
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in scored.where("predicted = 0").select("doc_id").collect()}


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    e, change = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.arange(5)[None] < np.array([5, 3, 1])[:, None]
    p, pairs, log_z = toxicity.marginals(e * mask, mask, change)
    expected = np.zeros((2, 2))
    for c, n in enumerate((5, 3, 1)):
        weights, total = {}, 0.0
        for path in product((0, 1), repeat=n):
            s = sum(e[c, t] for t in range(n) if path[t]) + sum(change[a, b] for a, b in zip(path, path[1:], strict=False))
            weights[path] = np.exp(s)
            total += weights[path]
        assert np.isclose(log_z[c], np.log(total))
        for t in range(n):
            assert np.isclose(p[c, t], sum(w for q, w in weights.items() if q[t]) / total)
        for path, w in weights.items():
            for a, b in zip(path, path[1:], strict=False):
                expected[a, b] += w / total
    assert np.allclose(pairs, expected)


def test_calibration_is_at_the_optimum():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 3))])
    y = (x @ [-1, 2, 0, -1] + rng.logistic(size=400) > 0).astype(np.int64)
    for labels in (y, np.zeros_like(y), (x[:, 1] > 0).astype(np.int64)):
        b = toxicity.calibrate(x, labels)
        share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        assert np.abs(x.T @ (share * (labels - 1 / (1 + np.exp(-x @ b)))) - 1e-4 * b).max() < 1e-9
    assert not toxicity.calibrate(np.zeros((0, 4)), np.zeros(0, np.int64)).any()


def test_evidence_follows_its_rule():
    rng = np.random.default_rng(5)
    words = [b"grim%d" % i for i in range(6)] + [b"w%d" % i for i in range(30)]
    labels = np.array([1, 0] * 60)
    docs = [np.where(rng.random(n) < (0.4 if y else 0.02), rng.integers(0, 6, n), rng.integers(6, 36, n)) for n, y in zip(rng.integers(0, 12, 120), labels, strict=True)]
    for neighbours, odds in ((2, 1.5), (3, 4.0), (8, 10.0)):
        good = set()
        sizes = [sum(len(d) for d, y in zip(docs, labels, strict=True) if y == k) for k in (0, 1)]
        for unit in {u for w in words for u in toxicity._units(w)}:
            holds = [unit in toxicity._units(w) for w in words]
            seen = [(k, d[k], d[k - 1] if k else None) for d, y in zip(docs, labels, strict=True) if y for k in range(len(d)) if holds[d[k]]]
            clean = sum(holds[w] for d, y in zip(docs, labels, strict=True) if not y for w in d)
            often = (len(seen) + 0.5) / (sizes[1] + 1) >= odds * (clean + 0.5) / (sizes[0] + 1)
            if seen and often and len({b for _, _, b in seen}) >= neighbours and (unit.endswith(b">") or len({w for _, w, _ in seen}) >= neighbours):
                good.add(unit)
        got = toxicity.evidence(docs, words, labels, neighbours, odds)
        assert got.tolist() == [not good.isdisjoint(toxicity._units(w)) for w in words]
    assert not toxicity.evidence([docs[0][:0]], words, labels[:1], 2, 2.0).any()


def test_spans_are_in_code_points():
    text = "grüß dich du böser kerl".encode()
    spans = toxicity.toxic_spans(text, np.array([0.1, 0.1, 0.9, 0.8, 0.1]), 0.5)
    assert [(s["start"], s["end"]) for s in spans] == [(10, 18)] and text.decode()[10:18] == "du böser"

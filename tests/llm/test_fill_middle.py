"""Fill-in-middle: boundary lists, cuts against a plain version, hot texts and messy rows."""

import hashlib

import numpy as np
import pytest
from brute import empty, messy

from tobflow.llm import fill_middle as M


def plain_version(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def check(docs, **how):
    out = M.fill_in_middle(docs, **how)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    want = [plain_version(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = [tuple(r) for r in out.select("doc_id", M.restored(out.output, out.form)).collect()]
    assert sorted(back, key=str) == sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=str)


def test_lists_select_every_value():
    rng = np.random.default_rng(0)
    for top in (1, 10, 1000, 100_000):
        values = np.sort(rng.integers(0, top, 700))
        parts = M.encode_list(values)
        assert [M.select(*parts, i) for i in range(len(values))] == values.tolist()
    far = np.array([0, 5, 1 << 30])
    assert [M.select(*M.encode_list(far), i) for i in range(3)] == far.tolist()


def test_messy_and_empty_tables(spark):
    check(messy(spark))
    check(messy(spark), share=1)
    assert M.fill_in_middle(empty(spark)).count() == 0


def test_code_points_markers_and_hot_texts(spark):
    texts = ["grüße 日本語 🙂👩‍👩‍👧 é", "a<P>b", "<", "<S", "x<M", "P>", "S>M>", "", "é"]
    rows = [(i, texts[i % len(texts)]) for i in range(400)] + [(7, "the hot text 🙂")] * 30 + [(i, "the hot text 🙂") for i in range(1000, 1100)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), share=9)


def test_one_digest_with_two_contents_stops(spark, monkeypatch):
    monkeypatch.setattr(M.F, "sha2", lambda c, bits, sha2=M.F.sha2: sha2(M.F.lit("same"), bits))
    with pytest.raises(Exception, match="two contents"):
        M.fill_in_middle(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))

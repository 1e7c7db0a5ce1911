"""Speculative encoding against the tokenizer library, and decoding."""

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import DATA, empty, messy, rows_of
from tokenizers import Tokenizer

from tobflow.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.SpeculativeEncoder(PATH)


def lists(encoder, texts):
    flat, counts = encoder.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [flat[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]


def test_pairs_stay_apart_exactly_where_merging_leaves_them(encoder):
    model, rng = encoder.table, random.Random(3)
    plain = [t for t in model.vocabulary if not t.endswith("</w>")]
    ends = [t for t in model.vocabulary if t.endswith("</w>")]
    pairs = [(rng.choice(plain), rng.choice(ends)) for _ in range(3000)] + [("a" * n, "a" * m + "</w>") for n in (1, 2, 3) for m in (1, 2, 3) if "a" * n in model.vocabulary and "a" * m + "</w>" in model.vocabulary]
    a, b = (np.array([model.vocabulary[p[k]] for p in pairs]) for k in (0, 1))
    want = [model.exact(x + y.removesuffix("</w>")) == [i, j] for (x, y), i, j in zip(pairs, a, b, strict=True)]
    assert model.apart(a, b).tolist() == want and 0 < sum(want) < len(want)
    assert model.verified(a, b).tolist() == want == model.verified(a, b).tolist()


def test_words_are_encoded_as_by_the_library(encoder, library):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(8000)]
    words += [c * n for c in ("a", "ha", "!", "-=") for n in range(1, 50)]
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert encoder.table.encode(words) == want == [encoder.table.exact(w) for w in words]
    proposed = [encoder.table.propose(w) == x for w, x in zip(words, want, strict=True)]
    assert 0.2 < np.mean(proposed) < 1  # both ways are taken


def test_texts_of_any_characters(encoder, library):
    rng = random.Random(2)
    pool = [*"abcXYZ ÀéΣσς́ \n\t\r'.,!?<>|0123日本語🙂한글가̸≮İı 　\xa0\x85\x1c\x00\x01", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "the ", "ing", "</w>"]
    texts = ["", None, "x" * 5000, *("".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(6000))]
    texts[1] = ""
    assert lists(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_messy_and_empty_tables(spark, library):
    rows = bpe.decode(bpe.encode(messy(spark))).select("doc_id", "ids", "decoded").collect()
    want = []
    for r in messy(spark).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.decode(bpe.encode(empty(spark))).count() == 0


def test_decoding_of_any_ids(spark, library):
    ids = [[], [49406, 320, 49407], [5, 10**6, -1, 6], None]
    got = [r.decoded for r in bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "at int, ids array<int>")).orderBy("at").collect()]
    assert got == ["", library.decode(ids[1], skip_special_tokens=False), library.decode([5, 6]), None]


def test_query_against_the_library(spark, library):
    want = []
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((r.doc_id, len(ids), *digests))
    assert rows_of(bpe.op12_bpe(spark, f"{DATA}/sf0.001"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_other_models_are_refused():
    spec = json.loads(Path(PATH).read_text())
    spec["model"]["byte_fallback"] = True
    with pytest.raises(ValueError):
        bpe.MergeTable(spec)

"""The token store, packing, the fixity audit, decontamination and the pipeline."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import DATA, empty, messy, rows_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tobflow.llm import decontam, packing, token_store, warc
from tobflow.llm.encoding import PieceEncoder


def encoded(file, docs, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in docs]


def texts_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_store_reads_back_what_the_tokenizer_gives(spark):
    docs = texts_of(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    start, want = 0, []
    for d, ids in by_id(encoded("word_bpe_49k.json", docs, 2)):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_store.op2_token_store(spark, f"{DATA}/sf0.001")
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_store_of_messy_rows(spark):
    store = token_store.write_store(messy(spark))
    want = sorted((d, ids.astype("<u2").tobytes()) for d, ids in encoded("word_bpe_49k.json", texts_of(messy(spark)), 2) if d is not None)
    got = [(r["doc_id"], bytes(r["ids"])) for r in store.read().collect()]
    repeated = [x for x in want if x[0] == 3]
    assert len(repeated) == 2
    assert sorted(x for x in got if x[0] is not None) == want
    assert token_store.checksums(store).count() == 16 and store.damaged().count() == 0
    nothing = token_store.write_store(empty(spark))
    assert token_store.checksums(nothing).count() == 0 and nothing.damaged().count() == 0
    # long repeats are stored once: documents 6 and 7 have the same chunks
    assert store.chunks().count() < store.recipes().select(F.explode("digests")).count()


def rewritten(spark, store, name, change, tmp_path):
    """A copy of a store in which one of its tables is changed."""
    for part in ("chunks", "recipes", "top"):
        df = spark.read.parquet(f"{store.path}/{part}")
        (change(df) if part == name else df).write.parquet(str(tmp_path / part))
    return token_store.TokenStore(spark, str(tmp_path), store.width)


def _reversed_recipe(df):
    long = F.size("digests") > 1
    return df.withColumn("digests", F.when(long & (F.col("doc_id") == 6), F.reverse("digests")).otherwise(F.col("digests")))


def _honest_leaf(df):
    """The changed recipe with a leaf that fits it."""
    fit = F.udf(lambda d, c: token_store.leaf(d, [bytes(x) for x in c]) if c is not None else None, "binary")
    return _reversed_recipe(df).withColumn("leaf", F.when(F.col("leaf").isNotNull(), fit("doc_id", "digests")))


@pytest.mark.parametrize("name, change, says", [
    ("chunks", lambda df: df.orderBy("digest").offset(1), "chunk is missing"),
    ("chunks", lambda df: df.withColumn("ids", F.expr("substring(ids, 1, length(ids) - 2)")), "is damaged"),
    ("recipes", _reversed_recipe, "recipe of document 6 is changed"),
    ("recipes", _honest_leaf, "not what its manifest says"),
    ("recipes", lambda df: df.where("doc_id IS NULL OR doc_id <> 6"), "not what its manifest says"),
    ("recipes", lambda df: df.where("root IS NULL"), "the manifest has 0 parts"),
    ("recipes", lambda df: df.where("part > 0"), "the manifest has"),
])
def test_a_changed_store_is_an_error(spark, tmp_path, name, change, says):
    store = rewritten(spark, token_store.write_store(messy(spark)), name, change, tmp_path)
    with pytest.raises(Exception, match=says):
        token_store.checksums(store).collect()
    if says == "chunk is missing":
        with pytest.raises(Exception, match="no chunk"):
            store.read().collect()
        assert [r.kind for r in store.damaged().collect()] == ["missing"]


FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def same_ids(encoder, file, texts):
    want = [ids[:-1].tolist() for _, ids in encoded(file, enumerate(texts), 0)]
    ids, counts = encoder.encode(pa.array(texts))
    return counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("file", FILES)
def test_pieces_have_the_ids_of_whole_texts(file):
    """Random texts of letters, marks, punctuation, white space, added tokens and control characters."""
    rng, encoder = np.random.default_rng(9), PieceEncoder(public_tokenizers.path(file))
    assert encoder.kind == {"word_bpe_49k.json": "drops", "byte_bpe_50k.json": "keeps"}[file]
    odd = ["Unge", "ab", "É", "e\u0301", ",", ".", "'s", "'", "!!", "\n", "\n\n", "\n\n\n", " ", "  ", "\t", "\xa0", "7", "42", "中文", "\u0301", "<", "\u0338", "<|endoftext|>", "\0", "\x01", "_", "-", "İ", "ß", "😀", "\u200d", "½", "Ω", "ﬁ"]
    usual = ["a", "Bc", "é", ",", ". ", "\n", " ", " ", "'t"]
    for parts in (odd, usual):
        texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)]
        assert same_ids(encoder, file, texts)
        assert same_ids(encoder, file, texts[:50])


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b,c": 1, "?": 2}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "other.json"))
    encoder = PieceEncoder(str(tmp_path / "other.json"))
    ids, counts = encoder.encode(pa.array(["a b,c", "", "b,c x"]))
    assert encoder.kind == "whole" and ids.tolist() == [0, 1, 1, 2] and counts.tolist() == [2, 0, 2]


@pytest.mark.parametrize("file", FILES)
def test_special_tokens_in_a_text_are_one_id(file):
    texts = ["plain one", "a <|endoftext|> b", "x<|startoftext|>y  z <|ENDOFTEXT|>", "", "<|endoftext|>", "<|endoftext", "<|endoftext|><|startoftext|>", "last text"]
    encoder = PieceEncoder(public_tokenizers.path(file))
    for some in (texts, texts[1:2], [texts[4], texts[6]]):
        assert same_ids(encoder, file, some)


def test_store_and_packing_of_special_tokens(spark):
    rows = [(1, "ahead <|endoftext|> behind"), (2, "one<|startoftext|>two"), (3, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(d, ids.astype("<u2").tobytes()) for d, ids in encoded("word_bpe_49k.json", rows, 2)]
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in token_store.write_store(docs).read().collect()) == want
    check_pieces(packing.pack(docs).collect(), encoded("byte_bpe_50k.json", rows, 1))


def test_damage_is_found(spark, tmp_path):
    store = token_store.write_store(messy(spark), path=str(tmp_path / "store"))
    chunks = store.chunks().withColumn("ids", F.when(F.octet_length("ids") > 100, F.unhex(F.lit("00"))).otherwise(F.col("ids")))
    chunks.write.parquet(str(tmp_path / "bad/chunks"))
    recipes = spark.read.schema(token_store.RECIPES).parquet(f"{store.path}/recipes")
    swapped = recipes.withColumn("digests", F.when(F.col("doc_id") == 8, F.array(F.unhex(F.lit("00")))).otherwise(F.col("digests")))
    swapped.write.parquet(str(tmp_path / "bad/recipes"))
    spark.read.parquet(f"{store.path}/top").write.parquet(str(tmp_path / "bad/top"))
    bad = token_store.TokenStore(spark, str(tmp_path / "bad"), 2)
    kinds = {r["kind"] for r in bad.damaged().collect()}
    assert {"chunk", "leaf"} <= kinds
    with pytest.raises(Exception, match="damaged"):
        token_store.checksums(bad).collect()


def test_joined_checksums():
    rng = np.random.default_rng(0)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 300, 40)]
    counts = np.array([1, 4, 35])
    got = token_store.joined_crc(np.array([zlib.crc32(p) for p in parts]), np.array([len(p) for p in parts]), counts)
    assert got.tolist() == [zlib.crc32(b"".join(parts[:1])), zlib.crc32(b"".join(parts[1:5])), zlib.crc32(b"".join(parts[5:]))]


def check_pieces(pieces, want, window=2048):
    """Every id once, in sequences without gaps, little of them padding."""
    by_doc, sequences = {}, {}
    for r in pieces:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in pieces) == sum(len(x) for _, x in want)
    for d, ids in want:
        at = 0
        own = sorted(by_doc[(d, len(ids))], key=lambda r: r["start"])
        copies = sum(1 for e, x in want if (e, len(x)) == (d, len(ids)))
        for r in own[::copies]:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert max(sizes, default=0) <= window
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes)


def test_packing_holds_every_id_once(spark):
    want = encoded("byte_bpe_50k.json", texts_of(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")), 1)
    padding = check_pieces(packing.op8_packing(spark, f"{DATA}/sf0.001").collect(), want)
    assert padding == 0


def test_packing_over_shards_keeps_neighbours_together(spark):
    rows = [(i, " ".join([f"topic{i % 5}", "alpha beta gamma"] * 30)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, shard_tokens=10_000, window=1024).collect()
    check_pieces(got, encoded("byte_bpe_50k.json", rows, 1), 1024)
    pairs = [(a["doc_id"] % 5, b["doc_id"] % 5) for a in got for b in got if a["sequence_id"] == b["sequence_id"] and a["doc_id"] < b["doc_id"]]
    assert len({r["sequence_id"] >> 32 for r in got}) > 1
    # topics are dealt to shards together, so nearly all windows are of one topic
    assert np.mean([a == b for a, b in pairs]) > 0.8


def test_index_ranks_as_plain_bm25_does():
    """Scores of a shard's inverted index against the formula, term by term, and windows filled in that order."""
    rng = np.random.default_rng(6)
    texts = [rng.zipf(1.3, int(n)).clip(0, 400).astype("<u2") for n in rng.integers(30, 90, 60)]
    n_docs, mean = len(texts), np.mean([len(x) for x in texts])
    held = np.array([sum(t in x for x in texts) for t in range(401)])
    ranking = packing.Ranking(np.log(1 + (n_docs - held + 0.5) / (held + 0.5)), mean)
    docs = [packing.Remainder(d, len(x), 0, x, *packing.counted(x)) for d, x in enumerate(texts)]
    index = packing.Index(docs, ranking)

    def weight(t, x):
        tf = int((x == t).sum())
        return np.log(1 + (n_docs - held[t] + 0.5) / (held[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(x) / mean))

    for seed in range(0, 60, 7):
        own = sorted(set(texts[seed].tolist()), key=lambda t: (-weight(t, texts[seed]), t))[:24]
        assert np.allclose(index.scores(seed, 24), [sum(weight(t, x) for t in own) for x in texts])
    longest = max(range(60), key=lambda d: (len(texts[d]), -d))
    sequences, _ = packing.pack_shard(docs, ranking, 200, 24)
    best = [d for d in np.lexsort((np.arange(60), -index.scores(longest, 24))).tolist() if d != longest]
    assert [p[0] for p in sequences[0]][:2] == [longest, best[0]]


def test_packing_of_messy_rows(spark):
    rows = [(d, t) for d, t in texts_of(messy(spark)) if d is not None and d != 3]
    docs = messy(spark).where("doc_id IS NOT NULL AND doc_id <> 3")
    assert check_pieces(packing.pack(docs).collect(), encoded("byte_bpe_50k.json", rows, 1)) == 0
    assert packing.pack(messy(spark)).agg(F.sum("length")).first()[0] == sum(len(x) for _, x in encoded("byte_bpe_50k.json", texts_of(messy(spark)), 1))
    assert packing.pack(empty(spark)).count() == 0


# ---- fixity


PAGES = "page_id long, url string, html string, segment string, record string, hash string"


def test_audit_finds_damage_loss_and_growth(spark):
    rows = [(i, f"http://x/{i}", "<p>" + "y" * (i % 40), "s", "r", "h") for i in range(3000)]
    pages = spark.createDataFrame(rows, PAGES)
    good = warc.write_replica(pages, "good")
    hurt = good.withColumn("record", F.when(F.col("page_id") == 777, F.concat(F.lit("x").cast("binary"), F.substring("record", 2, 10_000))).otherwise(F.col("record")))
    assert rows_of(warc.fixity_audit(good, hurt).where("NOT intact"), "page_id") == [(777,)]
    lost = good.where("page_id NOT IN (1500, 2999)")
    gone = {r[0] for r in rows_of(warc.fixity_audit(good, lost).where("NOT intact"), "page_id")}
    # records behind a lost one have other offsets, up to the end of their segment
    assert gone == {*range(1500, 1536), 2999}
    assert warc.fixity_audit(good, good).where("NOT intact").count() == 0


def test_audit_of_messy_pages(spark):
    rows = [(1, None, None, "s", "r", "h"), (1, None, None, "s", "r", "h"), (None, "u", "", "s", "r", "h"), (2, "u", "é" * 100_000, "s", "r", "h")]
    pages = spark.createDataFrame(rows, PAGES)
    a = warc.write_replica(pages, "a")
    got = warc.fixity_audit(a, warc.write_replica(pages, "b"))
    assert got.count() == 4 and got.where("intact").count() == 4
    assert rows_of(got.where("page_id = 2"), "n_bytes")[0][0] > 200_000
    nothing = warc.write_replica(pages.limit(0), "c")
    assert warc.fixity_audit(nothing, nothing).count() == 0
    assert warc.fixity_audit(a, nothing).where("NOT intact").count() == 4
    assert warc.fixity_audit(nothing, a).count() == 0


def duck(sql, **tables):
    import duckdb

    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return con.execute(sql).fetchall(), [d[0] for d in con.description]


def test_records_are_valid_and_placed_as_sql_has_it(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>e{i}</p>") for i in (*range(-300, 600, 7), 2**60 + 1)] + [(None, f"http://n/{i}", "e") for i in range(40)] + [(5, "http://x/a\r\nHost: b", None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    replica = warc.write_replica(pages, "valid").collect()
    for r in replica:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        version, *fields = head.decode().split("\r\n")
        named = dict(f.split(": ", 1) for f in fields)
        assert version == "WARC/1.1" and len(named) == len(fields) == 6 and named["WARC-Type"] == "resource" and named["WARC-Date"].endswith("Z")
        assert ":" in named["WARC-Target-URI"] and body.endswith(b"\r\n\r\n") and int(named["Content-Length"]) == len(body) - 4
    segments = {r["segment"] for r in replica if r["page_id"] is None}
    assert len(segments) > 20 and not segments & {r["segment"] for r in replica if r["page_id"] is not None}
    want, names = duck(warc.OP7_SQL, pages=tmp_path / "pages.parquet")
    assert rows_of(warc.op7_warc(spark, str(tmp_path)), *names) == sorted(want, key=str)


# ---- decontamination

ITEM = "A train leaves Berlin at 9 and travels 240 km in 3 hours before it turns around. How fast does the train go on its way to Berlin?"
BENCH = "item_id long, text string, doc_id long, hash long, at int"


def test_templates_find_changed_questions(spark):
    changed = "Some words ahead. A train leaves Madrid at 7 and travels 400 km in 5 hours before it turns around. How fast does the train go on its way to Madrid? And behind."
    clash = changed.replace("way to Madrid", "way to Lisbon")
    rows = [(1, f"Ahead. {ITEM} Behind."), (2, changed), (3, clash), (4, "nothing of this kind is in here, it is about other things altogether")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM, 0, 0, 0), (7, ITEM, 0, 0, 0), (8, "too short", 0, 0, 0), (9, None, 0, 0, 0), (None, ITEM, 0, 0, 0)], BENCH)
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1]["n_changed"] == 0 and got[2]["n_changed"] > 0
    assert all(r["item_id"] == 7 for r in got.values())


def test_items_without_a_telling_window_are_found_whole(spark, tmp_path):
    items = [(1, ITEM), (2, "Name the capital of France."), (3, "Berlin 5 km Paris 7 km London 9 km Rome 11 km"), (4, "..."), (5, "capital"), (6, "")]
    rows = [(1, "Please: name the capital, of France!"), (2, "name the capital of Spain"), (3, "From Berlin 5 km Paris 7 km London 9 km Rome 11 km on"), (4, "Berlin 5 km Paris 7 km London 9 km Rome 12 km"), (5, None), (6, ITEM), (None, "a capital idea"), (7, "Capital " * 3000)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(decontam.op9_decontam(spark, str(tmp_path)), "doc_id", "item_id")
    assert got == sorted([(1, 2), (1, 5), (2, 5), (3, 3), (6, 1), (None, 5), (7, 5)], key=str)
    want, names = duck(decontam.OP9_SQL, documents=tmp_path / "documents.parquet", benchmark=tmp_path / "benchmark.parquet")
    assert rows_of(decontam.op9_decontam(spark, str(tmp_path)), *names) == sorted(want, key=str)


def test_decontamination_of_messy_rows(spark):
    bench = spark.createDataFrame([(1, f"{ITEM}", 0, 0, 0)], BENCH)
    docs = messy(spark).withColumn("text", F.when(F.col("doc_id").isin(6, 3), F.concat("text", F.lit(". "), F.lit(ITEM))).otherwise(F.col("text")))
    got = decontam.contaminated(docs, bench)
    assert rows_of(got, "doc_id") == [(3,), (6,)]
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_rows_without_an_id_are_dropped(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, ITEM, 0, 0, 0)], BENCH).write.parquet(f"{path}/benchmark.parquet")
    rows = [(None, f"Ahead. {ITEM}"), (None, "clean"), (None, None), (7, f"Ahead. {ITEM}"), (7, "clean too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(corpus_pipeline.decontam(spark, docs, path), "doc_id", "text") == sorted([rows[1], rows[2], rows[4]], key=str)


# ---- pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() <= before
        if name == "line_dedup":
            assert docs.count() == before and docs.where(F.length("text") != F.col("n_chars")).count() == 0
        last = docs if k == len(corpus_pipeline.STAGES) - 2 else None
        if last is not None:
            tokens = encoded("byte_bpe_50k.json", texts_of(last), 1)
    assert check_pieces(docs.collect(), tokens) == 0


@pytest.mark.parametrize("make", [messy, empty])
def test_stages_on_messy_rows(spark, tmp_path, make):
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{DATA}/sf0.001").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / str(k))) if k < 4 else spark.read.parquet(str(tmp_path / str(k)))
    assert (docs.count() == 0) == (make is empty)

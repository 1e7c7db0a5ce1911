"""Line, near-duplicate, substring and vector dedup against brute force."""

import uuid

import corpus_pipeline
import numpy as np
import pytest
from brute import DATA, LINE, empty, line_dedup, messy, near_dup, rows_of, substring_dedup, vector_dedup
from pyspark.sql import functions as F

from tobflow.llm import deep_shallow, near_dup as nd, suffix_dedup, vector_dedup as vd
from tobflow.llm.graph import components
from tobflow.llm.line_dedup import LineRuns, dedup_lines, line_hashes, op1_line_dedup
from tobflow.llm.common import keyed

LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
NEAR = ("doc_id", "n_shingles", "component_id", "kept")
CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
VECTORS = ("vec_id", "n_links", "component_id", "kept")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def digested(df, column):
    return df.withColumn("kept_sha256", F.sha2(F.col(column).cast("binary"), 256))


def test_lines_match_brute_force(spark, docs):
    assert rows_of(op1_line_dedup(spark, f"{DATA}/sf0.001"), *LINES) == line_dedup(docs)


def test_lines_of_messy_rows(spark):
    rows = messy(spark)
    want = line_dedup([tuple(r) for r in rows.select("doc_id", "text").collect()])
    assert rows_of(digested(dedup_lines(rows), "text"), *LINES) == want
    assert dedup_lines(empty(spark)).count() == 0


def test_line_runs_find_fresh_lines_and_compact(spark):
    runs = LineRuns(spark, fanout=2)
    for first in range(0, 50, 10):
        rows = [(d, f"{LINE} {d // 2}\n{LINE}") for d in range(first, first + 10)]
        runs.add(line_hashes(keyed(spark.createDataFrame(rows, "doc_id long, text string"))))
        assert max(map(len, runs.levels)) < 2
    merged = runs.merged()
    assert merged.count() == 26
    # ten documents a batch hold the line that all share: known to be common, it enters again only for its largest document
    assert rows_of(merged.where("n_docs > 2"), "n_docs", "max_doc") == [(50, 49)]
    assert merged.where("n_docs = 2").count() == 25
    before = sum(spark.table(x).count() for level in runs.levels for x in level)
    runs.add(line_hashes(keyed(spark.createDataFrame([(d, LINE) for d in range(-9, 0)], "doc_id long, text string"))))
    assert sum(spark.table(x).count() for level in runs.levels for x in level) == before
    runs.add(line_hashes(keyed(spark.createDataFrame([(-20, f"{LINE} 0"), (-21, f"{LINE} new")], "doc_id long, text string"))))
    assert rows_of(runs.merged().where("n_docs <> 2"), "n_docs", "max_doc") == [(1, -21), (3, 1), (50, 49)]
    runs.drop()


def test_lines_over_many_batches(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(digested(dedup_lines(table, batch_docs=30), "text"), *LINES) == line_dedup(docs)


def test_near_duplicates_match_brute_force(spark, docs):
    assert rows_of(nd.op4_near_dup(spark, f"{DATA}/sf0.001"), *NEAR) == near_dup(docs)


def test_near_duplicates_of_messy_rows(spark):
    got = {r["doc_id"]: r for r in nd.near_duplicates(messy(spark), shingle=4).collect()}
    assert got[7]["component_id"] == 6 and got[6]["kept"] and not got[7]["kept"]
    assert got[9]["component_id"] == 8 and got[13]["component_id"] == 12
    assert all(got[d]["component_id"] == d and got[d]["n_shingles"] == 0 for d in (4, 5, 10))
    assert nd.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_null_ids_and_of_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(200)]
    other = [f"v{i}" for i in range(200)]
    texts = [(None, words), (None, [*words[:-1], "x"]), (None, [*words[:-2], "y"]), (5, other), (5, [f"u{i}" for i in range(200)]), (6, [*other[:-1], "z"])]
    rows = [(d, " ".join(t)) for d, t in texts]
    docs = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string")
    got = rows_of(nd.near_duplicates(docs, shingle=4), "doc_id", "component_id", "kept")
    assert [r for r in got if r[0] is not None] == [(5, 5, True), (5, 5, True), (6, 5, False)]
    left = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(r for r in left if r[0] is not None) == sorted(rows[3:5])
    assert len({t for d, t in left if d is None}) == 1
    # an id's texts are decided one by one
    docs = spark.createDataFrame([(3, " ".join(words)), (5, " ".join(words)), (5, " ".join(other))], "doc_id long, text string")
    assert rows_of(corpus_pipeline.near_dedup(spark, docs, ""), "doc_id") == [(3,), (5,)]


def test_a_star_hides_no_link(spark):
    """Chains around the threshold: hubs link with few of their bucket, others only with each other."""
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(400)]
    for family in range(6):
        now = list(rng.permutation(words)[:120])
        for i in range(40):
            rows.append((family * 1000 + i, " ".join(now)))
            for at in rng.integers(0, 120, 2):
                now[at] = f"n{family}-{i}-{at}"
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nd.near_duplicates(table, shingle=4), *NEAR) == near_dup(rows)


def test_a_crowd_around_a_missing_original(spark):
    """Many variants of a text that is not there itself: some are linked, some only through others, some not at all."""
    rng, rows = np.random.default_rng(8), []
    for family, size in enumerate((150, 400)):
        base = [f"f{family}w{i}" for i in range(size)]
        for i in range(120):
            words = list(base)
            for at in rng.integers(0, size, int(rng.integers(size // 100, size // 20))):
                words[at] = f"x{rng.integers(0, 9)}" if i % 3 else f"own{i}-{at}"
            rows.append((len(rows), " ".join(words[: size - int(rng.integers(0, size // 12))])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nd.op4_near_dup(spark, _documents(table)), *NEAR) == near_dup(rows)


def _documents(table):
    path = f"{table.sparkSession.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("n_hub", [80, 100, 125])
def test_linked_pairs_of_different_components_share_early_differences(spark, n_hub):
    """Random sets around one hub: every pair at 0.8 of which one is not linked with the hub is found."""
    rng = np.random.default_rng(n_hub)
    hub, crowd = set(range(n_hub)), list(range(1000, 1040))
    sets = []
    for _ in range(90):
        start = set(sets[rng.integers(0, len(sets))]) if sets and rng.random() < 0.7 else set(hub)
        drop = rng.choice(sorted(start), int(rng.integers(0, 14)), replace=False)
        start = (start - set(drop.tolist())) | set(rng.choice(crowd, int(rng.integers(0, 9))).tolist()) | {2000 + int(x) for x in rng.integers(0, 400, int(rng.integers(0, 5)))}
        sets.append(start)
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    sets.append(hub)
    rows = [(0, i, len(x), sorted(x ^ hub)) for i, x in enumerate(sets)]
    near = nd._centred(spark.createDataFrame(rows, "hub long, node long, n_node long, differ array<long>"), 80)
    nearest, sure = near.first()["nearest"], {r["node"] for r in near.where("score <= reach").collect()} - {near.first()["nearest"]}
    assert all(linked(sets[i], sets[nearest]) for i in sure)
    # components of their own, but for those sure to be linked
    inside = sure | {nearest} if sure else {nearest}
    members = near.withColumn("inside", F.col("node").isin(list(inside))).withColumn("component", F.when(F.col("inside"), -1).otherwise(F.col("node")))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j]) and not {i, j} <= inside}
    got = {tuple(r) for r in nd._across(members, 80).select("node", "hub").collect()}
    assert len(want) > 30 and want <= got


def test_densified_sketches_agree_as_often_as_sets_overlap():
    order, rng, hits = nd.bin_order(276), np.random.default_rng(1), []
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = np.unique(x[:50]), np.unique(x[10:])
        hits.append((nd.densified(a, 276, order) == nd.densified(b, 276, order)).mean())
    assert abs(np.mean(hits) - 40 / 60) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (300, 300)], "u long, v long")
    got = dict(rows_of(components(edges), "node", "component"))
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


def test_substrings_match_brute_force(spark, docs):
    assert rows_of(suffix_dedup.op5_suffix_dedup(spark, f"{DATA}/sf0.001"), *CUT) == substring_dedup(docs)


def test_substrings_of_messy_rows(spark):
    rows = messy(spark)
    want = substring_dedup([tuple(r) for r in rows.select("doc_id", "text").collect()])
    assert rows_of(digested(suffix_dedup.dedup_substrings(rows), "kept"), *CUT) == want
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substrings_of_periodic_and_crowded_texts(spark, monkeypatch):
    """Runs of one letter, short periods, and one passage behind many different heads (more than a crowd)."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    passage = noise(230)
    texts = ["a" * 500, "ab" * 300, "abc" * 90, noise(150) + "a" * 260, *[noise(60) + passage[:205] + noise(60) for _ in range(30)], *[noise(90) + passage[i : i + 198] + noise(90) for i in range(30)]]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(digested(suffix_dedup.dedup_substrings(table), "kept"), *CUT) == substring_dedup(rows)


def test_deep_shallow_sorting():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 60)).astype(np.uint8)) for _ in range(300)]
    strings += [b"p" * 100 + s for s in strings[:120]] + strings[:50] + [b""]
    order, lcp = deep_shallow.sort_strings(strings)
    assert [strings[i] for i in order] == sorted(strings)
    ranked = sorted(strings)
    assert lcp.tolist() == [0] + [deep_shallow.common_prefix(a, b) for a, b in zip(ranked, ranked[1:], strict=False)]


def test_vectors_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(vd.op10_vector_dedup(spark, f"{DATA}/sf0.01"), *VECTORS) == vector_dedup(rows)


def test_clustered_vectors_with_default_parameters(spark):
    """Links within and between overlapping groups, several thousand vectors of one label dealt over many cells."""
    rng, rows = np.random.default_rng(4), []
    for dim, n in ((8, 9000), (64, 6000)):
        centres = rng.normal(size=(n // 6, dim))
        for i, c in enumerate(rng.integers(0, len(centres), n)):
            rows.append((len(rows), (centres[c] + rng.normal(size=dim) * 0.12).tolist(), dim))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vd.vector_duplicates(table).collect()}
    found = true = 0
    for dim in (8, 64):
        ids = [r[0] for r in rows if r[2] == dim]
        x = np.array([rows[i][1] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for at in range(0, len(ids), 1000):
            near = (x[at : at + 1000] @ x.T >= 0.98).sum(axis=1) - 1
            for i, n in zip(ids[at : at + 1000], near.tolist(), strict=True):
                assert got[i]["n_links"] <= n and got[i]["audited_links"] in (None, n)
                found, true = found + got[i]["n_links"], true + n
    assert true > 20_000 and found >= 0.995 * true


def test_crowds_of_near_equal_vectors(spark):
    """A crowd within range of each other, a shell around it that links with some of it, a chain off it, and a second label."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    x = [centre + rng.normal(size=24) * 0.006 for _ in range(1500)]
    away = rng.normal(size=(500, 24))
    x += [centre + 0.2 * a / np.linalg.norm(a) * rng.uniform(0.6, 1.4) for a in away]
    x += [centre + k * 0.15 * away[0] / np.linalg.norm(away[0]) for k in range(1, 9)]
    rows = [(i, v.tolist(), "ab"[i % 5 == 0]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = {}
    for label in "ab":
        ids = [r[0] for r in rows if r[2] == label]
        y = np.array([rows[i][1] for i in ids])
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        linked = (y @ y.T >= 0.98) & ~np.eye(len(ids), dtype=bool)
        root = vd.roots(len(ids), *np.nonzero(linked))
        want |= {i: (n, ids[r]) for i, n, r in zip(ids, linked.sum(axis=1).tolist(), root, strict=True)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vd.vector_duplicates(table).collect()}
    assert sum(n for n, _ in want.values()) > 1_000_000
    assert all(got[i][0] <= want[i][0] for i in got) and sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert np.mean([got[i] == want[i] for i in got]) > 0.99
    crowd = vd.crowds(np.array([v / np.linalg.norm(v) for v in x]), 0.98)
    assert len(crowd) >= 1 and len(crowd[0]) >= 1400


def test_small_labels_are_audited_beside_a_large_one(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), 0 if i < 3000 else i % 7 + 1) for i in range(3140)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = vd.vector_duplicates(table, audits=64).where("audited_links IS NOT NULL").join(table, "vec_id").groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in got}
    assert set(counts) == set(range(8)) and min(counts.values()) >= 4 and sum(counts.values()) == 64


@pytest.mark.parametrize("blind", [1, 9])
def test_labels_that_the_search_misses_are_searched_again(spark, monkeypatch, blind):
    """A search that sees nothing of one label: only that label is searched again; what stays missing is told."""
    rng, rows = np.random.default_rng(9), []
    for c in range(40):
        centre = rng.normal(size=8)
        rows += [(len(rows) + i, (centre + rng.normal(size=8) * 0.05).tolist(), "ab"[c % 2]) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    real, asked = vd.linked, []

    def linked(nodes, **how):
        asked.append({r["part"][0] for r in nodes.select("part").distinct().collect()})
        return real(nodes.where("NOT part LIKE 'a/%'") if len(asked) <= blind else nodes, **how)

    monkeypatch.setattr(vd, "linked", linked)
    want = vector_dedup(rows)
    assert sum(r[1] for r in want) > 100
    if blind == 1:
        assert rows_of(vd.vector_duplicates(table), *VECTORS) == want
        assert asked == [{"a", "b"}, {"a"}]
    else:
        with pytest.warns(UserWarning, match="0.000"):
            got = vd.vector_duplicates(table)
        odd = {i for i, _, label in rows if label == "b"}
        assert [r for r in rows_of(got, *VECTORS) if r[0] in odd] == [r for r in want if r[0] in odd]
        assert asked == [{"a", "b"}, {"a"}, {"a"}]


def test_links_between_cells_and_slices_are_complete(spark):
    """With the widest overlap no pair in range is dealt apart; cells above twice their size are dealt over slices."""
    rng, rows = np.random.default_rng(4), []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + rng.normal(size=16) * 0.18).tolist(), c % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for size in (100, 30):
        assert rows_of(vd.vector_duplicates(table, cell_size=size, sigmas=None, beam=48), *VECTORS) == vector_dedup(rows)


def test_each_of_many_cells_above_its_size_is_dealt(spark):
    """Cells of many dimensions, each a little above its size, so that few of its nodes are pivots: none is without one."""
    rng, rows = np.random.default_rng(5), []
    for label in range(120):
        dim = 4 + label % 9
        for _ in range(8):
            centre = rng.normal(size=dim)
            rows += [(len(rows) + i, (centre + rng.normal(size=dim) * 0.1).tolist(), label) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = vector_dedup(rows)
    assert sum(r[1] for r in want) > 1000
    assert rows_of(vd.vector_duplicates(table, cell_size=30), *VECTORS) == want


def test_dealing_copies_a_node_few_times(spark):
    """Vectors without structure, the worst to deal: cells keep their size, and rows do not multiply round by round."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12_000, 64))
    rows = [(i, "0/64", v, 1) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]
    nodes = spark.createDataFrame(rows, "node long, part string, vector array<double>, copies long")
    dealt = vd.cells_of(nodes, least=0.98, cell_size=600, sigmas=4.0)
    sizes = [(r["n"], r["homes"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).collect()]
    assert sum(h for _, h in sizes) == len(rows) and dealt.groupBy("cell", "node").count().where("count > 1").isEmpty()
    assert max(n for n, _ in sizes) <= 600 and sum(n for n, _ in sizes) <= 10 * len(rows)


def test_a_pair_that_meets_in_one_home_counts_at_both_ends():
    """Three in range of each other: 0 is at home here, 1 is a guest that finds 0 in its own home too, 2 one that does not."""
    x = np.array([[1, 0.0], [1, 0.01], [1, 0.02]])
    columns = {"node": [0, 1, 2], "copies": [1, 10, 100], "at": [7, 8, 9], "is_member": [True] * 3, "is_query": [True, False, False], "is_guest": [False, True, True]}
    group = vd.pa.table(columns | {"others": vd.pa.array([[8], [], []], vd.pa.list_(vd.pa.int64())), "vector": vd.pa.array(x.tolist())})
    assert vd._search(0.98, 6)(group).to_pydict() == {"node": [0, 1, 2], "n_links": [110, 0, 1], "root": [0, 0, 0]}


def test_no_node_meets_all_others_of_its_cell():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    groups = vd.clusters(x, rng)
    assert max(map(len, groups)) <= vd.CLUSTER and sum(len(g) ** 2 for g in groups) < 3000**2 / 4
    assert len(np.unique(np.concatenate(groups))) == 3000
    links, medoids = vd.flat_graph(x)
    assert len(links) == 3000 and links.max() < 3000 and len(medoids) > 10


def test_roots_of_a_path():
    assert vd.roots(6, np.array([5, 3, 4]), np.array([4, 2, 3])).tolist() == [0, 1, 2, 2, 2, 2]


def test_vectors_of_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.01], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [], [1.0, 0.0], [1.0, 0.0, 0.0], [1e300, 0.0], [1e-300, 0.0]]
    rows = [(i, v, None if i == 9 else 1) for i, v in enumerate(vectors)]
    schema = "vec_id long, embedding array<double>, label int, node string, part string, vector string, v string, norm string, shard int"
    table = spark.createDataFrame([(*r, "n", "p", "v", "w", "x", 0) for r in rows], schema)
    assert rows_of(vd.vector_duplicates(table), *VECTORS) == vector_dedup(rows)
    assert vd.vector_duplicates(table.limit(0)).count() == 0

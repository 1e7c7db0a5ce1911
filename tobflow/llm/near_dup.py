"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star candidate edges.

Documents with equal shingle sets form one node. Within a bucket every node is a candidate only of the bucket's
hub, the node that shares most buckets with most rows, so candidates grow with the bucket, not with its square.
A node is first measured, on the full shingle sets, against the hub of the most reach alone. Where a hub's members
then still belong to several components, all are measured against it, and their differences taken from a centre,
which need not be a text: the hub, but for the shingles that most members have otherwise. Any two members near enough to the centre are linked, and the nearest one links them all; any other two
can only be linked if they differ from the centre in the same shingles (see _across). Such pairs are found by these
shingles and confirmed too, so a star never hides a link that joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import BROADCAST_BYTES, documents, drop_tables, keyed, table
from tobflow.llm.graph import components

U = np.uint64
#: Odd multipliers of the 64-bit finaliser and of the word positions in a shingle.
MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
PLACES = 0x9E3779B97F4A7C15
#: Words kept by a worker's cache of word hashes.
CACHE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, element by element."""
    x = x ^ (x >> U(33))
    x = x * MIX[0]
    x = x ^ (x >> U(33))
    x = x * MIX[1]
    return x ^ (x >> U(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _places(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * U(PLACES)) | U(1)


def shingle_set(text: bytes, k: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of ASCII-lower-cased text; fewer words make one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    places = _places(k)
    if len(h) < k:
        return mix(np.array([np.sum(h * places[: len(h)], dtype=np.uint64) + U(len(h))], dtype=np.uint64))
    n = len(h) - k + 1
    total = h[:n] * places[0]
    for j in range(1, k):
        total = total + h[j : j + n] * places[j]
    return np.unique(mix(total + U(k)))


def densified(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One-permutation sketch: the least permuted hash in each bin; an empty bin takes that of the first full bin in its own random order."""
    p = np.sort(mix(hashes ^ U(PLACES)))
    at = ((p >> U(32)) * U(bins)) >> U(32)
    full, first = np.unique(at, return_index=True)
    sketch = np.zeros(bins, np.uint64)
    have = np.zeros(bins, bool)
    full = full.astype(np.int64)
    sketch[full], have[full] = p[first], True
    empty = np.flatnonzero(~have)
    t = 0
    while len(empty):
        # few full bins need many tries: look at growing blocks of each empty bin's order at once
        block = order[empty, t : t + max(4, bins // max(1, len(full)))]
        hit = have[block]
        found = hit.any(axis=1)
        rows = np.flatnonzero(found)
        sketch[empty[rows]] = sketch[block[rows, hit[rows].argmax(axis=1)]]
        empty = empty[~found]
        t += block.shape[1]
    return sketch


def bin_order(bins: int) -> np.ndarray:
    """For each bin, all bins in a random order that every document shares."""
    return np.random.default_rng(bins).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, order = _WordHashes(), bin_order(bands * rows)
        places, salt = _places(rows), mix(np.arange(bands, dtype=np.uint64) + U(7))
        for batch in batches:
            n, node, keys = [], [], []
            for text in batch.column("bytes").to_pylist():
                s = shingle_set(text, k, words)
                n.append(len(s))
                if not len(s):
                    node.append(None)
                    keys.append(None)
                    continue
                node.append(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).astype(np.int64).item())
                keys.append(mix((densified(s, bands * rows, order).reshape(bands, rows) * places).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row_hash", "n_shingles", "node", "keys"])

    return run


MEASURED = "node long, hub long, n_node long, n_hub long, n_common long, differ array<long>"


def _measure(k: int, differences: bool):
    """Rows sorted by hub and slice, the hub's own text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, words = None, None, _WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for h, node, text in zip(batch.column("hub").to_pylist(), batch.column("node").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                x = shingle_set(text, k, words)
                if node == h:
                    hub, own = h, x
                    continue
                assert hub == h, "a hub's text comes before its members"
                differ = np.setxor1d(x, own, assume_unique=True)
                rows.append((node, h, len(x), len(own), (len(x) + len(own) - len(differ)) // 2, (differ if differences else differ[:0]).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "hub", "n_node", "n_hub", "n_common", "differ"])

    return run


def compared(pairs: DataFrame, texts: DataFrame, k: int, *, differences: bool = False, slice_size: int = 256) -> DataFrame:
    """The pairs (node, hub) with the sizes of their full sets of k-word shingles and of their intersection, and, if asked for, the shingles that only one of them holds.

    A hub's members are dealt over slices of about slice_size, each of which gets the hub's text once. Texts are
    shuffled, not sets: hashes are longer and can't be compressed. pairs: a table, which is sent to the texts where
    its counted size allows, so that only pairs' texts are shuffled.
    """
    small = F.broadcast if pairs.count() * 32 <= BROADCAST_BYTES else lambda df: df
    slices = pairs.groupBy("hub").agg(F.ceil(F.count("*") / slice_size).cast("int").alias("slices"))
    members = pairs.join(slices, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int").alias("slice"))
    members = texts.join(small(members), "node").select("hub", "slice", "node", "bytes")
    hubs = texts.withColumnRenamed("node", "hub").join(small(slices), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("hub").alias("node"), "bytes")
    rows = members.unionByName(hubs).repartition("hub", "slice").sortWithinPartitions("hub", "slice", F.col("node") != F.col("hub"))
    return rows.select("hub", "node", "bytes").mapInArrow(_measure(k, differences), MEASURED)


def is_link(percent: int):
    return F.col("n_common") * 100 >= (F.col("n_node") + F.col("n_hub") - F.col("n_common")) * percent


def _common(members: DataFrame, share: int, least: int = 16) -> DataFrame:
    """(hub, common): of each hub, the differences that more than ``least`` of its members and one in ``share`` have; no more than ``share`` times as many as a member has."""
    counts = members.select("hub", F.explode("differ").alias("shingle")).groupBy("hub", "shingle").agg(F.count("*").alias("holders"))
    sizes = members.groupBy("hub").agg(F.count("*").alias("members"))
    return counts.where(F.col("holders") > least).join(sizes, "hub").where(F.col("holders") * share > F.col("members")).groupBy("hub").agg(F.array_sort(F.collect_list("shingle")).alias("common"))


def _centred(members: DataFrame, percent: int) -> DataFrame:
    """hub, node, n_node, differ, score, nearest and reach of members (hub, node, n_node, differ), by a centre of each hub.

    The centre is the hub's set with the differences that more than half of the members have taken over, and
    ``differ`` are those from the centre. With |D| of them and n shingles, score = (100 + percent) |D| - (100 -
    percent) n. Two sets differ in |Da| + |Db| - 2 |Da and Db| shingles and are linked just if these are at most
    (100 - percent) / (100 + percent) of na + nb, that is if both scores together are at most
    2 (100 + percent) |Da and Db|. ``nearest`` has the least score, -``reach``. A pair of scores that add up to 0 or
    less is linked, and then each is linked with the nearest.
    """
    both = members.join(_common(members, 2), "hub", "left")
    differ = F.when(F.col("common").isNull(), F.col("differ")).otherwise(F.concat(F.array_except("differ", "common"), F.array_except("common", "differ")))
    scored = both.select("hub", "node", "n_node", differ.alias("differ")).withColumn("score", F.size("differ") * (100 + percent) - F.col("n_node") * (100 - percent))
    scored = table(scored, "scored")
    nearest = scored.groupBy("hub").agg(F.min(F.struct("score", "node")).alias("x")).select("hub", F.col("x.node").alias("nearest"), (-F.col("x.score")).alias("reach"))
    return scored.join(nearest, "hub")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (node, hub) of different components that may reach the similarity; members as _centred gives them, with ``component`` and ``inside``, whether that is the nearest one's.

    One of a pair, b, is not inside, so it is not linked with the nearest: its score is over ``reach``, and a linked
    pair shares more than (score of a + reach) / 2 (100 + percent) of Da. Where a is not inside either, its partner may
    be, with a score of -reach at least: then it shares (score of a - reach) / 2 (100 + percent) or more. In either case
    one at least, and no less than |Da| - (100 - percent) / (100 + percent) of na + nb, as Db is no smaller than Da
    less what they differ in. In any order of all shingles, the first that a pair shares is among so many first ones
    of both that only as many as must be shared, less one, come behind them. The order used puts common ones last.
    From there on the pair shares no more than the shorter rest of both lists, and both scores say how many it must.
    """
    size, twice = F.size("differ"), 2 * (100 + percent)
    upper = lambda x: F.greatest(F.lit(1), F.ceil(x)).cast("int")
    with_outside = upper((F.col("score") + F.col("reach") + 1) / twice)
    longest = F.floor(F.col("n_node") * 100 / percent)
    with_any = F.greatest(upper((F.col("score") - F.col("reach")) / twice), (size - F.floor((F.col("n_node") + longest) * (100 - percent) / (100 + percent))).cast("int"))
    ordered = F.when(F.col("common").isNull(), F.col("differ")).otherwise(F.concat(F.array_except("differ", "common"), F.array_intersect("differ", "common")))
    lists = members.join(_common(members, 64), "hub", "left").withColumn("ordered", ordered)
    lists = lists.withColumn("short", F.greatest(F.lit(0), size - with_outside + 1))
    lists = lists.withColumn("long", F.when(F.col("inside"), F.col("short")).otherwise(F.greatest("short", size - with_any + 1))).where("long > 0")
    rows = lists.select("hub", "node", "component", "n_node", "score", "inside", "short", size.alias("size"), F.posexplode(F.slice("ordered", F.lit(1), F.col("long"))).alias("at", "shingle"))
    rows = table(rows.select("hub", "shingle", "node", "component", "n_node", "score", "inside", (F.col("size") - F.col("at")).alias("rest"), (F.col("at") < F.col("short")).alias("early")), "listed")
    same = [F.col("a.hub") == F.col("b.hub"), F.col("a.shingle") == F.col("b.shingle"), F.col("a.component") != F.col("b.component")]
    sizes = [F.col("a.n_node") * 100 >= F.col("b.n_node") * percent, F.col("b.n_node") * 100 >= F.col("a.n_node") * percent]
    enough = F.col("a.score") + F.col("b.score") <= F.least("a.rest", "b.rest") * twice
    # an inside one is listed early only; of two outside ones both are looked up early
    kinds = F.col("a.inside") | (F.col("b.early") & (F.col("a.node") < F.col("b.node")))
    found = rows.where("early").alias("a").join(rows.where("NOT inside").alias("b"), [*same, *sizes, enough, kinds])
    pairs = found.select(F.greatest("a.node", "b.node").alias("node"), F.least("a.node", "b.node").alias("hub"))
    out = table(pairs.distinct(), "across")
    drop_tables(rows)
    return out


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 46, rows: int = 6, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of docs; with_hash adds the row_hash of ``keyed``.

    Links join documents whose sets of distinct word shingles have 100 * intersection >= percent * union. A pair
    at 0.8 shares no bucket with a chance of (1 - 0.8**6)**46 = 8e-7, and more similar pairs with less. Null or
    empty texts have no shingles and link with nothing; component_id is the smallest doc_id reachable; repeated
    rows of a doc_id share its component and are all kept or all dropped; a null doc_id is never the smallest
    unless alone, and of a component of null doc_ids only, one text is kept; an empty table gives no rows; other columns are ignored.
    A very long text has as many shingles as words; of equally near hubs a node takes the smaller.
    """
    base = keyed(docs)
    source = base.select("doc_id", "row_hash", F.col("text").cast("binary").alias("bytes"))
    sketches = table(source.mapInArrow(_sketches(shingle, bands, rows), "doc_id long, row_hash long, n_shingles long, node long, keys array<long>"), "sketches")
    exploded = sketches.where("n_shingles > 0").select("node", F.explode("keys").alias("key"))
    sizes = exploded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("size")).where("low <> high")
    shared = table(exploded.join(sizes.select("key", "size"), "key").distinct(), "buckets")
    # the keys are most of the sketches, and few of them are shared
    found = table(sketches.drop("keys"), "nodes")
    drop_tables(sketches)
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    hubs = shared.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node")).alias("hub"))
    starred = table(shared.join(hubs, "key").select("key", "node", "hub.reach", F.col("hub.node").alias("hub")), "stars")
    drop_tables(shared)

    # a node's set is made from one of its texts; rows that repeat this one would bring it again
    members = found.join(starred.select("node").distinct(), "node", "left_semi").groupBy("node", "doc_id", "row_hash").agg(F.count("*").alias("copies"))
    members = table(members.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash", "copies")).alias("m")).select("node", "m.*"), "members")
    n_members, copies = members.agg(F.count("*"), F.max("copies")).first()
    bounded = n_members * 32 <= BROADCAST_BYTES
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.row_hash") == F.col("b.row_hash")]
    texts = source.alias("a").join((F.broadcast(members) if bounded else members).alias("b"), same).select("node", "copies", "bytes")
    if (copies or 0) > 1:
        texts = texts.where("copies = 1").unionByName(texts.where("copies > 1").dropDuplicates(["node"]))
    texts = table(texts.select("node", "bytes"), "texts")

    as_edges = lambda df: df.where(is_link(percent)).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    best = starred.groupBy("node").agg(F.max(F.struct("reach", "hub"))["hub"].alias("hub")).where("node <> hub")
    first = table(as_edges(compared(table(best, "pairs"), texts, shingle)), "links")
    labels = table(components(first), "labels")
    placed = starred.join(labels, "node", "left").select("key", "node", "hub", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("hub").alias("hub")).where("low <> high").select("hub").distinct()
    # the hubs of buckets that hold several components, with all nodes of all their buckets
    still = table(starred.select("hub", "node").where("node <> hub").distinct().join(mixed, "hub", "left_semi"), "still")
    drop_tables(starred)
    again = table(compared(still, texts, shingle, differences=True), "again")
    centres = again.groupBy("hub").agg(F.first("n_hub").alias("n_node")).select("hub", F.col("hub").alias("node"), "n_node", F.array().cast("array<long>").alias("differ"))
    centred = _centred(again.select("hub", "node", "n_node", "differ").union(centres), percent)
    near = table(centred, "near")
    drop_tables(centred)
    sure = near.where("score <= reach AND node <> nearest").select(F.col("node").alias("u"), F.col("nearest").alias("v"))
    links = table(first.union(as_edges(again)).union(sure), "links")
    drop_tables(again, still)
    labels = table(components(links), "labels")
    parts = near.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    home = parts.where("node = nearest").select("hub", F.col("component").alias("home"))
    across = _across(parts.join(home, "hub").withColumn("inside", F.col("component") == F.col("home")), percent)
    more = table(as_edges(compared(across, texts, shingle)), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    drop_tables(near, texts, across)

    nodes = found.join(labels, "node", "left").select("doc_id", "row_hash", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = table(nodes.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"), F.min("row_hash").alias("least_hash")), "least")
    # every row of a component needs its least doc_id: a join of two tables, so that Spark can split a hot component
    component_id = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    nameless = F.col("component").isNotNull() & F.col("least").isNull()
    kept = F.when(nameless, F.col("row_hash") == F.col("least_hash")).otherwise(F.col("doc_id").eqNullSafe(component_id))
    out = nodes.join(least, "component", "left")
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), kept.alias("kept"), *["row_hash"] * with_hash)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)

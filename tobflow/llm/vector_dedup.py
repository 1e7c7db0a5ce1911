"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors become one node. The nodes of a label form a cell; a cell above its size is dealt over the cells of
pivots drawn from it, again and again. A node joins the cell of its closest pivot, its home, and as a guest others
that a partner in range may have as home: of two nodes at home in different cells, at least one lies within half the
margin of the border between them and is a guest in the other's home. A pair that meets in one home only is counted
there for both ends. Cells are dealt as ids; vectors go to their cells once. Within a cell, nodes meet in small
overlapping clusters; each cluster gives its nodes robust-pruned adjacency lists, and a node's lists are united, with
their reverse lists, to one flat graph. Each node is searched for in its home cell, from its own place and the
clusters' medoids: a greedy beam search, which expands every node in range. Crowds don't enter the graph: nodes within half the angle of range of
a hub are linked with each other for certain, so a crowd counts as one, and others are held against it by products of
whole blocks. What the links found tie together is then verified in double
precision, each node with each other of its tie, so a link found from one end counts at both. A hashed sample of
each label's nodes is audited against all nodes of the label; labels whose recall is short are searched again with
cells that overlap as far as any partner in range can lie and wider beams, and audited again.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import BROADCAST_BYTES, bound, drop_tables, table
from tobflow.llm.graph import components
from tobflow.llm.near_dup import mix

U = np.uint64
CELLS = "parent long, cell long, node long, home boolean"
FOUND = "node long, n_links long, root long"
#: Closest and random candidates of a node in a cluster, neighbours that it keeps there, and how much closer another must be to drop one.
NEAR, RANDOM, DEGREE, ALPHA = 12, 4, 8, 1.2
#: Clusters that a node joins in its cell, and nodes of a cluster at most.
OVERLAP, CLUSTER = 3, 256
#: Hubs tried in a cell, and nodes that make a crowd around one.
HUBS, CROWD = 64, 48
#: Rows of a cell that one task deals, most rounds of dealing, and pivots of a cell: about so many for each cell_size of its nodes, and at most.
DEAL_ROWS, ROUNDS, PIVOTS, MOST_PIVOTS = 50_000, 6, 6, 1024


def unit(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """The n vectors of a list column in double precision, of length 1."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(float).reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def pruned(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Out-neighbours in a cluster of unit vectors (n x DEGREE, -1 for none): the closest candidate stays and drops those it is ALPHA times closer to."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return out
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(NEAR, n - 1)
    cand = np.concatenate([np.argpartition(-s, k - 1, axis=1)[:, :k], rng.integers(0, n, (n, RANDOM))], axis=1)
    sim = np.take_along_axis(s, cand, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    dropped = sim < -1.5
    dropped[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    # squares of distances, halved
    own = 1 - sim
    between = ALPHA * ALPHA * (1 - s[cand[:, :, None], cand[:, None, :]])
    kept = np.zeros(n, np.int64)
    for j in range(cand.shape[1]):
        take = ~dropped[:, j] & (kept < DEGREE)
        hit = np.flatnonzero(take)
        out[hit, kept[hit]] = cand[hit, j]
        kept[hit] += 1
        dropped |= take[:, None] & (between[:, j, :] <= own)
    return out


def clusters(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Overlapping clusters around about sqrt(n) of the vectors; one above CLUSTER nodes is cut at random."""
    n = len(x)
    if n <= CLUSTER:
        return [np.arange(n)]
    pivots = x[rng.choice(n, int(np.ceil(np.sqrt(n))), replace=False)]
    close = np.argpartition(-(x @ pivots.T), OVERLAP - 1, axis=1)[:, :OVERLAP]
    member, place = np.repeat(np.arange(n), OVERLAP), close.ravel()
    order = rng.permutation(len(place))
    order = order[np.argsort(place[order], kind="stable")]
    groups = np.split(member[order], np.flatnonzero(np.diff(place[order])) + 1)
    return [part for g in groups for part in np.array_split(g, -(-len(g) // CLUSTER))]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once; np.unique's hash table takes several times as long."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def flat_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists (padded with -1), united over all clusters and with their reverse lists, and the clusters' medoids."""
    n, rng = len(x), np.random.default_rng(len(x))
    source, target, medoids = [], [], []
    for members in clusters(x, rng):
        lists = pruned(x[members], rng)
        at, col = np.nonzero(lists >= 0)
        source.append(members[at])
        target.append(members[lists[at, col]])
        medoids.append(members[np.argmax(x[members] @ x[members].mean(axis=0))])
    source += [np.arange(n), *target]
    target = [*target, rng.integers(0, n, n), *source[: len(target)]]
    pairs = distinct(np.concatenate(source) * n + np.concatenate(target))
    a, b = pairs // n, pairs % n
    a, b = a[a != b], b[a != b]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    # a node that very many others chose keeps so many of them
    fits = rank < 6 * DEGREE
    links = np.full((n, int(rank[fits].max(initial=-1)) + 1), -1, np.int64)
    links[a[fits], rank[fits]] = b[fits]
    return links, np.unique(medoids)


def in_range(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, least: float, beam: int, slack: float = 0.06) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) for each node found with a dot product of ``least`` or more.

    Greedy, for all queries side by side: of the nodes just seen, those among a query's ``beam`` best so far are
    expanded, and every one in range or near it, until nothing new is.
    """
    q, n = len(queries), len(x)
    seen, best = np.zeros(q * n, bool), np.full((q, beam), -3.0)
    who, node = np.repeat(np.arange(q), entries.shape[1]), entries.ravel()
    who, node = who[node >= 0], node[node >= 0]
    found: list[tuple[np.ndarray, np.ndarray]] = [(who[:0], node[:0])]
    while len(who):
        keys = who * n + node
        keys = distinct(keys[~seen[keys]])
        seen[keys] = True
        who, node = keys // n, keys % n
        sim = np.einsum("pd,pd->p", queries[who], x[node])
        hit = sim >= least
        found.append((who[hit], node[hit]))
        order = np.lexsort((-sim, who))
        ranked = who[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        top = rank < beam
        new = np.full((q, beam), -3.0)
        new[ranked[top], rank[top]] = sim[order][top]
        best = -np.sort(-np.concatenate([best, new], axis=1), axis=1)[:, :beam]
        go = (sim >= best[who, -1]) | (sim >= least - slack)
        near = links[node[go]]
        who, node = np.repeat(who[go], near.shape[1]), near.ravel()
        who, node = who[node >= 0], node[node >= 0]
    return np.concatenate([w for w, _ in found]), np.concatenate([v for _, v in found])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place reachable from each of n places by the edges (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, least)
        root = root[root]
        if (root == before).all():
            return root


def crowds(y: np.ndarray, least: float) -> list[np.ndarray]:
    """Disjoint sets of at least CROWD vectors, each within half the angle of ``least`` of a hub, its first: all of a set link."""
    inner = np.cos(np.arccos(least) / 2) + 1e-9
    tried = np.random.default_rng(len(y)).permutation(len(y))[:HUBS]
    near = y[tried] @ y.T >= inner
    free, out = np.ones(len(y), bool), []
    for k in np.argsort(-near.sum(axis=1), kind="stable"):
        members = np.flatnonzero(near[k] & free)
        if len(members) >= CROWD and free[tried[k]]:
            out.append(np.append(tried[k], members[members != tried[k]]))
            free[members] = False
    return out


def crowd_links(x: np.ndarray, crowd: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, row of the crowd): one link for each row of x that links with any vector of the crowd, found exactly."""
    dots = x @ crowd[0]
    width = np.arccos(np.clip((crowd @ crowd[0]).min(), -1, 1))
    reach = np.cos(min(np.pi, np.arccos(least) + width)) - 1e-9
    rows = np.flatnonzero(dots >= reach)
    best = np.zeros(len(rows), np.int64)
    linked = dots[rows] >= least
    for at in range(0, len(rows), 512):
        part = np.flatnonzero(~linked[at : at + 512]) + at
        if len(part):
            products = x[rows[part]] @ crowd.T
            best[part] = products.argmax(axis=1)
            linked[part] = products.max(axis=1) >= least
    return rows[linked], best[linked]


def guest_of(home: np.ndarray, others: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that rows are at home in, by number, and (row, number) as sorted keys for each other cell of a row (``others``) among them."""
    known, number = np.unique(home, return_inverse=True)
    counts = np.diff(others.offsets.to_numpy())
    row, cell = np.repeat(np.arange(len(home)), counts), others.flatten().to_numpy()
    place = np.minimum(np.searchsorted(known, cell), len(known) - 1)
    there = known[place] == cell
    return number, np.sort(row[there] * len(known) + place[there])


def _search(least: float, beam: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("node", "ascending")])
        ids, weight = group.column("node").to_numpy(), group.column("copies").to_numpy()
        is_member, is_query, is_guest = (group.column(x).to_numpy(zero_copy_only=False) for x in ("is_member", "is_query", "is_guest"))
        x = unit(group.column("vector"), len(ids))
        members, asked = np.flatnonzero(is_member), np.flatnonzero(is_query)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if len(members) and len(asked):
            y = x[members]
            pairs = [(asked[:0], asked[:0])]
            loose = np.ones(len(members), bool)
            for crowd in crowds(y, least):
                loose[crowd] = False
                who, node = crowd_links(x, y[crowd], least)
                pairs += [(who, members[crowd[node]]), (members[crowd], np.full(len(crowd), members[crowd[0]]))]
            members = members[loose]
            # the search runs in single precision and gives a little more; see below
            single = x.astype(np.float32)
            y = single[members]
            links, medoids = flat_graph(y) if len(y) else (None, None)
            place = np.full(len(ids), -1)
            place[members] = np.arange(len(members))
            k = 0 if medoids is None else min(3, len(medoids))
            for at in range(0, len(asked) if k else 0, 256):
                rows = asked[at : at + 256]
                near = np.argpartition(-(single[rows] @ y[medoids].T), k - 1, axis=1)[:, :k]
                who, node = in_range(y, links, single[rows], np.concatenate([place[rows, None], medoids[near]], axis=1), least - 1e-5, beam)
                sure = np.einsum("pd,pd->p", x[rows[who]], x[members[node]]) >= least
                who, node = who[sure], node[sure]
                pairs.append((rows[who], members[node]))
            a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
            a, b = a[a != b], b[a != b]
            root = roots(len(ids), a, b)
            number, elsewhere = guest_of(group.column("at").to_numpy(), group.column("others").combine_chunks())
            base = number.max() + 1
            tied = np.flatnonzero(np.isin(root, root[a]))
            order = tied[np.argsort(root[tied], kind="stable")]
            for tie in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(order) else []:
                mine, theirs = tie[is_query[tie]], tie[is_member[tie]]
                guests = np.flatnonzero(is_guest[theirs])
                homes, home = np.unique(number[theirs[guests]], return_inverse=True)
                count = np.zeros(len(tie), np.int64)
                to_guests = np.zeros(len(guests), np.int64)
                for at in range(0, len(mine), 512):
                    rows = mine[at : at + 512]
                    linked = (x[rows] @ x[theirs].T >= least) & (rows[:, None] != theirs[None, :])
                    count[np.searchsorted(tie, rows)] = linked @ weight[theirs]
                    if len(guests):
                        # a guest's own home counts those that are there too
                        absent = ~np.isin(rows[:, None] * base + homes[None, :], elsewhere)
                        to_guests += weight[rows] @ (linked[:, guests] & absent[:, home])
                count[np.searchsorted(tie, theirs[guests])] += to_guests
                for column, values in zip(out, (ids[tie], count, ids[root[tie]]), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["node", "n_links", "root"])

    return run


def apart_enough(pivots: np.ndarray, reach: float) -> np.ndarray:
    """The pivots but those within reach of one before them, which would not part a crowd."""
    kept: list[int] = []
    for i, near in enumerate(pivots @ pivots.T >= 1 - reach * reach / 2):
        if not near[kept].any():
            kept.append(i)
    return pivots[kept]


def _deal(reach: float, sigmas: float | None):
    """Rows sorted by cell and slice, the cell's pivots first: the new cells of each node; it is at home in the first if it was at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, margin = np.empty((0, 0)), np.empty((0, 0))
        for batch in batches:
            cell, heads = batch.column("cell").to_numpy(), batch.column("pivots")
            starts = np.append(np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | np.asarray(heads.is_valid())[1:])), len(cell)) if len(cell) else [0]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if heads[int(a)].is_valid:
                    found = heads[int(a)].values
                    pivots = apart_enough(unit(found, len(found)), reach)
                    # a partner differs from a vector by reach at most, and so its products with two pivots by reach times their distance; in many
                    # dimensions by a few times that over their root, but for pivots that may lie in one crowd
                    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
                    likely = apart * (1.0 if sigmas is None else min(1.0, sigmas / np.sqrt(pivots.shape[1])))
                    margin = reach * np.maximum(likely, np.minimum(apart, 2 * reach))
                    a += 1
                for at in range(a, b, 2048):
                    part = batch.slice(at, min(b - at, 2048))
                    dots = unit(part.column("vector"), len(part)) @ pivots.T
                    best = dots.argmax(axis=1)
                    home = part.column("home").to_numpy(zero_copy_only=False)
                    # of two at home here, one is within half of the margin
                    row, pivot = np.nonzero(dots[np.arange(len(part)), best][:, None] - dots <= margin[best] * np.where(home, 0.5, 1.0)[:, None] + 1e-9)
                    new = mix(cell[a : a + 1].astype(np.int64).view(np.uint64) + (pivot.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)).view(np.int64)
                    nodes = part.column("node").to_numpy()[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), cell[a])), pa.array(new), pa.array(nodes), pa.array(home[row] & (pivot == best[row]))], names=["parent", "cell", "node", "home"])

    return run


def small(ids: DataFrame) -> DataFrame:
    """A table of a few numbers a row, to be broadcast only where its counted size allows."""
    return F.broadcast(ids) if ids.count() * 32 <= BROADCAST_BYTES else ids


def pivots_of(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell and its pivots, for each cell (cell, n, wanted, node): its nodes are dealt by a hash over ``wanted`` lots, and the least id of each lot is one.

    So every cell has a pivot, and one of n nodes has the wanted number but for lots that stay empty.
    """
    lot = F.pmod(F.xxhash64("node", "cell"), "wanted")
    chosen = table(cells.groupBy("cell", lot.alias("lot")).agg(F.min("node").alias("node"), F.first("n").alias("n")).drop("lot"), "pivot-ids")
    out = table(nodes.select("node", "vector").join(small(chosen), "node").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("node", "vector")))["vector"].alias("pivots"), F.first("n").alias("n")), "pivots")
    drop_tables(chosen)
    return out


def cells_of(nodes: DataFrame, *, least: float, cell_size: int, sigmas: float | None) -> DataFrame:
    """cell, node, home: the nodes (node, part, vector, copies) in cells of at most cell_size, but for those that pivots cannot part.

    A cell that dealing would not spare a third of its products (nodes at home times nodes) stays as it is. sigmas: how
    many standard deviations of a partner's offset cells overlap by; None: as far as it can be, whatever the dimension.
    """
    start = nodes.select(F.xxhash64("part").alias("cell"), "node", F.lit(True).alias("home"), "vector")
    now, done, used = start.drop("vector"), [], []
    for turn in range(ROUNDS):
        sizes = now.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") * PIVOTS / cell_size))
        big = table(sizes.where(F.col("n") > cell_size).select("cell", "n", "homes", wanted.alias("wanted")), "big-cells")
        used.append(big)
        if big.isEmpty():
            break
        done.append(now.join(big, "cell", "left_anti"))
        pivots = pivots_of(now.join(big, "cell"), nodes)
        slices = F.ceil(F.col("n") / DEAL_ROWS).cast("int")
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("vector", nodes.schema["vector"].dataType), ("home", "boolean"))]
        heads = pivots.select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "pivots", *blank)
        rest = (now.join(nodes.select("node", "vector"), "node") if turn else start).join(big, "cell")
        members = rest.select("cell", F.pmod(F.xxhash64("node"), slices).alias("slice"), F.lit(None).cast(pivots.schema["pivots"].dataType).alias("pivots"), "node", "vector", "home")
        rows = heads.unionByName(members).repartition("cell", "slice").sortWithinPartitions("cell", "slice", F.col("pivots").isNull())
        dealt = table(rows.mapInArrow(_deal(float(np.sqrt(2 - 2 * least)), sigmas), CELLS), "cells")
        drop_tables(pivots)
        work = dealt.groupBy("parent", "cell").agg((F.count_if("home") * F.count("*")).alias("work")).groupBy("parent").agg(F.sum("work").alias("work"))
        worth = table(work.join(big, work["parent"] == big["cell"]).where(F.col("work") * 3 <= F.col("n") * F.col("homes") * 2).select("parent"), "worth")
        used += [dealt, worth]
        done.append(now.join(big.join(worth, F.col("cell") == F.col("parent"), "left_anti").select("cell"), "cell", "left_semi"))
        now = dealt.join(worth, "parent", "left_semi").select("cell", "node", "home")
    for part in done:
        now = now.unionByName(part)
    out = table(now, "dealt")
    drop_tables(*used)
    return out


def linked(nodes: DataFrame, *, least: float, cell_size: int, beam: int, sigmas: float | None) -> DataFrame:
    """node, n_links (copies of others) and root: rows for each node with a link, whose n_links add up, and for each that a cell ties to one."""
    cells = cells_of(nodes, least=least, cell_size=cell_size, sigmas=sigmas)
    # a cell above twice its size is dealt over slices, and each of its queries is sent to all of them
    slices = cells.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell_size)).cast("int").alias("slices"))
    places = cells.join(slices, "cell").groupBy("node").agg(F.collect_list(F.struct("cell", "home", "slices")).alias("places"))
    at = F.element_at(F.filter("places", lambda p: p["home"]), 1)["cell"]
    others = F.transform(F.filter("places", lambda p: ~p["home"]), lambda p: p["cell"])
    placed = places.select("node", at.alias("at"), others.alias("others"), "places").join(nodes.select("node", "vector", "copies"), "node").withColumn("place", F.explode("places")).select("*", "place.*")
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    as_member = F.transform(every, lambda i: F.struct(own.alias("held"), i.alias("asking"), F.lit(True).alias("is_member"), (F.col("home") & (i == own)).alias("is_query")))
    as_query = F.transform(F.filter(every, lambda i: F.col("home") & (i != own)), lambda i: F.struct(i.alias("held"), own.alias("asking"), F.lit(False).alias("is_member"), F.lit(True).alias("is_query")))
    mine = F.when(F.col("home"), F.col("others")).otherwise(F.array().cast("array<long>")).alias("others")
    sent = placed.select("cell", "node", "vector", "copies", "at", mine, (~F.col("home")).alias("is_guest"), F.explode(F.concat(as_member, as_query)).alias("s")).select("cell", "node", "vector", "copies", "at", "others", "is_guest", "s.*")
    out = table(sent.groupBy("cell", "held", "asking").applyInArrow(_search(least, beam), FOUND), "found")
    drop_tables(cells)
    return out


def _audit(queries: dict[str, tuple[np.ndarray, np.ndarray]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.array(batch.column("part").to_pylist(), object)
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            for p in set(part.tolist()) & set(queries):
                ids, q = queries[p]
                rows = np.flatnonzero(part == p)
                x = unit(batch.column("vector").take(pa.array(rows)), len(rows))
                count = ((q @ x.T >= least) & (ids[:, None] != node[rows][None, :])) @ copies[rows]
                hit = np.flatnonzero(count)
                yield pa.record_batch([pa.array(ids[hit]), pa.array(count[hit])], names=["node", "true_links"])

    return run


def audited(nodes: DataFrame, *, least: float, audits: int) -> DataFrame:
    """part, node and true_links for at most ``audits`` nodes: their links among all nodes of their label, by brute force.

    Labels take turns, so that each has its share however large another is; within a label a hash chooses.
    """
    chance = F.xxhash64("node", F.lit("audit"))
    turns = nodes.select("part", chance.alias("chance")).groupBy("part", F.pmod("chance", F.lit(audits)).alias("turn")).agg(F.min("chance").alias("chance"))
    chosen = turns.orderBy("turn", "chance").limit(audits).select("part", "chance")
    sample = nodes.withColumn("chance", chance).join(F.broadcast(chosen), ["part", "chance"]).select("node", "part", "vector").collect()
    by_part: dict[str, list] = {}
    for r in sample:
        by_part.setdefault(r["part"], []).append((r["node"], r["vector"]))
    queries = {p: (np.array([n for n, _ in rows], np.int64), unit(pa.array([v for _, v in rows], pa.list_(pa.float64())), len(rows))) for p, rows in by_part.items()}
    counts = nodes.select("node", "part", "vector", "copies").mapInArrow(_audit(queries, least), "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    asked = nodes.sparkSession.createDataFrame([(r["part"], r["node"]) for r in sample], "part string, node long")
    return table(asked.join(counts, "node", "left").select("part", "node", F.coalesce("true_links", F.lit(0)).alias("true_links")), "audit")


def recall(found: DataFrame, audit: DataFrame) -> DataFrame:
    """part and recall: the share of the audited nodes' links that the search found, for each audited label; 1 where they have none."""
    got = audit.join(found.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
    there, seen = F.sum("true_links"), F.sum(F.least("true_links", F.coalesce("n_links", F.lit(0))))
    return got.groupBy("part").agg(F.when(there > 0, seen / there).otherwise(1.0).alias("recall"))


def searched(nodes: DataFrame, audit: DataFrame, *, least: float, cell_size: int, sigmas: float, beam: int, enough: float) -> DataFrame:
    """What ``linked`` finds; labels short of ``enough`` recall are searched again, with cells as wide as a partner can lie and wider beams.

    Labels beyond the audit's reach are searched again as soon as an audited one is short. What is still short
    after the last search is returned with a warning that gives the figure.
    """
    found = linked(nodes, least=least, cell_size=cell_size, beam=beam, sigmas=sigmas)
    for wider in (8 * beam, 64 * beam):
        figures = table(recall(found, audit), "recall")
        if figures.where(F.col("recall") < enough).isEmpty():
            return found
        again = table(nodes.join(F.broadcast(figures.where(F.col("recall") >= enough)), "part", "left_anti"), "again")
        new = linked(again, least=least, cell_size=cell_size, beam=wider, sigmas=None)
        found = table(found.join(again.select("node"), "node", "left_anti").unionByName(new), "found")
    lowest = recall(found, audit).agg(F.min("recall")).first()[0]
    if lowest is not None and lowest < enough:
        warnings.warn(f"links found are {lowest:.3f} of those of the audited vectors in the label where fewest are", stacklevel=2)
    return found


def vector_duplicates(vectors: DataFrame, *, least: float = 0.98, cell_size: int = 4000, sigmas: float = 4.0, beam: int = 6, audits: int = 256, enough: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_links, a row per row of vectors (vec_id, embedding, label).

    Links join vectors of one label and length with a cosine of ``least`` or more. Null labels, and vectors that
    are null, empty, zero or hold null or non-finite components, link with nothing. n_links counts the other
    rows linked, copies of the vector included; component_id is the smallest vec_id reachable; repeated rows are
    copies of each other; a null vec_id is never the smallest unless alone; audited_links is the count by
    brute force over all vectors of the label for ``audits`` vectors, dealt over labels, and null for others; an
    empty table gives no rows; other columns are ignored. Labels where the search found less than ``enough`` of
    the audited links are searched again, see ``searched``.
    """
    # single precision is kept as it is, at half the bytes; all arithmetic is in double
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = bound(F.array_max(F.transform("v", F.abs)), lambda top: F.when(top > 0, F.transform("v", lambda c: c / top)))
    scaled_to_one = bound(scaled, lambda u: bound(F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, c: a + c * c)), lambda norm: F.transform(u, lambda c: c / norm)))
    rows = base.select("vec_id", "label", "v", F.when(ok, scaled_to_one).alias("unit"))
    part = F.concat_ws("/", F.col("label").cast("string"), F.size("unit").cast("string"))
    rows = rows.select("vec_id", "v", "unit", F.when(F.col("unit").isNotNull(), part).alias("part"))
    rows = rows.withColumn("node", F.when(F.col("unit").isNotNull(), F.xxhash64("part", "unit")))
    vector = F.col("v").cast("array<float>") if single else F.col("v")
    nodes = table(rows.where("node IS NOT NULL").select("node", "part", vector.alias("vector")).groupBy("node", "part").agg(F.min("vector").alias("vector"), F.count("*").alias("copies")), "nodes")
    rows = table(rows.select("vec_id", "node"), "vectors")

    audit = audited(nodes, least=least, audits=audits)
    found = searched(nodes, audit, least=least, cell_size=cell_size, sigmas=sigmas, beam=beam, enough=enough)

    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    labels = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    out = rows.join(nodes.select("node", "copies"), "node", "left").join(counts, "node", "left").join(labels, "node", "left").join(audit.drop("part"), "node", "left")
    out = table(out.withColumn("component", F.coalesce("component", "node")), "linked")
    smallest = out.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    out = out.join(smallest, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("smallest"))
    n_links = F.coalesce(F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long")
    out = out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), (F.col("true_links") + F.col("copies") - 1).alias("audited_links"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audited_links")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

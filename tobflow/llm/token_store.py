"""A content-addressed store of token ids.

Layout of a store folder, all Parquet:
  chunks    digest, ids: each distinct chunk once, ids as little-endian integers of ``width`` bytes
  recipes   part, doc_id, row_hash, n_tokens, start_in_part, digests, leaf: ascending by doc_id over the parts
  manifest  part, n_docs, n_tokens, root: Merkle root over the part's leaves, in order
  top       parts, root: how many parts there are, and a digest of their roots, in order

A chunk ends where a rolling hash of its last eight ids has zero low bits (so equal passages are cut alike), or at
its largest size. A leaf hashes a document's id and its chunk digests, so roots vouch for recipes, and digests for
chunks. Reading verifies all of it: a chunk that is damaged or gone, a recipe that is changed, and a manifest that
lacks a part or a document each end in an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tobflow.llm.common import documents, drop_tables, keyed, new_path, table
from tobflow.llm.encoding import encoder as shared_encoder
from tobflow.llm.encoding import slices
from tobflow.llm.near_dup import mix

U = np.uint64
WINDOW = 8
#: Smallest and largest ids of a chunk (a document's last may be smaller), and low bits that are zero at a cut.
LEAST, MOST, BITS = 32, 1024, 7
SPOOL = "doc_id long, row_hash long, n_tokens long, digests array<binary>, chunks array<struct<digest:binary,ids:binary>>"
RECIPES = "part int, doc_id long, row_hash long, n_tokens long, start_in_part long, digests array<binary>, leaf binary, root binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaf(doc_id: int | None, digests: list[bytes]) -> bytes:
    return digest(b"\0" + (b"" if doc_id is None else struct.pack("<q", doc_id)) + b"".join(digests))


class Merkle:
    """Root over leaves added one by one: keeps one node per level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, left in enumerate(self.levels):
            if left is None:
                self.levels[i] = node
                return
            self.levels[i], node = None, digest(b"\1" + left + node)
        self.levels.append(node)

    def root(self) -> bytes:
        out = b""
        for node in self.levels:
            if node is not None:
                out = digest(b"\1" + node + out) if out else node
        return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    g = mix(ids.astype(np.uint64) + U(1))
    h = g[WINDOW - 1 :].copy()
    for j in range(1, WINDOW):
        h += g[WINDOW - 1 - j : n - j] << U(4 * j)
    marks = (np.flatnonzero((h >> U(40)) & U((1 << BITS) - 1) == 0) + WINDOW).tolist()
    out, last = [], 0
    for m in (*marks, n):
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            out.append(m)
            last = m
    return out


def _spool(path: str | None, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = shared_encoder(path or default_tokenizer()), set()
        chunk = pa.list_(pa.struct([("digest", pa.binary()), ("ids", pa.binary())]))
        for whole in batches:
            for batch in slices(whole, "text", 2048):
                flat, counts = encoder.encode(batch.column("text"))
                if len(flat) and max(int(flat.max()), end_id) >> (8 * width):
                    raise ValueError(f"ids do not fit {width} bytes")
                ends = np.cumsum(counts)
                names, chunks = [], []
                for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
                    ids = np.append(flat[a:b], np.uint32(end_id))
                    raw, own, new, last = ids.astype(f"<u{width}").tobytes(), [], [], 0
                    for cut in cuts(ids):
                        data = raw[last * width : cut * width]
                        own.append(d := digest(data))
                        if d not in seen:
                            if len(seen) >= 1_000_000:
                                seen.clear()
                            seen.add(d)
                            new.append({"digest": d, "ids": data})
                        last = cut
                    names.append(own)
                    chunks.append(new)
                yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(counts + 1), pa.array(names, pa.list_(pa.binary())), pa.array(chunks, chunk)], names=["doc_id", "row_hash", "n_tokens", "digests", "chunks"])

    return run


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running starts, leaves and, as the last row, the root of a sorted partition."""
    from pyspark import TaskContext

    part, total, n, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in RECIPES.split(", ")]
    for batch in batches:
        counts = batch.column("n_tokens").to_numpy()
        digests = batch.column("digests").to_pylist()
        leaves = [leaf(d, x) for d, x in zip(batch.column("doc_id").to_pylist(), digests, strict=True)]
        for x in leaves:
            tree.add(x)
        starts = total + np.cumsum(counts) - counts
        total, n = total + int(counts.sum()), n + len(counts)
        k = len(leaves)
        yield pa.record_batch([pa.array([part] * k, kinds[0]), batch.column("doc_id"), batch.column("row_hash"), batch.column("n_tokens"), pa.array(starts, kinds[4]), pa.array(digests, kinds[5]), pa.array(leaves, kinds[6]), pa.nulls(k, kinds[7])], names=names)
    if n:
        yield pa.record_batch([pa.array([x], k) for x, k in zip((part, None, None, total, n, None, None, tree.root()), kinds, strict=True)], names=names)


@dataclass
class TokenStore:
    spark: SparkSession
    path: str
    width: int

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("digest binary, ids binary").parquet(f"{self.path}/chunks")

    def recipes(self) -> DataFrame:
        return self.spark.read.schema(RECIPES).parquet(f"{self.path}/recipes").where("root IS NULL").drop("root")

    def manifest(self) -> DataFrame:
        rows = self.spark.read.schema(RECIPES).parquet(f"{self.path}/recipes").where("root IS NOT NULL")
        return rows.select("part", F.col("start_in_part").alias("n_docs"), "n_tokens", "root")

    def top(self) -> DataFrame:
        """parts and root, one row, from the manifest as it is now."""
        roots = F.transform(F.array_sort(F.collect_list(F.struct("part", "root"))), lambda x: F.concat(x["part"].cast("string"), F.lit(":"), F.hex(x["root"])))
        return self.manifest().agg(F.count("*").alias("parts"), F.sha2(F.array_join(roots, " "), 256).alias("root"))

    def check_top(self) -> None:
        """ValueError if the manifest is not that of the time of writing."""
        kept = self.spark.read.schema("parts long, root string").parquet(f"{self.path}/top").first()
        now = self.top().first()
        if kept != now:
            raise ValueError(f"the manifest has {now.parts} parts of root {now.root}, not {kept.parts if kept else 'any'} of {kept.root if kept else 'any'}")

    def verified_recipes(self) -> DataFrame:
        """The recipes; a row whose leaf is not that of its document and digests is an error."""
        return self.recipes().mapInArrow(_leaves_hold, RECIPES.removesuffix(", root binary"))

    def verified_parts(self) -> DataFrame:
        """part and n_tokens; a part whose recipes are not those its manifest row counts and its root covers is an error."""
        leaves = self.recipes().select("part", "doc_id", "start_in_part", "n_tokens", "leaf")
        return leaves.groupBy("part").cogroup(self.manifest().groupBy("part")).applyInArrow(_part_holds, "part int, n_tokens long")

    def read(self) -> DataFrame:
        """part, doc_id, row_hash, start_in_part, n_tokens and ids (binary), put together from the recipes."""
        row = ["part", "doc_id", "row_hash", "start_in_part", "n_tokens"]
        steps = self.verified_recipes().select(*row, F.posexplode("digests").alias("at", "digest"))
        found = F.coalesce("ids", F.raise_error(F.concat(F.lit("no chunk "), F.hex("digest"))).cast("binary"))
        joined = steps.join(self.chunks(), "digest", "left").select(*row, "at", found.alias("ids")).groupBy(*row)
        parts = joined.agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("x"))
        return parts.select(*row, F.concat_ws("", F.transform("x.ids", F.hex)).alias("x")).select(*row, F.unhex("x").alias("ids"))

    def damaged(self) -> DataFrame:
        """What does not verify: kind (chunk, missing, leaf or part) and its name in hex; no rows for a sound store."""
        kinds = "kind string, name string"
        used = self.recipes().select(F.explode("digests").alias("digest")).distinct()
        missing = used.join(self.chunks().select("digest"), "digest", "left_anti").select(F.lit("missing").alias("kind"), F.lower(F.hex("digest")).alias("name"))
        return missing.union(self.chunks().mapInArrow(_bad_chunks, kinds)).union(self.recipes().mapInArrow(_bad_leaves, kinds)).union(
            self.recipes().select("part", "start_in_part", "doc_id", "leaf").join(self.manifest().select("part", "root"), "part").groupBy("part").applyInArrow(_bad_parts, kinds))


def _bad(kind: str, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind] * len(names), pa.string()), pa.array(names, pa.string())], names=["kind", "name"])


def _bad_chunks(batches):
    for b in batches:
        yield _bad("chunk", [d.hex() for d, x in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True) if digest(x) != d])


def _bad_leaves(batches):
    for b in batches:
        yield _bad("leaf", [x.hex() for d, c, x in zip(b.column("doc_id").to_pylist(), b.column("digests").to_pylist(), b.column("leaf").to_pylist(), strict=True) if leaf(d, c) != x])


def _bad_parts(group: pa.Table) -> pa.Table:
    group, tree = group.sort_by("start_in_part"), Merkle()
    for x in group.column("leaf").to_pylist():
        tree.add(x)
    bad = [] if tree.root() == group.column("root")[0].as_py() else [str(group.column("part")[0].as_py())]
    return pa.Table.from_batches([_bad("part", bad)])


def _leaves_hold(batches):
    for b in batches:
        for d, c, x in zip(b.column("doc_id").to_pylist(), b.column("digests").to_pylist(), b.column("leaf").to_pylist(), strict=True):
            if leaf(d, c) != x:
                raise ValueError(f"the recipe of document {d} is changed")
        yield b


def _part_holds(recipes: pa.Table, manifest: pa.Table) -> pa.Table:
    part = (recipes if recipes.num_rows else manifest).column("part")[0].as_py()
    if manifest.num_rows != 1:
        raise ValueError(f"part {part} has {manifest.num_rows} manifest rows")
    row, recipes, tree = manifest.to_pylist()[0], recipes.sort_by("start_in_part"), Merkle()
    for x in recipes.column("leaf").to_pylist():
        tree.add(x)
    n = recipes.column("n_tokens").to_numpy()
    starts = np.cumsum(n) - n
    if row["n_docs"] != len(n) or row["n_tokens"] != n.sum() or (recipes.column("start_in_part").to_numpy() != starts).any() or tree.root() != row["root"]:
        raise ValueError(f"part {part} is not what its manifest says")
    return pa.table({"part": pa.array([part], pa.int32()), "n_tokens": pa.array([row["n_tokens"]], pa.int64())})


def write_store(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, width: int = 2, path: str | None = None) -> TokenStore:
    """Encode every row of docs, end each with end_id, and write a store.

    Null text counts as empty and is its end id alone; null doc_ids come first; rows are in the order of doc_id,
    then of a hash of their text, and a repeated row is stored as often as it occurs (its chunks once); an
    empty table makes an empty store; a very long text is cut into as many chunks as it takes; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    spool = table(keyed(docs).select("doc_id", "row_hash", "text").mapInArrow(_spool(tokenizer, end_id, width), SPOOL), "spool")
    chunks = spool.select(F.explode("chunks").alias("c")).groupBy("c.digest").agg(F.first("c.ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    ordered = spool.select("doc_id", "row_hash", "n_tokens", "digests").repartitionByRange("doc_id", "row_hash").sortWithinPartitions("doc_id", "row_hash")
    ordered.mapInArrow(_recipes, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    drop_tables(spool)
    store = TokenStore(spark, path, width)
    store.top().coalesce(1).write.parquet(f"{path}/top")
    return store


@cache
def _zeros_table(power: int) -> np.ndarray:
    """4 x 256 table of what 2 ** power zero bytes do to a CRC-32, by its bytes."""
    one = np.array([zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0", 0) for i in range(32)], np.uint32)
    for _ in range(power):
        tab = _tabulated(one)
        one = _advance(one, tab)
    return _tabulated(one)


def _tabulated(columns: np.ndarray) -> np.ndarray:
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return out


def _advance(crc: np.ndarray, tab: np.ndarray) -> np.ndarray:
    return tab[0][crc & 255] ^ tab[1][crc >> 8 & 255] ^ tab[2][crc >> 16 & 255] ^ tab[3][crc >> 24]


def joined_crc(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32 of each document from the CRC-32s and byte sizes of its consecutive parts (counts of them per document)."""
    crcs = crcs.astype(np.uint32)
    ends = np.cumsum(counts)
    total = np.cumsum(sizes)
    behind = np.repeat(total[ends - 1], counts) - total
    for k in range(int(behind.max(initial=0)).bit_length()):
        rows = np.flatnonzero(behind >> k & 1)
        crcs[rows] = _advance(crcs[rows], _zeros_table(k))
    return np.bitwise_xor.reduceat(crcs, ends - counts)


def _measure_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column("digest").to_pylist(), batch.column("ids").to_pylist()
            for d, x in zip(names, data, strict=True):
                if digest(x) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
            wide = data if width == 4 else [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in data]
            yield pa.record_batch([batch.column("digest"), pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x) for x in wide], pa.int64())], names=["digest", "size", "crc"])

    return run


def _document_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("parts")
        counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        if flat.field("size").null_count:
            raise ValueError("a chunk is missing")
        sizes, crcs = flat.field("size").to_numpy(), flat.field("crc").to_numpy()
        n = np.add.reduceat(sizes, np.cumsum(counts) - counts) // 4
        if (n != batch.column("n_tokens").to_numpy()).any():
            raise ValueError("chunks do not add up to their document's ids")
        crc = pa.array(joined_crc(crcs, sizes, counts).astype(np.int64))
        yield pa.record_batch([batch.column("part"), batch.column("doc_id"), batch.column("start_in_part"), pa.array(n), crc], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def checksums(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files, all of which are verified.

    Each chunk file is read, verified against its digest and summed up where it lies; a document's CRC-32 is
    put together from those of its chunks, so that no ids are shuffled. Recipes are held against their leaves, parts
    against their roots and counts, and the parts against the top.
    """
    store.check_top()
    measured = table(store.chunks().mapInArrow(_measure_chunks(store.width), "digest binary, size long, crc long"), "chunk-sums")
    row = ["part", "doc_id", "row_hash", "start_in_part", "n_tokens"]
    steps = store.verified_recipes().select(*row, F.posexplode("digests").alias("at", "digest"))
    joined = steps.join(measured, "digest", "left").groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("at", "size", "crc"))).alias("parts"))
    sums = joined.mapInArrow(_document_crcs, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    # a row a part, in the order of the parts
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = store.verified_parts().select("part", F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0)).alias("before"))
    return sums.join(parts, "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(write_store(documents(spark, sf_dir)))

"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, max_doc), bucketed and sorted by its 128-bit line hash. Each batch of documents
is summed to one row per line and merge-joined with the runs, bucket by bucket. Lines that no run holds (the anti
join) enter with their counts; a known line enters again only while its count decides something or its largest
document grows, so a line known to be common costs later batches nothing. What enters is a run of level 0; a level
that holds ``fanout`` runs is compacted into one run of the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.llm.common import bound, documents, drop_path, keyed, new_path, table

#: The white space that a key loses at both ends.
STRIPPED = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
LINES = "doc_id long, row_hash long, batch int, line int, h1 long, h2 long"
#: Least and most batches, however many lines there are.
BATCHES = (3, 16)


def _hash_lines(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, line, digests = [], [], []
            for row, text in enumerate(batch.column("bytes").to_pylist()):
                for i, raw in enumerate(text.split(b"\n")):
                    if len(raw) < min_chars:
                        continue
                    key = raw.strip(STRIPPED).lower()
                    if len(key) >= 4 * min_chars or (len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars):
                        at.append(row)
                        line.append(i)
                        digests.append(xxhash.xxh3_128_digest(key))
            hashes = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.record_batch(
                [*(batch.column(x).take(rows) for x in ("doc_id", "row_hash", "batch")), pa.array(line, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])],
                names=["doc_id", "row_hash", "batch", "line", "h1", "h2"],
            )

    return lines


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per line of a keyed() table whose stripped, ASCII-lower-cased key has min_chars code points or more; a column ``batch``, where there is one, is kept."""
    batch = F.col("batch") if "batch" in docs.columns else F.lit(0)
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "row_hash", batch.cast("int").alias("batch"), F.col("text").cast("binary").alias("bytes"))
    return source.mapInArrow(_hash_lines(min_chars), LINES)


class LineRuns:
    """Levelled runs in the shared folder. add() takes batches whose documents are disjoint.

    n_docs of a line is exact below ``min_docs``, and at least min_docs from there on; max_doc is exact.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 2):
        self.spark, self.min_docs, self.fanout, self.levels = spark, min_docs, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}

    def _write(self, frame: DataFrame) -> str:
        path = new_path(self.spark, "line-run")
        name = path.rpartition("/")[2].replace("-", "_")
        frame.select(*KEY, "n_docs", "max_doc").write.option("compression", "zstd").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, self.paths.pop(name))

    def add(self, lines: DataFrame) -> None:
        """Sum the batch per line, add what the runs do not know already, and compact full levels."""
        per_doc = lines.select(*KEY, "doc_id").distinct()
        batch = per_doc.groupBy(*KEY).agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        seen = F.lit(0).cast("long")
        last = F.lit(None).cast("long")
        for i, name in enumerate(x for level in self.levels for x in level):
            run = self.spark.table(name).select(*KEY, F.col("n_docs").alias(f"n{i}"), F.col("max_doc").alias(f"m{i}"))
            batch = batch.join(run.hint("merge"), KEY, "left")
            seen, last = seen + F.coalesce(f"n{i}", F.lit(0)), F.greatest(last, F.col(f"m{i}")) if i else F.col("m0")
        fresh, undecided = last.isNull(), seen < self.min_docs
        self.levels[0].append(self._write(batch.where(fresh | undecided | (F.col("max_doc") > last))))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merge(old)))
            self.levels[level] = []
            for name in old:
                self._drop(name)
            level += 1

    def _merge(self, names: list[str]) -> DataFrame:
        """Runs joined bucket by bucket: each line's counts are added up."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            run = self.spark.table(name).select(*KEY, F.col("n_docs").alias("n"), F.col("max_doc").alias("m"))
            both = out.hint("merge").join(run, KEY, "full")
            out = both.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc"))
        return out

    def merged(self) -> DataFrame:
        """One row per line over all runs."""
        return self._merge([x for level in self.levels for x in level])

    def drop(self) -> None:
        for name in [x for level in self.levels for x in level]:
            self._drop(name)
        self.levels = [[]]


def _dealt(rows: DataFrame, batches: int) -> DataFrame:
    """``batch``: equal ranges of doc_id, the largest first, so that the document that keeps a line comes before those that lose it."""
    known = rows.where(F.col("doc_id").isNotNull())
    bounds = known.select(F.col("doc_id").cast("double").alias("d")).stat.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)
    below = F.lit(0)
    for bound in sorted(set(bounds)):
        below = below + (F.col("doc_id") <= F.lit(math.floor(bound))).cast("int")
    return rows.withColumn("batch", F.coalesce(below, F.lit(0)))


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batch_docs: int = 100_000_000, fanout: int = 2, carry: bool = False) -> DataFrame:
    """Drop lines held by min_docs documents or more from all but the largest doc_id that holds them.

    Returns doc_id, row_hash, text (the kept lines joined by a line feed), n_lines and n_dropped, a row per row
    of docs. Null text counts as empty (one empty line); a null doc_id leaves its row as it is and is not
    counted; repeated rows of a doc_id count once and share decisions, and a line that occurs twice in the
    document that keeps it stays twice; texts of any length are worked on whole, a batch of ARROW_BYTES at a
    time; an empty table gives no rows; other columns of docs are ignored, whatever their names; ``carry`` adds
    each row of docs but its text as a struct ``row``, and ``blank``, whether its text was null. A batch has
    about batch_docs documents, within BATCHES batches.
    """
    spark = docs.sparkSession
    rows = keyed(docs, carry=carry)
    batches = min(BATCHES[1], max(BATCHES[0], math.ceil(docs.count() / batch_docs)))
    hashed = table(line_hashes(_dealt(rows, batches), min_chars), "lines", partition_by=("batch",))
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(hashed.where(F.col("batch") == b))
    common = table(runs.merged().where(F.col("n_docs") >= min_docs).select(*KEY, "max_doc"), "common-lines")
    runs.drop()
    gone = hashed.join(common, KEY).where(F.col("doc_id") < F.col("max_doc"))
    gone = gone.groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("gone"))
    joined = rows.join(gone, ["doc_id", "row_hash"], "left")
    places = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = bound(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(places(lines), lambda i: F.element_at(lines, i + 1)), "\n"))
    return joined.select(
        "doc_id",
        "row_hash",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["row", "blank"] if carry else []),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line,
         translate(regexp_replace(string_split(coalesce(text, ''), chr(10))[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
common AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.i, l.line, c.key IS NOT NULL AND l.doc_id < c.max_doc AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

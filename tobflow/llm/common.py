"""Helpers shared by the corpus operators: shared-folder tables and row identity."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes of its estimated content, that an operator broadcasts.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch that tables are written from.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset (a local session), one of our own.

    A session on a cluster that names no such folder is refused: executors would not see ours.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tobflow-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tobflow-{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Python gets Arrow batches of at most ARROW_BYTES, so that very long texts do not add up."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def table(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    with small_batches(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by new_path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables made by table() that no later step reads, so that they do not lie on disk to the end."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if not re.search(r"/tobflow-[\w-]+-[0-9a-f]{32}$", folder):
                raise ValueError(f"{folder} was not made by table()")
            drop_path(df.sparkSession, folder)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it (as a lambda's variable)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *, carry: bool = False) -> DataFrame:
    """doc_id, text (null as empty) and row_hash, which tells rows of one doc_id apart.

    Other columns of docs are left out, so their names cannot clash; ``carry`` keeps all columns but the text as a
    struct ``row``, and whether the text was null as ``blank``. Rows that repeat an identical (doc_id, text) are
    interchangeable and share every decision.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNull().alias("blank")] if carry else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_hash"), *whole)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that are not in gone (doc_id, row_hash as in ``keyed``), null doc_ids included; gone is broadcast only where its counted size allows."""
    gone = table(gone.select("doc_id", "row_hash").distinct(), "gone")
    small = gone.count() * 32 <= BROADCAST_BYTES
    same = [F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), F.xxhash64(F.coalesce(F.col("a.text"), F.lit(""))) == F.col("b.row_hash")]
    return docs.alias("a").join((F.broadcast(gone) if small else gone).alias("b"), same, "left_anti").select(docs.columns)


def training_fold(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, mod 5: 0 marks held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5

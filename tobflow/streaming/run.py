"""Running a bounded stream to its end."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORE = "spark.sql.streaming.stateStore.providerClass"


def scratch(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir; a local session that names none gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tobflow-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@contextmanager
def rocksdb(spark: SparkSession):
    """Within, streams keep their state in RocksDB, which stateful processors need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream appends until it has taken all that is there now, as a Parquet table."""
    spark = stream.sparkSession
    root = scratch(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")

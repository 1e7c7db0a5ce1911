"""A book and trades derived from the events table, so that every operator runs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tobflow.schema import SECOND

#: Study parameters scaled to the density of events.
TICK, BASE, COARSE, WINDOW = 0.5, 60 * SECOND, 600 * SECOND, 6 * 3600 * SECOND
LATENCIES = (0, 60 * SECOND, 300 * SECOND)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, timestamp, local_timestamp and the top of the book after each event."""
    return book_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def streamed_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book as a stream over the events file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return book_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def book_of(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    bid = F.floor(k / 10).cast("double") * 0.5 + 100.0
    step = F.when(F.col("user_id") % 6 == 4, 2).when(F.col("user_id") % 6 == 5, 3).otherwise(1)
    return e.select(
        F.lit("EVT").alias("symbol"),
        F.col("event_id").alias("seq"),
        ts.alias("timestamp"),
        (ts + 3000).alias("local_timestamp"),
        (1 + (F.col("event_id") * 7919) % 1000).cast("double").alias("ask_amount"),
        (bid + 0.5 * step).alias("ask_price"),
        bid.alias("bid_price"),
        F.round(F.col("value") * 100).alias("bid_amount"),
    )


def trades(spark: SparkSession, sf_dir: str, clock: str = "timestamp") -> DataFrame:
    """symbol, day0, seq, timestamp, local_timestamp, side and amount of each event."""
    from tobflow.functions.scalars import day_start

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "signup", "sell").otherwise("unknown")
    return e.select(
        F.lit("EVT").alias("symbol"),
        day_start(ts + (3000 if clock == "local_timestamp" else 0)).alias("day0"),
        F.col("event_id").alias("seq"),
        ts.alias("timestamp"),
        (ts + 3000).alias("local_timestamp"),
        side.alias("side"),
        F.round(F.col("value") * 100).alias("amount"),
    )

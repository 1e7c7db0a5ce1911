"""Streaming forms and the mergeable quality fold against the batch operators."""

from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tobflow.operators import buckets as K
from tobflow.operators import quality
from tobflow.operators import quality_fold as fold
from tobflow.operators.events import event_flow
from tobflow.schema import BOOK_COLUMNS, DAY, SECOND
from tobflow.streaming import dense
from tobflow.streaming import flow as streaming

DAY0 = 19601 * DAY
SCHEMA = "symbol string, day0 long, seq long, timestamp long, local_timestamp long, ask_amount double, ask_price double, bid_price double, bid_amount double"


def rough_book(seed, n=400, day0=DAY0):
    """Late rows, repeated rows, missing values and crossed prices."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(0, 7200 * SECOND, n)) + day0
    late = rng.random(n) < 0.05
    t[late] -= rng.integers(0, 400 * SECOND, late.sum())
    bid = np.round(100 + rng.integers(-3, 4, n) * 0.1, 1)
    rows = pd.DataFrame({"symbol": "X", "day0": day0, "seq": np.arange(n), "timestamp": t, "local_timestamp": t + rng.integers(-500, 5000, n), "ask_amount": rng.integers(1, 4, n).astype(float), "ask_price": np.round(bid + rng.integers(0, 4, n) * 0.1, 1), "bid_price": bid, "bid_amount": rng.integers(1, 4, n).astype(float)})
    rows.loc[rng.random(n) < 0.03, "bid_price"] = np.nan
    same = np.flatnonzero(rng.random(n - 1) < 0.1) + 1
    rows.loc[same, BOOK_COLUMNS] = rows.loc[same - 1, BOOK_COLUMNS].to_numpy()
    rows.loc[5, "ask_price"] = 100.05
    return rows.astype({"timestamp": "int64", "local_timestamp": "int64"})


def frame(spark, rows):
    return spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r) for r in rows.itertuples(index=False)], SCHEMA)


def same_figures(got, want):
    for name, x in want.items():
        if isinstance(x, float):
            assert got[name] == pytest.approx(x, abs=1e-9), name
        else:
            assert got[name] == x, name


def test_chunks_in_any_split_give_the_batch_report(spark):
    for seed in range(3):
        rows = rough_book(seed)
        want = quality.quality_report(frame(spark, rows), 0.1).first().asDict()
        rng = np.random.default_rng(seed)
        for parts in (1, 2, 7, 40):
            cut = np.sort(rng.integers(0, len(rows), parts - 1))
            states = [fold.state_of(c.reset_index(drop=True), 0.1) for c in np.split(rows, cut)]
            same_figures(fold.report(reduce(fold.merge, states)) | {"symbol": "X", "day0": DAY0}, want)
            # merging is associative
            middle = len(states) // 2
            halves = [reduce(fold.merge, h, None) for h in (states[:middle], states[middle:])]
            same_figures(fold.report(fold.merge(*halves)) | {"symbol": "X", "day0": DAY0}, want)


def test_a_late_row_splits_an_earlier_gap():
    rows = rough_book(1, 10).iloc[:4].copy()
    rows["timestamp"] = DAY0 + np.array([0, 100, 40, 130]) * SECOND
    states = [fold.state_of(rows.iloc[k : k + 1].reset_index(drop=True), 0.1) for k in range(4)]
    assert fold.report(reduce(fold.merge, states))["max_gap_s"] == 60.0


def test_fold_on_spark_and_on_a_stream(tmp_path, spark):
    rows = pd.concat([rough_book(7), rough_book(8, 100, DAY0 + DAY)])
    df = frame(spark, rows)
    want = {r.day0: r.asDict() for r in quality.quality_report(df, 0.1).collect()}
    got = fold.merged_report(fold.chunk_states(df.withColumn("chunk", F.floor(F.col("seq") / 30)), 0.1, "chunk"), "chunk")
    for r in got.collect():
        same_figures(r.asDict(), want[r.day0])
    for k in range(0, 400, 100):
        df.where((F.col("seq") >= k) & (F.col("seq") < k + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fold.stream_quality(stream, 0.1).writeStream.format("memory").outputMode("update").queryName("quality").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    for day0, one in want.items():
        last = spark.table("quality").where(F.col("day0") == day0).orderBy(F.desc("rows")).first()
        same_figures(last.asDict(), one)


def test_dense_buckets_of_a_stream(tmp_path, spark):
    """Four hours of two symbols, one silent for three of them; buckets of a minute equal the day grid's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, rows = np.random.default_rng(2), []
    for i, t in enumerate(np.sort(rng.integers(1800, 4 * 3600, 500))):
        symbol = "Y" if t < 5400 and i % 3 == 0 else "X"
        bid = 100 + int(rng.integers(-3, 4)) * 0.5
        rows.append((symbol, DAY0, i, DAY0 + int(t) * SECOND, 0, float(rng.integers(1, 9)), bid + 0.5, bid, float(rng.integers(1, 9))))
    rows.append(("X", DAY0, 500, DAY0 + 5 * 3600 * SECOND, 0, 1.0, 100.5, 100.0, 1.0))
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(0, 501, 100):
        df.where((F.col("seq") >= k) & (F.col("seq") < k + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = dense.dense_buckets(stream, 60 * SECOND, 0.5, "10 minutes").writeStream.format("memory").outputMode("append").queryName("dense").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["symbol", "t", "flow", "dmid_ticks", "depth", "spread_ticks", "n_events", "mid"]
    got = spark.table("dense").select(names).orderBy("symbol", "t").collect()
    end = DAY0 + (5 * 3600 - 600) * SECOND
    want = K.bucketize(df, 60 * SECOND, 0.5).where(F.col("t") < end).select(names).orderBy("symbol", "t").collect()
    assert len(want) == 2 * 290 and [tuple(r) for r in got] == [tuple(r) for r in want]


def test_streaming_matches_batch(tmp_path, spark):
    rng = np.random.default_rng(0)
    n = 60
    bid = 100 + rng.integers(-2, 3, n) * 0.5
    rows = [("XY"[i % 2], i, DAY0 + i * SECOND, float(bid[i]), float(rng.integers(1, 9)), float(bid[i] + 0.5), float(rng.integers(1, 9))) for i in range(n)]
    schema = "symbol string, seq long, timestamp long, bid_price double, bid_amount double, ask_price double, ask_amount double"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where((F.col("seq") >= 20 * k) & (F.col("seq") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_flow(stream).writeStream.format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    # files are taken in the order of their time, which follows that of the batches
    got = {r.seq: r.flow for r in spark.table("flows").collect()}
    want = {r.seq: r.flow for r in event_flow(df, ["symbol"]).collect()}
    assert got == want
    sums = streaming.stream_buckets(spark.table("flows"), "10 seconds", "1 minute").agg(F.sum("n_events")).first()[0]
    assert sums == n


def test_no_task_gets_a_whole_symbol(tmp_path, spark, monkeypatch):
    """Chunks of 16 numbers: flows over chunks' borders, gaps of seq and files that share a chunk equal the batch's, and a group has no more rows."""
    rows = rough_book(3, 200)
    rows["seq"] += np.where(rows["seq"] >= 100, 1000, 0)
    df = frame(spark, rows.assign(symbol=np.where(rows["seq"] % 3 == 0, "Y", "X")))
    for low, high in ((0, 57), (57, 1150), (1150, 1200)):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    most = 16

    def bounded(f):
        def run(key, rows):
            assert len(rows) <= most, len(rows)
            return f(key, rows)

        return run

    for name in ("_inner_flows", "_border"):
        monkeypatch.setattr(streaming, name, bounded(getattr(streaming, name)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_flow(stream, bits=4).writeStream.format("memory").queryName("chunked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    order = ["symbol", "seq"]
    got = [tuple(r) for r in spark.table("chunked").select("symbol", "seq", "timestamp", "flow").orderBy(order).collect()]
    want = [tuple(r) for r in event_flow(df, ["symbol"]).select("symbol", "seq", "timestamp", "flow").orderBy(order).collect()]
    assert len(got) == 200 and repr(got) == repr(want)


def test_dense_buckets_from_chunks(tmp_path, spark, monkeypatch):
    """Chunks of 16 numbers of a rough book, with times out of order, in three files: the day grid's buckets, and no group of rows above 16."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = rough_book(4, 300)
    end = rows.iloc[-1:].assign(seq=2000, timestamp=DAY0 + 4 * 3600 * SECOND)
    df = frame(spark, pd.concat([rows, end]))
    for low, high in ((0, 90), (90, 203), (203, 2001)):
        df.where((F.col("seq") >= low) & (F.col("seq") < high)).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = dense._parts

    def bounded(freq_us):
        sums = whole(freq_us)

        def run(key, rows):
            assert len(rows) <= 16, len(rows)
            return sums(key, rows)

        return run

    monkeypatch.setattr(dense, "_parts", bounded)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = dense.dense_buckets(stream, 30 * SECOND, 0.1, "10 minutes", bits=4).writeStream.format("memory").outputMode("append").queryName("chunks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["symbol", "t", "flow", "dmid_ticks", "depth", "spread_ticks", "n_events", "mid"]
    got = spark.table("chunks").select(names).orderBy("symbol", "t").collect()
    want = K.bucketize(df, 30 * SECOND, 0.1).where(F.col("t") < DAY0 + (4 * 3600 - 600) * SECOND).select(names).orderBy("symbol", "t").collect()
    assert len(want) == 460 and [tuple(r) for r in got] == [tuple(r) for r in want]

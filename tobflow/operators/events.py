"""Order-flow contribution of each book update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tobflow.functions import scalars as S
from tobflow.operators.percentiles import counted, percentiles
from tobflow.schema import DAY, STREAM


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null, which is how all operators mark a missing value."""
    floats = {c for c, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def with_days(book: DataFrame, clock: str = "timestamp") -> DataFrame:
    """Adds day0 (UTC midnight of each row) to a continuous stream, and to each day the last row of the day just before it.

    A day whose day before has no rows starts from nothing: an older state says nothing of its start.
    That row belongs to its day's stream, with a negative bucket: it is the state the day starts from. So streams
    of (symbol, day0) can be worked on apart from each other.
    """
    days = book.withColumn("day0", S.day_start(F.col(clock)))
    rest = [c for c in book.columns if c != "symbol"]
    last = days.groupBy(*STREAM).agg(F.max_by(F.struct(*rest), "seq").alias("row"))
    carried = last.withColumn("day0", F.col("day0") + DAY).join(last.select(*STREAM), STREAM, "left_semi")
    return days.unionByName(carried.select("symbol", "day0", *[F.col(f"row.{c}").alias(c) for c in rest]))


def with_median_day(book: DataFrame, by: list[str], clock: str = "timestamp") -> DataFrame:
    """Adds day0, the UTC midnight before the median time of each group (a file, say): rows before midnight stay with their file's day.

    The median is exact, from counted times; a group without times has no day.
    """
    middle = percentiles(counted(book, by, clock), by, {"_middle": 0.5})
    return book.join(middle.select(*by, S.day_start(F.col("_middle")).alias("day0")), by, "left")


def _side(price: Column, before: Column, size: Column, size_before: Column, better) -> Column:
    """A side's addition: the size now if the price is as good or better, less the size before if as good or worse."""
    gained = F.when(better(price, before), size).otherwise(0.0)
    lost = F.when(better(before, price), size_before).otherwise(0.0)
    return gained - lost


def event_flow(book: DataFrame, keys: list[str] = STREAM) -> DataFrame:
    """Adds flow: buying pressure of each update against the row before it in the order of seq.

    The first row of a stream has none, nor has a row where a size, now or before, is missing; a missing price
    only silences its side.
    """
    before = Window.partitionBy(*keys).orderBy("seq")
    sizes = ["bid_amount", "ask_amount"]
    was = {c: F.lag(c).over(before) for c in ("bid_price", "ask_price", *sizes)}
    first = F.row_number().over(before) == 1
    work = book.select("*", first.alias("_first"), *[w.alias(f"_{c}") for c, w in was.items()])
    bid = _side(F.col("bid_price"), F.col("_bid_price"), F.col("bid_amount"), F.col("_bid_amount"), lambda a, b: a >= b)
    ask = _side(F.col("ask_price"), F.col("_ask_price"), F.col("ask_amount"), F.col("_ask_amount"), lambda a, b: a <= b)
    known = ~F.col("_first")
    for c in sizes:
        known = known & F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
    return work.withColumn("flow", F.when(known, bid - ask)).drop("_first", *[f"_{c}" for c in was])

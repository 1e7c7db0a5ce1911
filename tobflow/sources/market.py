"""Reading market files and derived tables, and fetching files."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tobflow.config import check_date
from tobflow.functions import scalars as S
from tobflow.operators.events import nan_to_null
from tobflow.schema import BOOK_COLUMNS, BOOK_FILE, TRADE_COLUMNS, TRADES_FILE, WINDOWS

ATTEMPTS, TIMEOUT_S = 4, 60
#: The day a file is for, in its name.
_DATE = r"(\d{4}-\d{2}-\d{2})"


def _read(spark: SparkSession, paths: list[str], schema: str, columns: list[str]) -> DataFrame:
    """Files of the schema's columns in that order (a different header fails), with symbol, day0 and seq.

    A compressed file is one partition, so the row numbers of its partition follow the file's order.
    """
    for p in paths:
        if found := re.search(_DATE, Path(p).name):
            check_date(found[1])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)
    day = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), _DATE, 1)
    day0 = F.unix_micros(F.to_timestamp(F.when(day != "", day)))
    return nan_to_null(rows.select("symbol", day0.alias("day0"), F.monotonically_increasing_id().alias("seq"), *columns))


def read_book(spark: SparkSession, *paths: str) -> DataFrame:
    return _read(spark, list(paths), BOOK_FILE, BOOK_COLUMNS)


def read_trades(spark: SparkSession, *paths: str) -> DataFrame:
    return _read(spark, list(paths), TRADES_FILE, TRADE_COLUMNS)


def read_days(spark: SparkSession, root: str, symbol: str, days: Iterable[str]) -> DataFrame:
    """Rows of a table partitioned by symbol and day; missing days are an error that names them."""
    wanted = [check_date(d) for d in days]
    rows = spark.read.parquet(root).where((F.col("symbol") == symbol) & F.col("day").cast("string").isin(wanted))
    missing = missing_days(spark, rows, wanted)
    if missing:
        raise FileNotFoundError(f"{root} has no {symbol} for {', '.join(missing)}")
    return rows


def missing_days(spark: SparkSession, rows: DataFrame, days: list[str]) -> list[str]:
    wanted = spark.createDataFrame([(d,) for d in days], "day string")
    have = rows.select(F.col("day").cast("string").alias("day")).distinct()
    return sorted(r.day for r in wanted.join(have, "day", "left_anti").collect())


def committed(spark: SparkSession, root: str) -> set[tuple[str, str]]:
    """(symbol, day) of every day that a table partitioned by them holds: a listing, nothing is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/symbol=*/day=*/*.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    folders = [f.getPath().getParent() for f in found or []]
    return {(f.getParent().getName().removeprefix("symbol="), f.getName().removeprefix("day=")) for f in folders}


def pending(spark: SparkSession, root: str, wanted: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The wanted (symbol, day) that the table does not hold."""
    have = committed(spark, root)
    return [w for w in wanted if w not in have]


def write_days(rows: DataFrame, root: str) -> None:
    """Append rows (symbol, day0, t, ...) by symbol and day. A day is one file of one job, so it is there as a whole or not at all."""
    dated = rows.withColumn("day", S.iso_day(F.col("day0")))
    dated.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "t").write.mode("append").partitionBy("symbol", "day").parquet(root)


def write_windows(panel: DataFrame, path: str) -> None:
    """A panel of one symbol as a window table, in the order of its windows."""
    names = StructType.fromDDL(WINDOWS).names
    panel.select(*names).orderBy("window").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """A window table as write_windows makes it."""
    return spark.read.schema(WINDOWS).option("header", True).option("enforceSchema", False).csv(path)


def first_days(ranges: DataFrame) -> DataFrame:
    """day: the first of every month in each closed range (start, end: dates)."""
    months = F.explode(F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("INTERVAL 1 MONTH")))
    return ranges.select("start", months.alias("day")).where(F.col("day") >= F.col("start")).select(F.col("day").cast("string").alias("day"))


def download(url: str, path: Path, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> Path:
    """Fetch a file unless it is there. Retries lost connections and short bodies; HTTP errors are raised at once."""
    if path.exists():
        return path
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with opener(url, timeout=TIMEOUT_S) as response, part.open("wb") as out:
                size = response.headers.get("Content-Length")
                while block := response.read(1 << 20):
                    out.write(block)
            if size is not None and part.stat().st_size != int(size):
                raise ConnectionError(f"{url}: {part.stat().st_size} of {size} bytes")
            part.rename(path)
            return path
        except urllib.error.HTTPError:
            part.unlink(missing_ok=True)
            raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            part.unlink(missing_ok=True)
            if attempt == ATTEMPTS:
                raise
            sleep(2.0**attempt)
    return path


def listing(url: str, pattern: str, opener: Callable = urllib.request.urlopen) -> list[str]:
    """What pattern's group matches in all pages of an object store's XML listing."""
    out, marker = [], ""
    while True:
        with opener(f"{url}&marker={marker}", timeout=TIMEOUT_S) as response:
            xml = response.read().decode()
        out += re.findall(pattern, xml)
        following = re.search(r"<NextMarker>([^<]+)</NextMarker>", xml)
        if "<IsTruncated>true</IsTruncated>" not in xml or not following:
            return out
        marker = following[1]


def quote_volume(lines: DataFrame) -> DataFrame:
    """symbol and quote_volume (the eighth field) of daily candle lines (symbol, line); header lines are left out."""
    volume = F.try_element_at(F.split("line", ","), F.lit(8)).try_cast("double")
    return lines.where(~F.col("line").startswith("open_time")).select("symbol", volume.alias("quote_volume"))

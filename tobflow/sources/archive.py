"""Fetching raw files as a Python data source: one partition a file, so executors fetch them side by side.

Files go to the raw folder, which all executors share. A file that is there is not fetched again.
"""

from __future__ import annotations

import json
import os
import urllib.error
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tobflow.config import Paths, check_date
from tobflow.sources.market import download

#: The public archives' addresses of a book or trades file, of the listing of symbols and of daily candles.
FILE_URL = "https://datasets.tardis.dev/v1/binance-futures/{dataset}/{y}/{m}/{d}/{symbol}.csv.gz"
LISTING_URL = "https://s3-ap-northeast-1.amazonaws.com/data.binance.vision?delimiter=/&prefix=data/futures/um/daily/klines/"
LISTED = r"<Prefix>data/futures/um/daily/klines/([^/<]+)/</Prefix>"
CANDLE_URL = "https://data.binance.vision/data/futures/um/daily/klines/{symbol}/1d/{symbol}-1d-{y}-{m}-{d}.zip"
FETCHED = "dataset string, symbol string, day string, path string, status string"


def address(name: str, default: str) -> str:
    """An address, or what TOBFLOW_<name>_URL puts in its place."""
    return os.environ.get(f"TOBFLOW_{name}_URL", default)


class File(InputPartition):
    def __init__(self, dataset: str, symbol: str, day: str, url: str, path: str):
        self.dataset, self.symbol, self.day, self.url, self.path = dataset, symbol, day, url, path


class ArchiveReader(DataSourceReader):
    def __init__(self, files: list[list[str]]):
        self.files = files

    def partitions(self) -> list[File]:
        return [File(*f) for f in self.files]

    def read(self, partition: File) -> Iterator[tuple]:
        path, status = Path(partition.path), "present"
        if not path.exists():
            try:
                download(partition.url, path)
                status = "fetched"
            except urllib.error.HTTPError as e:
                if e.code != 404:
                    raise
                status = "missing"
        yield partition.dataset, partition.symbol, partition.day, partition.path, status


class ArchiveSource(DataSource):
    """Format market_archive; option files is a JSON list of [dataset, symbol, day, url, path]."""

    @classmethod
    def name(cls) -> str:
        return "market_archive"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(json.loads(self.options["files"]))


def fetch(spark: SparkSession, wanted: list[tuple[str, str, str]], paths: Paths, url: str | None = None, suffix: str = ".csv.gz") -> list[Row]:
    """Fetch each (dataset, symbol, day) unless it is there; rows of dataset, symbol, day, path and status.

    status is present, fetched or missing (not in the archive, which is reported and not made up for). A held-out day
    is refused before anything is asked for.
    """
    template, files = url or address("ARCHIVE", FILE_URL), []
    for dataset, symbol, day in wanted:
        y, m, d = check_date(day).split("-")
        path = paths.raw(dataset, symbol, day)
        files.append([dataset, symbol, day, template.format(dataset=dataset, symbol=symbol, y=y, m=m, d=d), str(path.with_name(f"{day}{suffix}"))])
    if not files:
        return []
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("market_archive").option("files", json.dumps(files)).load().collect()


def candles(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """symbol and line of every line in zipped candle files, given as (symbol, path)."""
    from tobflow.sources.unzip import members

    named = spark.createDataFrame([(s, p) for s, p in files], "symbol string, file string")
    read = spark.read.format("binaryFile").load([p for _, p in files]).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content")
    return members(named.join(read, "file"))

"""Members of zip files as rows of lines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LINES = "symbol string, member string, line string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for symbol, content in zip(batch.column("symbol").to_pylist(), batch.column("content"), strict=True):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                for member in archive.namelist():
                    lines = archive.read(member).decode().splitlines()
                    columns = [pa.array([symbol] * len(lines), pa.string()), pa.array([member] * len(lines), pa.string()), pa.array(lines, pa.string())]
                    yield pa.record_batch(columns, names=["symbol", "member", "line"])


def members(files: DataFrame) -> DataFrame:
    """symbol, member and line of every member of zip files (symbol, content), a file at a time within its task."""
    return files.select("symbol", "content").mapInArrow(_lines, LINES)

"""The append-only table of trials."""

from __future__ import annotations

import datetime as dt
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tobflow.schema import LEDGER


def columns() -> list[str]:
    return StructType.fromDDL(LEDGER).names


def git_sha() -> str:
    out = subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=False)
    return out.stdout.strip() if out.returncode == 0 else "unknown"


def log_trials(spark: SparkSession, path: str, *trials: dict) -> None:
    """Append one row per trial, stamped with the UTC second and the commit; a field that is no column is a KeyError."""
    stamp = {"run_utc": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "git_sha": git_sha()}
    for t in trials:
        if unknown := set(t) - set(columns()):
            raise KeyError(f"not in the ledger: {sorted(unknown)}")
    rows = [[{**stamp, **t}.get(c) for c in columns()] for t in trials]
    rows = [[None if v is None else str(v) for v in r] for r in rows]
    spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("header", True).option("enforceSchema", False).csv(path)

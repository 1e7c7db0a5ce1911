"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that casts of timestamps are epoch arithmetic; ANSI, so that overflow and bad casts raise.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def session(name: str = "tobflow", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

"""Spark sessions with the settings that exact convergence needs."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI makes overflow an error and prints decimals plainly; ticks never pass through a timezone.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
}


def session(name: str = "tributary", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return exact(builder.getOrCreate())


def exact(spark: SparkSession) -> SparkSession:
    """The session with the settings above; sizes and parallelism are left as they are."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark

"""Caches of parsed documents and results as Parquet tables keyed by digest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def not_cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return rows.join(cache.select(key).distinct(), key, "left_anti")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache table; one that is not there or cannot be read is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_cache(rows: DataFrame, path: str, key: str, degraded: str | None = "degraded") -> None:
    """Appends results, dealt by the first digits of the key; degraded ones are not cached."""
    if degraded and degraded in rows.columns:
        rows = rows.filter(~F.coalesce(F.col(degraded), F.lit(False)))
    rows.withColumn("prefix", F.substring(key, 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)

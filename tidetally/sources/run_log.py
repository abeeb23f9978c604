"""Append-only log of finished runs; the latest entry of a key counts."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.schema import LAST_UPDATE, RUN_LOG
from tidetally.sources.store import read_or_none


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    log = read_or_none(spark, path, RUN_LOG)
    return spark.createDataFrame([], RUN_LOG) if log is None else log


def latest_value(log: DataFrame, key: str = LAST_UPDATE) -> DataFrame:
    """One row with the key's latest value, NULL if it was never written."""
    return log.where(F.col("key") == key).agg(F.max_by("value", "updated_at").alias("value"))


def scan_metadata(log: DataFrame) -> DataFrame:
    """When the data was last refreshed, NULL if never; an unreadable time counts as never."""
    return latest_value(log).select(
        F.try_to_timestamp(F.col("value")).alias(LAST_UPDATE)
    )


def sink_metadata(
    spark: SparkSession, path: str, at: datetime, key: str = LAST_UPDATE, value: str | None = None
) -> None:
    """Appends an entry; times are written in UTC, so their texts sort as times do."""
    stamp = at.astimezone(timezone.utc).isoformat()
    row = (key, stamp if value is None else value, stamp)
    spark.createDataFrame([row], RUN_LOG).coalesce(1).write.mode("append").parquet(path)

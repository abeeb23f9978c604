"""Running totals over groups of any size."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(count: int) -> int:
    """Number of buckets for ``count`` rows: no window then holds over about its root."""
    return max(1, round(count**0.5))


def running_total(
    rows: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str | Column],
    value: str,
    name: str,
) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the same group.

    Rows are ordered by ``bucket`` and then by ``order``. A group may hold a
    third of all rows, so no window holds a whole one: sums run within the
    buckets, and a small table of bucket sums gives each bucket its start.
    Group columns must not be null. ``rows`` is read twice: pass a stored table.
    """
    in_group = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = (
        Window.partitionBy(*group, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*group, bucket)
        .agg(F.sum(value).alias("bucket_sum"))
        .select(
            *group, bucket, F.coalesce(F.sum("bucket_sum").over(in_group), F.lit(0)).alias("bucket_start")
        )
    )
    return (
        rows.withColumn(name, F.coalesce(F.sum(value).over(in_bucket), F.lit(0)))
        .join(starts, [*group, bucket])
        .withColumn(name, F.col(name) + F.col("bucket_start"))
        .drop("bucket_start")
    )

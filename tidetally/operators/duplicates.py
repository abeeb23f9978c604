"""Repeated keys within one landed file."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.operators.ingest import same_key, seq_in_batch
from tidetally.operators.skew import HOT_ROWS
from tidetally.schema import KEY


def inspect_duplicates(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every repeat of a key against the key's first row in the same batch.

    NULL key parts match here. The first rows are an aggregate; only those of
    keys that repeat are joined back.
    """
    key = ["batch_no", *KEY]
    rows = seq_in_batch(records, hot_rows).select(*key, "row", "data_hash")
    firsts = (
        rows.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("row").alias("first_row"),
            F.min_by("data_hash", "row").alias("first_hash"),
        )
        .where("n > 1")
        .select(*[F.col(name).alias(f"first_{name}") for name in key], "first_row", "first_hash")
    )
    same = reduce(and_, [same_key(name, f"first_{name}", True) for name in key])
    return rows.join(firsts, same & (F.col("row") > F.col("first_row"))).select(
        *key,
        "row",
        "first_row",
        "first_hash",
        F.col("data_hash").alias("current_hash"),
        (F.col("data_hash") == F.col("first_hash")).alias("same_data"),
    )


def duplicate_summary(repeats: DataFrame) -> DataFrame:
    """How many repeats are exact and how many conflict."""
    return repeats.groupBy("batch_no").agg(
        F.count(F.when(F.col("same_data"), 1)).alias("exact"),
        F.count(F.when(~F.col("same_data"), 1)).alias("conflicting"),
    )


def first_duplicates(repeats: DataFrame, n: int = 5) -> DataFrame:
    """The first repeats of each kind in file order, with the number left out."""
    area = F.when(F.col("catch_area") == "", "N/A").otherwise(F.col("catch_area"))
    kinds = []
    for same in (True, False):
        kind = repeats.where(F.col("same_data") == F.lit(same))
        more = kind.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more")).scalar()
        kinds.append(
            kind.orderBy("batch_no", "row")
            .limit(n)
            .select(
                "same_data",
                "batch_no",
                "row",
                "first_row",
                "sample_date",
                "ramp_site",
                area.alias("catch_area"),
            )
            .withColumn("more", more)
        )
    return kinds[0].unionByName(kinds[1])

"""A rollup from which any dashboard page can be made without the records.

Counts and sums by date text, area and which species are NULL. The last is what
totals over several species need: they leave out records with a NULL among the
species asked for, so a row of the rollup counts for a total as a whole or not at all.
"""

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.measures import species_sums
from tidetally.operators.filters import FilterSpec, filtered_records
from tidetally.schema import SALMON, SPECIES


def _null_mask() -> Column:
    """A bit for each species that is NULL."""
    bits = [F.when(F.col(name).isNull(), 1 << at).otherwise(0) for at, name in enumerate(SPECIES)]
    return reduce(add, bits)


def rollup(records: DataFrame) -> DataFrame:
    """One row for each (survey year, date text, area, species that are NULL)."""
    return records.groupBy(
        "survey_year", "sample_date", "catch_area", _null_mask().alias("nulls")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("anglers").alias("anglers"), *species_sums(SPECIES))


def total_of(names: Sequence[str]) -> Column:
    """Sum of the species over records that have them all; NULL without any."""
    asked = sum(1 << SPECIES.index(name) for name in set(names))
    complete = F.col("nulls").bitwiseAND(F.lit(asked)) == 0
    return F.sum(F.when(complete, reduce(add, [F.col(name) for name in names])))


def page_fold_of(rolled: DataFrame, spec: FilterSpec) -> DataFrame:
    """What ``dashboard.page_fold`` makes of the records, from their rollup."""
    wanted = list(dict.fromkeys([*SALMON, *spec.species_names]))
    return (
        filtered_records(rolled, spec)
        .groupBy("sample_date", "catch_area")
        .agg(
            F.sum("n").alias("n"),
            F.sum("anglers").alias("anglers"),
            *species_sums(wanted),
            total_of(spec.species_names).alias("total"),
        )
    )

"""Catch measures and rounding rules."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def species_sum(species: list[str]) -> Column:
    """Catch of a row over the species; NULL as soon as one of them is NULL."""
    return reduce(add, [F.col(name) for name in species])


def species_sums(species: list[str]) -> list[Column]:
    return [F.sum(name).alias(name) for name in species]


def coalesce_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def round_half_even(value: Column) -> Column:
    """Rounding of the headline figures."""
    return F.bround(value, 0).cast("bigint")


def round_half_up(value: Column) -> Column:
    """Rounding of the chart figures: halves go up, also below zero."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def intensity(total: Column, max_total: Column) -> Column:
    """Share of the largest area total, 0 to 1."""
    return F.least(total / F.greatest(max_total, F.lit(1.0)), F.lit(1.0))


def fill_opacity(share: Column) -> Column:
    return F.lit(0.3) + share * F.lit(0.5)

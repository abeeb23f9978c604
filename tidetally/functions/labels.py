"""Texts for axes, pop-ups and tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidetally.functions.measures import round_half_up
from tidetally.schema import MONTHS

AREA_NUMBER = r"^Area\s+(\d+),"


def area_number(area: Column) -> Column:
    """``4`` of ``Area 4, East``; ``''`` for names of another form."""
    return F.regexp_extract(area, AREA_NUMBER, 1)


def area_label(area: Column) -> Column:
    return F.when(
        F.length(area) > 30, F.concat(F.substring(area, 1, 30), F.lit("..."))
    ).otherwise(area)


def species_label(species: Column) -> Column:
    return F.initcap(species)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int"))


def display_name(area: Column, ma_name: Column, ma_number: Column) -> Column:
    """The matched area, else the polygon's own name and number."""
    own = F.concat(ma_name, F.lit(" (Area "), ma_number, F.lit(")"))
    return F.coalesce(area, own)


def format_count(value: Column) -> Column:
    """Rounded, with thousands separators."""
    return F.format_number(round_half_up(value), 0)

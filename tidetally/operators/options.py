"""Values a filter can take."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.functions.dates import year_of
from tidetally.operators.filters import filter_area_present, filter_date_present


def filter_options_years(df: DataFrame) -> DataFrame:
    """Distinct years, ascending; distinct dates first, so the year is cut out once per date."""
    dates = filter_date_present(df).select("sample_date").distinct()
    return dates.select(year_of(F.col("sample_date")).alias("year")).distinct().orderBy("year")


def filter_options_areas(df: DataFrame) -> DataFrame:
    return filter_area_present(df).select("catch_area").distinct().orderBy("catch_area")


def filter_options(df: DataFrame) -> DataFrame:
    """Both lists in one row, one scan: what a filter form loads.

    The arrays hold distinct years and areas only; partial sets are folded on
    the map side. Use the two row forms where the area column is not clean.
    """
    pairs = df.select("sample_date", "catch_area").distinct()
    year = F.when(F.length("sample_date") > 0, year_of(F.col("sample_date")))
    area = F.when(F.col("catch_area") != "", F.col("catch_area"))
    return pairs.agg(
        F.sort_array(F.collect_set(year)).alias("years"),
        F.sort_array(F.collect_set(area)).alias("areas"),
    )

"""The coloured map: polygons with the totals of their areas."""

from pyspark.sql import DataFrame

from tidetally.operators.aggregates import map_data
from tidetally.operators.areas import canonical_areas, choropleth
from tidetally.operators.filters import FilterSpec
from tidetally.operators.options import filter_options_areas
from tidetally.session import keep


def map_page(
    df: DataFrame, features: DataFrame, customs: DataFrame, spec: FilterSpec | None = None
) -> DataFrame:
    """One row per polygon under the filter; the areas filtered for are the selected ones.

    Totals and canonical names have one row per area and are matched several
    ways, so both are kept. The names come from all records, filtered or not.
    """
    spec = spec or FilterSpec()
    totals = keep(map_data(df, spec), "totals")
    canonical = keep(canonical_areas(filter_options_areas(df)), "canonical")
    return choropleth(features, customs, totals, canonical, spec.catch_area)

"""Report after a load: effort, records by year, busiest areas, changed records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.operators.aggregates import (
    effort_totals,
    records_by_year,
    top_areas_by_records,
    updated_count,
)


def collection_report(store: DataFrame) -> dict[str, DataFrame]:
    return {
        "effort": effort_totals(store),
        "by_year": records_by_year(store),
        "top_areas": top_areas_by_records(store),
        "updated": updated_count(store),
    }


def report_long(store: DataFrame) -> DataFrame:
    """The report as one frame: section, key, value."""
    parts = collection_report(store)
    effort = parts["effort"].unpivot([], ["total_anglers", "total_interviews"], "key", "value")
    return (
        effort.select(F.lit("effort").alias("section"), "key", "value")
        .union(parts["by_year"].select(F.lit("by_year"), "year", "records"))
        .union(parts["top_areas"].select(F.lit("top_areas"), "catch_area", "records"))
        .union(parts["updated"].select(F.lit("updated"), F.lit("records"), "updated"))
    )

"""Query results reshaped for charts and look-ups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.dates import week_label
from tidetally.functions.labels import area_label, month_name, species_label
from tidetally.functions.measures import coalesce_zero, round_half_up
from tidetally.schema import SPECIES


def trend_series(trend: DataFrame, species: Sequence[str], time_unit: str = "yearly") -> DataFrame:
    """One row per period and species, rounded, NULL as 0."""
    period = F.col("period")
    label = week_label(period) if time_unit == "weekly" else period
    return trend.unpivot("period", list(species), "species", "value").select(
        "period",
        label.alias("label"),
        species_label(F.col("species")).alias("series"),
        round_half_up(coalesce_zero(F.col("value"))).alias("value"),
    )


def species_series(totals: DataFrame) -> DataFrame:
    """Seven slices in fixed order; species that were not asked for are NULL."""
    slices = [
        F.struct(
            F.lit(place).alias("place"),
            species_label(F.lit(name)).alias("label"),
            (round_half_up(F.col(name)) if name in totals.columns else F.lit(None))
            .cast("bigint")
            .alias("value"),
        )
        for place, name in enumerate(SPECIES, 1)
    ]
    return totals.select(F.explode(F.array(*slices)).alias("slice")).select("slice.*")


def area_series(areas: DataFrame) -> DataFrame:
    return areas.select(
        area_label(F.col("area")).alias("label"), round_half_up(F.col("total")).alias("value")
    )


def monthly_series(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        "month",
        month_name(F.col("month")).alias("label"),
        round_half_up(F.col("total")).alias("value"),
    )


def area_entry() -> Column:
    return F.struct("total", "surveys")


def area_lookup(map_data: DataFrame) -> DataFrame:
    """Area to its figures, as one keyed row per area: the side polygons are joined to."""
    return map_data.select("area", area_entry().alias("figures"))


def result_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text, NULLs kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))

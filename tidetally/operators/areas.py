"""Map polygons and the area totals that colour them.

Polygons and totals are both small next to the records (one row per area), but
neither size is fixed, so no side is forced into a broadcast: the joins are
plain equi-joins and the planner picks by measured size.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.labels import area_number, display_name
from tidetally.functions.measures import coalesce_zero, fill_opacity, intensity
from tidetally.schema import MULTI_POLYGON, POLYGON


def canonical_areas(areas: DataFrame) -> DataFrame:
    """Area number to area name over all areas; the last name in order wins."""
    numbered = areas.select(area_number(F.col("catch_area")).alias("number"), "catch_area")
    return (
        numbered.where("number <> ''")
        .groupBy("number")
        .agg(F.max("catch_area").alias("canonical_area"))
    )


def _filled(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")) != ""


def area_match(features: DataFrame, totals: DataFrame, canonical: DataFrame) -> DataFrame:
    """Finds the area of each marine polygon, with its total and record count.

    In this order: the polygon's name is an area of the totals; an area of the
    totals starts with ``Area <number>,`` (the first in order); the canonical
    area of the number; a name built from number and name. The last two find a
    name only, so their figures stay 0.
    """
    exact = totals.select(
        F.col("area").alias("ma_name"),
        F.col("area").alias("exact_area"),
        F.struct("total", "surveys").alias("exact"),
    )
    prefixed = (
        totals.where(F.instr("area", ",") > 0)
        .groupBy(F.substring_index("area", ",", 1).alias("prefix"))
        .agg(
            F.min("area").alias("prefix_area"),
            F.min_by(F.struct("total", "surveys"), "area").alias("prefixed"),
        )
    )
    built = F.concat(F.lit("Area "), F.col("ma_number"), F.lit(", "), F.col("ma_name"))
    found = F.coalesce("exact", "prefixed")
    return (
        features.join(exact, "ma_name", "left")
        .withColumn("prefix", F.concat(F.lit("Area "), F.col("ma_number")))
        .join(prefixed, "prefix", "left")
        .join(canonical.withColumnRenamed("number", "ma_number"), "ma_number", "left")
        .select(
            *features.columns,
            F.coalesce(
                F.col("exact_area"),
                F.col("prefix_area"),
                F.when(_filled("ma_number"), F.col("canonical_area")),
                F.when(_filled("ma_number") & _filled("ma_name"), built),
            ).alias("area"),
            coalesce_zero(found["total"]).alias("total"),
            coalesce_zero(found["surveys"]).alias("surveys"),
        )
    )


def custom_area_match(customs: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of the polygons that carry an area's exact name; 0 without one."""
    return (
        customs.join(totals.withColumnRenamed("area", "name"), "name", "left")
        .select(
            *customs.columns,
            coalesce_zero(F.col("total")).alias("total"),
            coalesce_zero(F.col("surveys")).alias("surveys"),
        )
    )


def selected_flag(area: Column, selected: Sequence[str]) -> Column:
    """Whether the area is among the areas picked in the filter."""
    if not selected:
        return F.lit(False)
    return F.coalesce(area.isin(list(selected)), F.lit(False))


def max_area_total(totals: DataFrame) -> DataFrame:
    """Divisor of the intensity: the largest total, at least 1."""
    largest = F.coalesce(F.max("total").cast("double"), F.lit(1.0))
    return totals.agg(F.greatest(largest, F.lit(1.0)).alias("max_total"))


def with_intensity(matched: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds intensity and opacity against the largest total (one value, a scalar subquery)."""
    share = intensity(F.col("total"), max_area_total(totals).scalar())
    return matched.withColumn("intensity", share).withColumn(
        "fill_opacity", fill_opacity(F.col("intensity"))
    )


def choropleth(
    features: DataFrame,
    customs: DataFrame,
    totals: DataFrame,
    canonical: DataFrame,
    selected: Sequence[str] = (),
) -> DataFrame:
    """One row per polygon: where it belongs, how dark it is, what its pop-up says."""
    text = F.lit(None).cast("string")
    marine = area_match(features, totals, canonical).select(
        F.lit(False).alias("custom"),
        "ma_number",
        "ma_name",
        "wac",
        "area",
        display_name(F.col("area"), F.col("ma_name"), F.col("ma_number")).alias("display_name"),
        "total",
        "surveys",
        "geometry",
    )
    own = custom_area_match(customs, totals).select(
        F.lit(True).alias("custom"),
        text.alias("ma_number"),
        text.alias("ma_name"),
        text.alias("wac"),
        F.col("name").alias("area"),
        F.col("name").alias("display_name"),
        "total",
        "surveys",
        "geometry",
    )
    return with_intensity(marine.unionByName(own), totals).withColumn(
        "selected", selected_flag(F.col("area"), selected)
    )


def _rings(geometry: str = "geometry") -> Column:
    """Polygons of rings of vertices; a Polygon is read as a MultiPolygon of one."""
    polygon = F.from_json(geometry, POLYGON)
    multi = F.from_json(geometry, MULTI_POLYGON)
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Polygon", F.array(polygon["coordinates"])).when(
        kind == "MultiPolygon", multi["coordinates"]
    )


def explode_vertices(features: DataFrame) -> DataFrame:
    """One row per vertex."""
    others = [name for name in features.columns if name != "geometry"]
    return features.select(
        *others, F.explode(F.flatten(F.flatten(_rings()))).alias("vertex")
    ).select(*others, F.col("vertex")[0].alias("lon"), F.col("vertex")[1].alias("lat"))


def map_extent(features: DataFrame) -> DataFrame:
    """Bounding box of the features, one row; NULLs without any vertex.

    A feature is folded to its own box inside its row, so vertices never become rows.
    """
    vertices = features.select(F.flatten(F.flatten(_rings())).alias("vertices"))
    boxes = vertices.select(
        F.transform("vertices", lambda v: v[0]).alias("lon"),
        F.transform("vertices", lambda v: v[1]).alias("lat"),
    )
    return boxes.agg(
        F.min(F.array_min("lon")).alias("min_lon"),
        F.min(F.array_min("lat")).alias("min_lat"),
        F.max(F.array_max("lon")).alias("max_lon"),
        F.max(F.array_max("lat")).alias("max_lat"),
    )


def feature_stats(features: DataFrame, n: int = 5) -> DataFrame:
    """Feature count and the first properties of the first feature, one row each."""
    count = features.agg(F.count(F.lit(1)).alias("features")).scalar()
    first = features.orderBy("feature_no").limit(1)
    return first.select(
        count.alias("features"),
        F.posexplode(F.slice(F.map_entries("properties"), 1, n)).alias("pos", "property"),
    ).select("features", "pos", F.col("property.key"), F.col("property.value"))

"""Polygons: the marine-area layer and the custom areas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.schema import CUSTOM_AREAS, FEATURES

_NAMED = (
    "map<string,struct<properties:struct<name:string,description:string>,geometry:string>>"
)


def explode_features(collections: DataFrame) -> DataFrame:
    """Feature collections to one row per feature, geometry as JSON text."""
    numbered = collections.withColumn("collection", F.monotonically_increasing_id())
    return numbered.select(
        "collection", F.posexplode("features").alias("pos", "feature")
    ).select(
        F.struct("collection", "pos").alias("feature_no"),
        F.col("feature.properties")["maNumber"].alias("ma_number"),
        F.col("feature.properties")["maName"].alias("ma_name"),
        F.col("feature.properties")["WAC"].alias("wac"),
        F.col("feature.properties").alias("properties"),
        F.col("feature.geometry").alias("geometry"),
    )


def scan_features(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Features of GeoJSON collections: a collection per file, or one per line."""
    reader = spark.read.schema(FEATURES).option("multiLine", str(not one_per_line).lower())
    return explode_features(reader.json(path))


def feature_lines(features: DataFrame) -> DataFrame:
    """Each feature as a collection of one, one JSON text per row.

    The geometry already is JSON text and is placed in as it stands, but for
    the line breaks of an indented file (inside JSON texts there are none).
    """
    geometry = F.regexp_replace("geometry", r"[\r\n]\s*", "")
    properties = F.to_json("properties", {"ignoreNullFields": "false"})
    line = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'),
        properties,
        F.lit(',"geometry":'),
        F.coalesce(geometry, F.lit("null")),
        F.lit("}]}"),
    )
    return features.select(line.alias("value"))


def sink_features(features: DataFrame, path: str) -> DataFrame:
    """Writes features as lines :func:`scan_features` reads; reports features and bytes."""
    feature_lines(features).write.mode("errorifexists").text(path)
    written = features.sparkSession.read.text(path)
    return written.agg(
        F.count(F.lit(1)).alias("features"), F.sum(F.octet_length("value")).alias("bytes")
    )


def scan_custom_areas(
    spark: SparkSession, path: str, one_per_line: bool = False
) -> DataFrame:
    """Custom areas from JSON objects of features by name: one per file, or one per line."""
    text = spark.read.text(path, wholetext=not one_per_line)
    return text.select(F.explode(F.from_json("value", _NAMED)).alias("name", "feature")).select(
        "name",
        F.col("feature.properties.description").alias("description"),
        F.col("feature.geometry").alias("geometry"),
    )


def custom_area_names(spark: SparkSession) -> DataFrame:
    """The custom areas by name alone, for totals without a map."""
    return spark.createDataFrame([(name,) for name in CUSTOM_AREAS], "name string")

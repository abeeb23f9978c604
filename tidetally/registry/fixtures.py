"""Driver tables read as survey data. ``sql.py`` spells the same mappings in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.functions.cleaning import data_hash
from tidetally.functions.labels import month_name
from tidetally.operators.ingest import project_record
from tidetally.session import keep



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def date_words(day: Column) -> Column:
    """A date as sample dates are written: ``Apr 1, 2013``."""
    return _text(month_name(F.month(day)), " ", F.dayofmonth(day), ", ", F.year(day))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey records from ``lineitem``."""
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    line, quantity, ship = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_shipdate")
    number = part % 13
    created = ship.cast("timestamp")
    values = {
        "chinook": F.when(order % 17 != 0, order % 7),
        "chinook_per_angler": order % 4 / 4,
        "coho": supp % 5,
        "chum": part % 3,
        "pink": line % 2,
        "sockeye": F.when(part % 23 != 0, (order + part) % 4),
        "lingcod": quantity % 3,
        "halibut": (supp + line) % 2,
    }
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.when(part % 97 == 0, "")
            .otherwise(date_words(ship.cast("date")))
            .alias("sample_date"),
            _text("Ramp ", supp % 23).alias("ramp_site"),
            F.when(part % 11 == 0, "")
            .when(part % 7 == 3, _text("NATION_", part % 5 + 14))
            .otherwise(_text("Area ", number, ", Zone ", number))
            .alias("catch_area"),
            line.cast("bigint").alias("interviews"),
            F.when(order % 19 != 0, quantity.cast("bigint")).alias("anglers"),
            *[value.cast("double").alias(name) for name, value in values.items()],
            created.alias("created_at"),
            F.when(
                order % 5 == 0, created + F.make_dt_interval(F.lit(0), line.cast("int"))
            )
            .otherwise(created)
            .alias("updated_at"),
        )
        .withColumn("data_hash", data_hash())
    )


def area_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marine areas from ``nation``, without geometry."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("ma_number"),
        F.col("n_name").alias("ma_name"),
        _text("WAC ", F.col("n_regionkey")).alias("wac"),
        F.lit(None).cast("string").alias("geometry"),
    )


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed text rows from ``orders``: seven yearly batches."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    zone = cust % 6
    return table(spark, sf_dir, "orders").select(
        (F.lit(2002) - F.year(day)).cast("int").alias("batch_no"),
        F.lit("").alias("part"),
        order.alias("seq"),
        date_words(F.trunc(day, "month")).alias("Sample date"),
        _text("Ramp ", cust % 4).alias("Ramp/site"),
        F.when(zone == 0, "N/A")
        .when(zone == 1, "")
        .when(zone == 2, " Area 2, Zone 2 ")
        .otherwise(_text("Area ", zone, ", Zone ", zone))
        .alias("Catch area"),
        F.when(order % 13 == 0, "")
        .otherwise((order % 3).cast("string"))
        .alias("# Interviews (Boat or Shore)"),
        F.when(order % 29 == 0, "3.0").otherwise(_text(" ", cust % 2, " ")).alias("Anglers"),
        F.when(order % 11 == 0, "abc").otherwise((order % 3).cast("string")).alias("Chinook"),
        _text(F.floor(order / 5) % 2, ".5").alias("Coho"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rows, staged as a load stages them."""
    return keep(project_record(raw_batches(spark, sf_dir)), "typed")


def raw_with_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven batches, then batch 8 that repeats batch 7's last rows, then a new batch 9."""
    raw = raw_batches(spark, sf_dir)
    last = project_record(raw).where("batch_no = 7 AND interviews IS NOT NULL AND anglers IS NOT NULL")
    kept = last.groupBy("sample_date", "ramp_site", "catch_area", "interviews", "anglers").agg(
        F.max("seq").alias("seq")
    )
    again = raw.where("batch_no = 7").join(kept.select("seq"), "seq", "left_semi")
    fresh = raw.where("batch_no = 1").withColumn("Ramp/site", F.lit("Ramp 9"))
    return raw.unionByName(again.withColumn("batch_no", F.lit(8))).unionByName(
        fresh.withColumn("batch_no", F.lit(9))
    )


def messy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number-like texts of every kind from ``orders``."""
    cust = F.col("o_custkey")
    forms = [
        F.col("o_totalprice").cast("string"),
        _text(" ", cust, " "),
        _text(cust, ".0"),
        _text("1,", cust),
        F.lit(""),
        F.lit(None).cast("string"),
        _text("+", cust),
        F.lit("abc"),
        _text(cust, "d"),
        _text(cust % 9, "e3"),
        _text(".", cust),
        F.lit("N/A"),
    ]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(text.alias("text"))


def area_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area spellings from ``orders``."""
    forms = [
        F.lit(None).cast("string"),
        F.lit(""),
        F.lit("N/A"),
        F.lit(" NA "),
        F.lit("null"),
        F.lit("n/a"),
        _text(" Area ", F.col("o_custkey") % 20, ", East "),
        F.col("o_orderpriority"),
    ]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(text.alias("text"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries from ``events``: clicks are refreshes."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", "last_update")
        .otherwise(F.col("event_type"))
        .alias("key"),
        stamp.alias("value"),
        stamp.alias("updated_at"),
    )


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons from ``supplier``: triangles, every third one in two parts.

    Written as the sinks write them: text columns, geometry as JSON.
    """
    supp, nation = F.col("s_suppkey"), F.col("s_nationkey")
    lon, lat = -(supp % 180), supp % 90

    def ring(shift: int) -> Column:
        corners = [(0, 0), (1, 0), (0, 1), (0, 0)]
        points = [
            _text("[", lon + (dx + shift), ".5,", lat + (dy + shift), ".25]") for dx, dy in corners
        ]
        return F.concat(F.lit("[["), F.concat_ws(",", *points), F.lit("]]"))

    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":'), ring(0), F.lit("}"))
    multi = F.concat(
        F.lit('{"type":"MultiPolygon","coordinates":['), ring(0), F.lit(","), ring(3), F.lit("]}")
    )
    return table(spark, sf_dir, "supplier").select(
        F.create_map(
            F.lit("maNumber"),
            nation.cast("string"),
            F.lit("maName"),
            F.col("s_name"),
            F.lit("WAC"),
            F.when(supp % 2 == 0, _text("WAC ", supp)),
        ).alias("properties"),
        F.when(supp % 3 == 0, multi).otherwise(polygon).alias("geometry"),
    )


def custom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom areas from ``supplier`` and ``nation``, one JSON object per line."""
    named = supplier_features(spark, sf_dir).select(
        F.col("properties")["maName"].alias("name"), "geometry"
    )
    line = F.concat(
        F.lit('{"'),
        F.col("name"),
        F.lit('":{"type":"Feature","properties":{"name":"'),
        F.col("name"),
        F.lit('","description":"Waters of '),
        F.col("name"),
        F.lit('"},"geometry":'),
        F.col("geometry"),
        F.lit("}}"),
    )
    return named.select(line.alias("value"))


def nation_customs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom areas named like nations: some are survey areas, some are not."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("geometry"),
    )



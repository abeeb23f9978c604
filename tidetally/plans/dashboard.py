"""The six results of a dashboard page from one scan.

All six group by date or area. The filtered records are folded once to one row
per date text and area; that fold is some hundred thousand rows whatever the
size of the table. It is kept as a table and every result is a fold of it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.functions.dates import month_no, with_period, year_of
from tidetally.functions.measures import coalesce_zero, species_sum, species_sums
from tidetally.operators.aggregates import dense_months, fold_by_date, headline
from tidetally.operators.filters import FilterSpec, filtered_records
from tidetally.operators.rollup import page_fold_of
from tidetally.schema import SALMON
from tidetally.session import keep
from tidetally.sources.store import scan_rollup


def page_fold(df: DataFrame, spec: FilterSpec) -> DataFrame:
    """Counts and sums per date text and area under the page's filter."""
    wanted = list(dict.fromkeys([*SALMON, *spec.species_names]))
    return (
        filtered_records(df, spec)
        .groupBy("sample_date", "catch_area")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("anglers").alias("anglers"),
            *species_sums(wanted),
            F.sum(species_sum(spec.species_names)).alias("total"),
        )
    )


def page_results(fold: DataFrame, spec: FilterSpec) -> dict[str, DataFrame]:
    """The six results from the fold."""
    year = year_of(F.col("sample_date"))
    names = spec.species_names
    present = fold.where("catch_area <> ''").groupBy(F.col("catch_area").alias("area"))
    dated = fold_by_date(fold.where("length(sample_date) > 0"), species_sums(names))
    by_date = fold_by_date(fold, [F.sum("total").alias("total")])
    months = by_date.withColumn("month", month_no(F.col("sample_date"))).where("month IS NOT NULL")
    return {
        "stats": headline(
            fold.agg(
                coalesce_zero(F.sum("n")).alias("n"),
                F.sum("anglers").alias("anglers"),
                *species_sums(SALMON),
                F.min(year).alias("min_year"),
                F.max(year).alias("max_year"),
                F.count_distinct(F.when(F.col("catch_area") != "", F.col("catch_area"))).alias(
                    "areas"
                ),
            )
        ),
        "trend": with_period(dated, spec.time_unit)
        .groupBy("period")
        .agg(*species_sums(names))
        .orderBy("period"),
        "species": fold.agg(*[coalesce_zero(F.sum(name)).alias(name) for name in names]),
        "areas": present.agg(F.sum("total").alias("total")).orderBy(
            F.desc_nulls_last("total"), "area"
        ),
        "monthly": dense_months(months.groupBy("month").agg(F.sum("total").alias("total"))),
        "map_data": present.agg(
            coalesce_zero(F.sum("total")).alias("total"), F.sum("n").alias("surveys")
        ),
    }


def dashboard(df: DataFrame, spec: FilterSpec | None = None) -> dict[str, DataFrame]:
    """Headline figures, trend, species, areas, months and map data under one filter."""
    spec = spec or FilterSpec()
    return page_results(keep(page_fold(df, spec), "page"), spec)


def stored_dashboard(
    spark: SparkSession, path: str, spec: FilterSpec | None = None
) -> dict[str, DataFrame]:
    """The same page from the rollup that is kept with the table; reads no records."""
    spec = spec or FilterSpec()
    return page_results(keep(page_fold_of(scan_rollup(spark, path), spec), "page"), spec)


def page_long(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """The page as one frame: section, key, measure, value."""
    spec = spec or FilterSpec()
    return long_form(dashboard(df, spec), spec)


def long_form(results: dict[str, DataFrame], spec: FilterSpec) -> DataFrame:
    """Results of a page as one frame."""
    stats = results["stats"]
    figures = [name for name in stats.columns if name not in ("min_year", "max_year")]
    keys = {
        "stats": F.concat_ws("-", "min_year", "max_year"),
        "trend": F.col("period"),
        "species": F.lit("all"),
        "areas": F.col("area"),
        "monthly": F.col("month").cast("string"),
        "map_data": F.col("area"),
    }
    measures = {
        "stats": figures,
        "trend": spec.species_names,
        "species": spec.species_names,
        "areas": ["total"],
        "monthly": ["total"],
        "map_data": ["total", "surveys"],
    }
    sections = []
    for section, key in keys.items():
        values = [F.col(name).cast("double").alias(name) for name in measures[section]]
        wide = results[section].select(key.alias("key"), *values)
        sections.append(
            wide.unpivot("key", measures[section], "measure", "value").select(
                F.lit(section).alias("section"), "key", "measure", "value"
            )
        )
    long = sections[0]
    for section in sections[1:]:
        long = long.unionByName(section)
    return long

"""Totals over the records: headline figures, by area, period, species and month.

Every grouping is by a low-cardinality text, so the map side folds the rows and
a key that holds a third of them costs no more than any other. Keys computed
from the date text are computed after a first fold by the raw text: once per
distinct date instead of once per row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.dates import month_no, with_period, year_of
from tidetally.functions.measures import (
    coalesce_zero,
    round_half_even,
    species_sum,
    species_sums,
)
from tidetally.operators.filters import (
    FilterSpec,
    filter_area_present,
    filter_date_present,
    filter_updated,
    filtered_records,
)
from tidetally.schema import SALMON


def fold_by_date(df: DataFrame, measures: list[Column]) -> DataFrame:
    """Sums per raw date text. SUM skips NULLs, so sums of these sums stay exact."""
    return df.groupBy("sample_date").agg(*measures)


def _or_na(year: Column) -> Column:
    return F.when(year.isNull() | (year == ""), "N/A").otherwise(year)


def headline(totals: DataFrame) -> DataFrame:
    """Headline figures from one row of sums (see :func:`stats`)."""
    catch = [coalesce_zero(F.col(name)) for name in SALMON]
    return totals.select(
        round_half_even(sum(catch[1:], catch[0])).alias("total_catch"),
        F.col("n").alias("surveys"),
        F.col("n").alias("total_records"),
        coalesce_zero(F.col("anglers")).alias("total_anglers"),
        round_half_even(coalesce_zero(F.col("chinook"))).alias("total_chinook"),
        round_half_even(coalesce_zero(F.col("coho"))).alias("total_coho"),
        _or_na(F.col("min_year")).alias("min_year"),
        _or_na(F.col("max_year")).alias("max_year"),
        F.col("areas"),
    )


def _present_area() -> Column:
    return F.when(F.col("catch_area") != "", F.col("catch_area"))


def stats(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Headline figures in one scan; the species filter does not apply.

    ``total_catch`` adds per-species sums, so it differs from the sums of
    :func:`areas`, which leave out rows with a NULL species.
    """
    year = year_of(F.col("sample_date"))
    return headline(
        filtered_records(df, spec).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("anglers").alias("anglers"),
            *species_sums(SALMON),
            F.min(year).alias("min_year"),
            F.max(year).alias("max_year"),
            F.count_distinct(_present_area()).alias("areas"),
        )
    )


def count_areas(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    present = filter_area_present(filtered_records(df, spec))
    return present.agg(F.count_distinct("catch_area").alias("areas"))


def areas(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Total by area, largest first; a total of only NULLs stays NULL."""
    spec = spec or FilterSpec()
    return (
        filter_area_present(filtered_records(df, spec))
        .groupBy(F.col("catch_area").alias("area"))
        .agg(F.sum(species_sum(spec.species_names)).alias("total"))
        .orderBy(F.desc_nulls_last("total"), "area")
    )


def top_areas(df: DataFrame, spec: FilterSpec | None = None, n: int | None = None) -> DataFrame:
    """The first ``n`` of :func:`areas`; all of them when ``n`` is not given."""
    ranked = areas(df, spec)
    return ranked if n is None else ranked.limit(n)


def map_data(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Total (0 for NULL) and record count by area."""
    spec = spec or FilterSpec()
    return (
        filter_area_present(filtered_records(df, spec))
        .groupBy(F.col("catch_area").alias("area"))
        .agg(
            coalesce_zero(F.sum(species_sum(spec.species_names))).alias("total"),
            F.count(F.lit(1)).alias("surveys"),
        )
    )


def yearly(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Salmon sums by year, NULL as 0; blank dates are left out."""
    by_date = fold_by_date(filter_date_present(filtered_records(df, spec)), species_sums(SALMON))
    return (
        by_date.groupBy(year_of(F.col("sample_date")).alias("year"))
        .agg(*[coalesce_zero(F.sum(name)).alias(name) for name in SALMON])
        .orderBy("year")
    )


def trend(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Sums of the selected species by period; dates without a period form a NULL group."""
    spec = spec or FilterSpec()
    by_date = fold_by_date(
        filter_date_present(filtered_records(df, spec)), species_sums(spec.species_names)
    )
    return (
        with_period(by_date, spec.time_unit)
        .groupBy("period")
        .agg(*species_sums(spec.species_names))
        .orderBy("period")
    )


def species(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """One row: sums of the selected species, NULL as 0."""
    spec = spec or FilterSpec()
    return filtered_records(df, spec).agg(
        *[coalesce_zero(F.sum(name)).alias(name) for name in spec.species_names]
    )


def dense_months(totals: DataFrame) -> DataFrame:
    """All twelve months; those without data get 0."""
    months = totals.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (
        months.join(totals, "month", "left")
        .select("month", coalesce_zero(F.col("total")).alias("total"))
        .orderBy("month")
    )


def monthly(df: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Total by calendar month over all years, twelve rows."""
    spec = spec or FilterSpec()
    by_date = fold_by_date(
        filtered_records(df, spec), [F.sum(species_sum(spec.species_names)).alias("total")]
    )
    known = by_date.withColumn("month", month_no(F.col("sample_date"))).where("month IS NOT NULL")
    return dense_months(known.groupBy("month").agg(F.sum("total").alias("total")))


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("records"))


def effort_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        coalesce_zero(F.sum("anglers")).alias("total_anglers"),
        coalesce_zero(F.sum("interviews")).alias("total_interviews"),
    )


def records_by_year(df: DataFrame) -> DataFrame:
    """Record count by year, newest first; blank dates are left out."""
    by_date = fold_by_date(filter_date_present(df), [F.count(F.lit(1)).alias("n")])
    return (
        by_date.groupBy(year_of(F.col("sample_date")).alias("year"))
        .agg(F.sum("n").alias("records"))
        .orderBy(F.desc("year"))
    )


def top_areas_by_records(df: DataFrame, n: int = 5) -> DataFrame:
    return (
        filter_area_present(df)
        .groupBy("catch_area")
        .agg(F.count(F.lit(1)).alias("records"))
        .orderBy(F.desc("records"), "catch_area")
        .limit(n)
    )


def updated_count(df: DataFrame) -> DataFrame:
    return filter_updated(df).agg(F.count(F.lit(1)).alias("updated"))

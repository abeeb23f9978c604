"""The fact table: Parquet folders by run and survey year, and versions that name them.

``data/run=<run>/survey_year=<year>`` holds what one run made of a year. Which run's
folder counts for a year is said by the latest version (``versions``). ``rollup/``
holds totals of the same rows under the same names, so a version has both.
"""

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetally.functions.dates import survey_year
from tidetally.operators.rollup import rollup
from tidetally.schema import ROLLUP, STORE
from tidetally.sources.versions import StaleVersion, Version, commit, folders, latest, new_run, since


@dataclass(frozen=True)
class Staged:
    """Years written by a run that began with a version, not published yet."""

    run: str
    years: tuple[str, ...]
    base: int


def read_or_none(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_folders(
    spark: SparkSession, path: str, years: dict[str, str], schema: T.StructType, folder: str = "data"
) -> DataFrame:
    """The named folders as one table that is partitioned by survey year.

    The schema is given, never inferred: ``2013`` as a partition value would
    come back as a number and break the text comparison of years.
    """
    if not years:
        return spark.createDataFrame([], schema)
    leaves = [f"{path}/{folder}/run={run}/survey_year={year}" for year, run in sorted(years.items())]
    with_run = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    rows = spark.read.schema(with_run).option("basePath", f"{path}/{folder}").parquet(*leaves)
    return rows.select(*schema.fieldNames())


def scan_store(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """The table as the latest version has it, or as a given one; no rows where there is none yet."""
    return scan_folders(spark, path, (version or latest(spark, path)).years, STORE)


def scan_rollup(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """Totals of the table (``operators.rollup``), as kept with its years."""
    return scan_folders(spark, path, (version or latest(spark, path)).years, ROLLUP, "rollup")


def with_survey_year(records: DataFrame) -> DataFrame:
    return records.withColumn("survey_year", survey_year(F.col("sample_date")))


# Within a file the rows lie by area, so an area filter skips most row groups.
_ORDER = ("survey_year", "catch_area", "sample_date")


def _write_rollup(spark: SparkSession, path: str, run: str) -> None:
    """The rollup of a run's years, from what was written: a scan of few columns that
    folds on the map side."""
    years = {year: run for year in _years_of(spark, path, run)}
    rolled = rollup(scan_folders(spark, path, years, STORE)).select(*ROLLUP.fieldNames())
    rolled.sortWithinPartitions(*_ORDER).write.partitionBy("survey_year").parquet(
        f"{path}/rollup/run={run}"
    )


def _years_of(spark: SparkSession, path: str, run: str) -> tuple[str, ...]:
    """Survey years of a run's folders."""
    names = folders(spark, f"{path}/data/run={run}/survey_year=*")
    return tuple(name.partition("=")[2] for name in names)


def stage_years(records: DataFrame, path: str, base: Version) -> Staged:
    """Writes the survey years present in ``records`` where they will stay.

    No version names them yet, so no reader sees them. Rebalancing gives each year
    files of even size: a year that holds a third of the table is written by many
    tasks, small years share one.
    """
    run = new_run()
    table = with_survey_year(records).select(*STORE.fieldNames())
    # The order is the one the partitioned write needs anyway.
    table.hint("rebalance", "survey_year").sortWithinPartitions(*_ORDER).write.partitionBy(
        "survey_year"
    ).parquet(f"{path}/data/run={run}")
    _write_rollup(records.sparkSession, path, run)
    return staged_years(records.sparkSession, path, run, base.number)


def staged_years(spark: SparkSession, path: str, run: str, base: int) -> Staged:
    """What a run has staged, from its folders."""
    return Staged(run, _years_of(spark, path, run), base)


def copy_years(spark: SparkSession, source: str, years: dict[str, str], path: str) -> str:
    """Copies the named years into a run of their own; moves no row between tasks.

    A year at a time, as rows of one year need no sort to be written: a task streams its
    part of the files, which are in order already, and holds none of it, however large
    the splits are.
    """
    run = new_run()
    for year in sorted(years):
        rows = scan_folders(spark, source, {year: years[year]}, STORE).drop("survey_year")
        rows.write.parquet(f"{path}/data/run={run}/survey_year={year}")
    _write_rollup(spark, path, run)
    return run


def publish(spark: SparkSession, path: str, staged: Staged) -> Version:
    """Makes staged years count, all at once. May be repeated.

    Raises ``StaleVersion`` if another run has published since this one began;
    the table then is as that run left it.
    """
    newer = since(spark, path, staged.base)
    for version in newer:
        if version.run == staged.run:
            return version
    if newer:
        raise StaleVersion(
            f"{path} is at version {newer[-1].number}; this run began with {staged.base}"
        )
    base = latest(spark, path)
    stamp = datetime.now(timezone.utc).isoformat()
    years = {**base.years, **dict.fromkeys(staged.years, staged.run)}
    return commit(
        spark, path, replace(base, number=base.number + 1, years=years, run=staged.run, at=stamp)
    )


def init_store(spark: SparkSession, path: str) -> DataFrame:
    """Creates the table if it is missing and opens it."""
    if not latest(spark, path).number:
        publish(spark, path, Staged(new_run(), (), 0))
    return scan_store(spark, path)


def sink_store(state: DataFrame, path: str, base: Version | None = None) -> Version:
    """Replaces the survey years present in ``state`` and leaves the others alone.

    ``base`` is the version that ``state`` was worked out from, the latest one by
    default; if it isn't the latest any more, the table stays as it is.
    """
    spark = state.sparkSession
    return publish(spark, path, stage_years(state, path, base or latest(spark, path)))

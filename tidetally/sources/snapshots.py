"""Copies of the table elsewhere (any URI Spark can write to).

A copy is a version of its own at the target. Folders of years never change, so
years that the copy before it already holds are named again, not copied again.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tidetally.sources.store import copy_years, scan_store
from tidetally.sources.versions import Version, commit, latest, new_run, since


def snapshot_save(spark: SparkSession, path: str, uri: str | None, at: datetime) -> bool:
    """Copies the table below ``uri``; does nothing without a target or a table.

    Only years that changed since the last copy are written. The copy counts
    once it is complete, so one cut short never hides the one before it.
    """
    table = latest(spark, path) if uri else Version()
    if not table.number:
        return False
    last = latest(spark, uri)
    kept = {y: last.years[y] for y, run in table.years.items() if last.source.get(y) == run}
    fresh = {y: run for y, run in table.years.items() if y not in kept}
    run = new_run()
    if fresh:
        run = copy_years(spark, path, fresh, uri)
    commit(
        spark,
        uri,
        Version(
            number=last.number + 1,
            years={**kept, **dict.fromkeys(fresh, run)},
            run=run,
            at=at.astimezone(timezone.utc).isoformat(),
            source=table.years,
        ),
    )
    return True


def list_snapshots(spark: SparkSession, uri: str) -> list[Version]:
    """All complete copies, oldest first."""
    return since(spark, uri, 0)


def scan_snapshot(spark: SparkSession, uri: str, version: Version) -> DataFrame:
    """The table as a copy has it."""
    return scan_store(spark, uri, version)


def snapshot_restore(
    spark: SparkSession, path: str, uri: str | None, version: Version | None = None
) -> bool:
    """Loads a copy, the latest by default, only where there is no table yet."""
    if not uri or latest(spark, path).number:
        return False
    copy = version or latest(spark, uri)
    if not copy.number:
        return False
    run = copy_years(spark, uri, copy.years, path) if copy.years else new_run()
    stamp = datetime.now(timezone.utc).isoformat()
    commit(spark, path, Version(1, dict.fromkeys(copy.years, run), run, stamp))
    return True

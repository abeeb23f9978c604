"""The refresh: all landed batches into the table, at most once a day."""

import json
import logging
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.operators.ingest import (
    ALL_DUPLICATES_OVER,
    batch_outcomes,
    conflicts,
    null_key,
    project_record,
    run_totals,
    stop_on_all_duplicates,
    stop_on_gap,
    upsert_classify,
    upsert_latest,
)
from tidetally.operators.key_filter import key_filter, with_possible
from tidetally.operators.skew import HOT_ROWS
from tidetally.schema import (
    CURRENT_MESSAGE,
    FAILED_MESSAGE,
    FIRST_SURVEY_YEAR,
    KEY,
    LAST_UPDATE,
    POSITION,
    REFRESH_INTERVAL_HOURS,
    UPDATED_MESSAGE,
)
from tidetally.session import keep, scratch_path
from tidetally.sources.csv_batches import batch_digests, list_batches, scan_csv_batches
from tidetally.sources.run_log import latest_value, scan_log, scan_metadata, sink_metadata
from tidetally.sources.snapshots import snapshot_save
from tidetally.sources.store import (
    Staged,
    init_store,
    publish,
    scan_store,
    stage_years,
    with_survey_year,
)
from tidetally.sources.versions import Version, latest, new_run

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Paths:
    """Where a table and what belongs to it live."""

    landing: str
    store: str
    log: str
    snapshots: str | None = None


def refresh_due(log: DataFrame, now: datetime | Column) -> DataFrame:
    """One row: is a refresh due, and what to say when it is not."""
    last = F.col(LAST_UPDATE)
    hours = (
        F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(last)
    ) / F.lit(3_600_000_000)
    due = last.isNull() | (hours >= REFRESH_INTERVAL_HOURS)
    day = F.expr("INTERVAL 1 DAY")
    message = F.format_string(CURRENT_MESSAGE, hours)
    return scan_metadata(log).select(
        due.alias("due"),
        last,
        F.when(~due, last + day).alias("next_update_available"),
        F.when(~due, message).alias("message"),
    )


def _years(df: DataFrame) -> list[str]:
    """Partition values present: four-digit years and one marker, so a short list."""
    return [row.survey_year for row in df.select("survey_year").distinct().collect()]


@dataclass(frozen=True)
class Load:
    """A load that has been worked out and staged."""

    staged: Staged
    kept: DataFrame
    outcomes: DataFrame

    def conflicts(self) -> DataFrame:
        return conflicts(self.kept)


def _changed_state(
    incoming: DataFrame,
    existing: DataFrame,
    classified: DataFrame,
    run_at: datetime,
    null_safe_key: bool,
) -> DataFrame | None:
    """New state of the survey years in which a row of ``classified`` changes something.

    Only keys with a change are folded anew; a row that repeats what its key holds
    adds nothing to the fold. Stored rows of other keys are passed on as they are, and
    most are known by a filter of the changed keys, without a shuffle.
    """
    changes = keep(classified.where("status <> 'duplicate'"), "changes")
    years = _years(changes)
    if not years:
        return None
    # A merge join by hint: as Parquet the positions are far smaller than as rows, so the
    # planner takes any number of them for a table to send to the driver.
    rows = incoming.join(changes.select(*POSITION).hint("merge"), POSITION, "left_semi")
    existing = existing.where(F.col("survey_year").isin(years))
    made = key_filter(changes, KEY, changes.count())
    if made is None:
        return upsert_latest(rows, existing, run_at, null_safe_key)
    marked = with_possible(existing, KEY, made, "possible")
    state = upsert_latest(rows, marked.where("possible").drop("possible"), run_at, null_safe_key)
    return state.unionByName(marked.where("NOT possible").select(*state.columns))


def stage_load(
    spark: SparkSession,
    incoming: DataFrame,
    store: str,
    base: Version,
    run_at: datetime,
    stage: str,
    null_safe_key: bool = False,
    over: int | None = ALL_DUPLICATES_OVER,
    hot_rows: int = HOT_ROWS,
    unchanged: DataFrame | None = None,
) -> Load:
    """Works out the table's new state from typed rows, without touching the table.

    The classification and the new state are written, so a lost executor costs
    its tasks only. Of the table, only survey years that occur in the batches are
    read, of those only rows whose key may be among the incoming are compared, and
    only years with a change are staged. ``unchanged`` are outcomes of batches that
    need not be looked at; they count for the rule that ends a load.
    """
    marked = f"{stage}/classified"
    existing = scan_store(spark, store, base).where(F.col("survey_year").isin(_years(incoming)))
    made = key_filter(incoming, KEY, incoming.count())
    compared = existing
    if made is not None:
        compared = with_possible(existing, KEY, made, "possible").where("possible").drop("possible")
    with_survey_year(upsert_classify(incoming, compared, null_safe_key, hot_rows)).write.mode(
        "overwrite"
    ).parquet(marked)
    classified = spark.read.parquet(marked)
    outcomes = batch_outcomes(classified)
    if unchanged is not None:
        outcomes = outcomes.unionByName(unchanged)
    outcomes.write.mode("overwrite").parquet(f"{stage}/outcomes")
    outcomes = spark.read.parquet(f"{stage}/outcomes")
    kept = stop_on_all_duplicates(classified, outcomes, over)
    state = _changed_state(incoming, existing, kept, run_at, null_safe_key)
    staged = Staged(new_run(), (), base.number) if state is None else stage_years(state, store, base)
    return Load(staged, kept, outcomes)


def type_rows(spark: SparkSession, raw: DataFrame, stage: str) -> DataFrame:
    """Adds text rows to the typed rows under ``stage``; files are parsed once."""
    typed = f"{stage}/typed"
    with_survey_year(project_record(raw)).write.mode("append").parquet(typed)
    return spark.read.parquet(typed)


# Log key of what is known of the landed batches.
BATCHES = "batches"


def known_batches(
    log: DataFrame, base: Version, digests: dict[int, str], null_safe_key: bool
) -> dict[int, dict]:
    """Batches that would bring nothing but duplicates: rows and survey years of each.

    They have the content they had when they were last loaded, every row of them is
    what the table holds under its key, and the table has not changed since.
    """
    entry = latest_value(log, BATCHES).first().value
    memo = json.loads(entry) if entry else {}
    if memo.get("version") != base.number or memo.get("null_safe_key") != null_safe_key:
        return {}
    found = {int(number): batch for number, batch in memo["batches"].items()}
    return {n: b for n, b in found.items() if n in digests and b["digest"] == digests[n]}


def _settled(
    load: Load, incoming: DataFrame, digests: dict[int, str], null_safe_key: bool
) -> dict[int, dict]:
    """Loaded batches whose rows all are what the table now holds; ``digests`` names those parsed.

    Rows without a full key are inserted each time. Where a row was updated, one
    of the batches with rows of its year may hold what it replaced.
    """
    loose = F.lit(False) if null_safe_key else null_key()
    batches = load.kept.groupBy("batch_no").agg(
        F.count("*").alias("rows"),
        F.count(F.when(loose, 1)).alias("loose"),
        F.sort_array(F.collect_set("survey_year")).alias("years"),
    )
    moved = set(_years(load.kept.where("status = 'updated'")))
    with_rows = {row.batch_no for row in incoming.select("batch_no").distinct().collect()}
    empty = {
        number: {"digest": digest, "rows": 0, "years": []}
        for number, digest in digests.items()
        if number not in with_rows
    }
    return empty | {
        b.batch_no: {"digest": digests[b.batch_no], "rows": b.rows, "years": b.years}
        for b in batches.collect()
        if not b.loose and not moved & set(b.years)
    }


def _outcomes_of(spark: SparkSession, known: dict[int, dict]) -> DataFrame:
    """Outcomes of batches that repeat what the table holds."""
    rows = [(number, b["rows"], 0, 0, b["rows"]) for number, b in known.items() if b["rows"]]
    return spark.createDataFrame(
        rows, "batch_no int, total bigint, new bigint, updated bigint, duplicates bigint"
    )


def load_batches(
    spark: SparkSession,
    manifest: DataFrame,
    paths: Paths,
    now: datetime,
    null_safe_key: bool,
    over: int | None,
) -> tuple[DataFrame, Version]:
    """Loads the landed batches and publishes the result: (outcomes, version).

    A batch that is known to repeat what the table holds is not parsed again. That
    holds as long as no batch that is loaded has rows of its survey years, and
    with that of its keys; those are parsed after all.
    """
    init_store(spark, paths.store)
    base = latest(spark, paths.store)
    digests = batch_digests(spark, manifest)
    known = known_batches(scan_log(spark, paths.log), base, digests, null_safe_key)
    stage = scratch_path(spark, "refresh")
    incoming, parse = None, set(digests) - set(known)
    while parse:
        some = manifest.where(F.col("batch_no").isin(sorted(parse)))
        incoming = type_rows(spark, scan_csv_batches(spark, some), stage)
        years = set(_years(incoming))
        parse = {n for n, b in known.items() if years & set(b["years"])}
        known = {n: b for n, b in known.items() if n not in parse}
    outcomes, settled, version = _outcomes_of(spark, known), {}, base
    if incoming is not None:
        load = stage_load(
            spark, incoming, paths.store, base, now, stage, null_safe_key, over, unchanged=outcomes
        )
        if load.staged.years:
            version = publish(spark, paths.store, load.staged)
        outcomes, settled = load.outcomes, _settled(
            load, incoming, {n: d for n, d in digests.items() if n not in known}, null_safe_key
        )
    memo = {
        "version": version.number,
        "null_safe_key": null_safe_key,
        "batches": {**known, **settled},
    }
    sink_metadata(spark, paths.log, now, BATCHES, json.dumps(memo))
    return outcomes, version


def refresh(
    spark: SparkSession,
    paths: Paths,
    now: datetime | None = None,
    null_safe_key: bool = False,
    over: int | None = ALL_DUPLICATES_OVER,
) -> dict:
    """Refreshes the table if that is due and returns the summary.

    A failed load is reported and not logged, so the next call tries again.
    """
    now = now or datetime.now()
    state = refresh_due(scan_log(spark, paths.log), now).first()
    last = state.last_update.isoformat() if state.last_update else None
    if not state.due:
        return {
            "success": True,
            "message": state.message,
            "last_update": last,
            "next_update_available": (
                state.last_update + timedelta(hours=REFRESH_INTERVAL_HOURS)
            ).isoformat(),
            "should_reload": False,
        }
    try:
        landed = list_batches(spark, paths.landing)
        manifest = keep(stop_on_gap(landed, now.year - FIRST_SURVEY_YEAR + 1), "manifest")
        outcomes, version = load_batches(spark, manifest, paths, now, null_safe_key, over)
        store = scan_store(spark, paths.store, version)
        totals = run_totals(outcomes, manifest, store, over).first()
        snapshot_save(spark, paths.store, paths.snapshots, now)
        sink_metadata(spark, paths.log, now)
    except Exception as error:
        logger.exception("refresh failed")
        return {
            "success": False,
            "message": FAILED_MESSAGE.format(error),
            "last_update": last,
            "should_reload": False,
        }
    return {
        "success": True,
        "message": UPDATED_MESSAGE.format(totals.records),
        "last_update": now.isoformat(),
        "records": totals.records,
        "new": totals.new,
        "updated": totals.updated,
        "duplicates": totals.duplicates,
        "years_fetched": totals.years_fetched,
        "should_reload": True,
    }

"""From landed text rows to the table's state: typing, change detection, stop rules.

Loading row by row keeps, per key, the hash left by the row before. That is
``lag`` over the key in landing order, so all batches are classified at once.
The state after the load needs no order beyond "the last row wins" and is a
plain aggregate, folded on the map side.
"""

from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.functions.cleaning import (
    data_hash,
    normalize_area,
    safe_float,
    safe_int,
    stored_float,
)
from tidetally.operators.aggregates import record_count
from tidetally.operators.skew import HOT_ROWS, with_previous, with_row_number
from tidetally.schema import HEADERS, KEY, POSITION, VALUES

# A batch larger than this that brings nothing but duplicates ends the load.
ALL_DUPLICATES_OVER = 100


def project_record(raw: DataFrame) -> DataFrame:
    """Text rows of an export to typed records with their hash.

    Columns are bound by header; a header the export lacks reads as blank.
    """

    def text(header: str) -> Column:
        return F.col(f"`{header}`") if header in raw.columns else F.lit(None).cast("string")

    blank = F.lit("")
    readers = {
        "sample_date": lambda c: F.coalesce(c, blank),
        "ramp_site": lambda c: F.coalesce(c, blank),
        "catch_area": normalize_area,
        "interviews": safe_int,
        "anglers": safe_int,
    }
    typed = raw.select(
        *POSITION,
        *[
            readers.get(name, safe_float)(text(header)).alias(name)
            for header, name in HEADERS.items()
        ],
    )
    hashed = typed.withColumn("data_hash", data_hash())
    return hashed.select(
        *POSITION, *KEY, *[stored_float(F.col(name)).alias(name) for name in VALUES], "data_hash"
    )


def seq_in_batch(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number within the batch, from 1."""
    return with_row_number(rows, ["batch_no"], "row", hot_rows)


def null_key() -> Column:
    """Whether a row's key has a NULL part."""
    return reduce(or_, [F.col(name).isNull() for name in KEY])


def _by_key_nulls(df: DataFrame, null_safe_key: bool) -> tuple[DataFrame | None, DataFrame]:
    """(rows that can match nothing, rows matched by key)."""
    if null_safe_key:
        return None, df
    return df.where(null_key()), df.where(~null_key())


def key_match(
    incoming: DataFrame, existing: DataFrame, null_safe_key: bool = False
) -> DataFrame:
    """Every incoming row with the hash stored under its key, NULL where none matches.

    The table holds a key once, except for keys with a NULL part; those match
    only under ``null_safe_key``, where the first stored row counts. Incoming
    rows of one key are split by the planner's handling of skewed joins.
    """
    stored = existing.select(*KEY, "data_hash").groupBy(*KEY).agg(
        F.min("data_hash").alias("stored_hash")
    )
    return incoming.join(
        stored.select(*[F.col(name).alias(f"stored_{name}") for name in KEY], "stored_hash"),
        reduce(and_, [same_key(name, f"stored_{name}", null_safe_key) for name in KEY]),
        "left",
    ).select(*incoming.columns, "stored_hash")


def same_key(one: str, other: str, null_safe: bool) -> Column:
    return F.col(one).eqNullSafe(F.col(other)) if null_safe else F.col(one) == F.col(other)


def upsert_classify(
    incoming: DataFrame,
    existing: DataFrame | None = None,
    null_safe_key: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Status of every incoming row against the state left by the rows before it.

    ``inserted`` for a new key, ``updated`` for another hash than before,
    ``duplicate`` for the same hash. A key with a NULL part matches nothing, so
    its rows are always inserted; ``null_safe_key`` lets NULLs match. Only key,
    position and hash go through the shuffle, once.
    """
    rows = incoming.select(*POSITION, *KEY, "data_hash")
    loose = F.lit(False) if null_safe_key else null_key()
    if existing is not None:
        stored = existing.select(
            F.lit(0).alias("batch_no"),
            F.lit("").alias("part"),
            F.lit(-1).cast("bigint").alias("seq"),
            *KEY,
            "data_hash",
        )
        rows = stored.where(~loose).unionByName(rows)
    linked = with_previous(rows, KEY, "data_hash", "old_hash", hot_rows, loose)
    if existing is not None:
        linked = linked.where("batch_no > 0")
    status = (
        F.when(F.col("old_hash").isNull(), "inserted")
        .when(F.col("old_hash") != F.col("data_hash"), "updated")
        .otherwise("duplicate")
    )
    return linked.withColumn("status", status)


def upsert_latest(
    incoming: DataFrame,
    existing: DataFrame | None = None,
    run_at: datetime | Column | None = None,
    null_safe_key: bool = False,
) -> DataFrame:
    """State of the table after the load: the last row of each key wins.

    ``created_at`` stays that of the first row. ``updated_at`` moves only when a
    hash changed (the hashes of the key are not all the same), and then lies
    after ``created_at`` even if both happened in one run.
    """
    now = F.current_timestamp() if run_at is None else F.lit(run_at)
    rows = incoming.select(
        F.struct(*POSITION).alias("position"),
        *KEY,
        *VALUES,
        "data_hash",
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    if existing is not None:
        before_all = F.struct(
            F.lit(0).cast(incoming.schema["batch_no"].dataType).alias("batch_no"),
            F.lit("").alias("part"),
            F.lit(-1).cast("bigint").alias("seq"),
        )
        stored = existing.select(
            before_all.alias("position"), *KEY, *VALUES, "data_hash", "created_at", "updated_at"
        )
        rows = stored.unionByName(rows)
    loose, matched = _by_key_nulls(rows, null_safe_key)
    folded = matched.groupBy(*KEY).agg(
        F.max_by(F.struct(*VALUES, "data_hash"), "position").alias("last"),
        F.min_by(F.struct("created_at", "updated_at"), "position").alias("first"),
        (F.min("data_hash") != F.max("data_hash")).alias("changed"),
    )
    tick = F.expr("INTERVAL '0.000001' SECOND")
    moved = F.greatest(now, F.col("first.created_at") + tick)
    state = folded.select(
        *KEY,
        "last.*",
        F.col("first.created_at").alias("created_at"),
        F.when(F.col("changed"), moved).otherwise(F.col("first.updated_at")).alias("updated_at"),
    )
    return state if loose is None else state.unionByName(loose.drop("position"))


def conflicts(classified: DataFrame) -> DataFrame:
    """Log of changes: the key with a blank area as ``N/A``, old and new hash."""
    area = F.when(F.col("catch_area") == "", "N/A").otherwise(F.col("catch_area"))
    return classified.where("status = 'updated'").select(
        *POSITION,
        "sample_date",
        "ramp_site",
        area.alias("catch_area"),
        "interviews",
        "anglers",
        "old_hash",
        F.col("data_hash").alias("new_hash"),
    )


def first_conflicts(classified: DataFrame, n: int = 10) -> DataFrame:
    """The first changes in landing order and how many more there are."""
    log = conflicts(classified)
    more = log.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return log.orderBy(*POSITION).limit(n).withColumn("more", more.scalar())


def batch_outcomes(classified: DataFrame) -> DataFrame:
    """Rows per batch: total, new, updated, duplicates."""

    def having(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    return classified.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("total"),
        having("inserted").alias("new"),
        having("updated").alias("updated"),
        having("duplicate").alias("duplicates"),
    )


def all_duplicates_stop(outcomes: DataFrame, over: int | None = ALL_DUPLICATES_OVER) -> DataFrame:
    """One row, ``stop_at``: the first batch of nothing but duplicates, NULL if there is none.

    ``over=None`` turns the rule off.
    """
    useless = (F.col("total") > F.lit(over)) & (F.col("duplicates") == F.col("total"))
    return outcomes.where(useless).agg(F.min("batch_no").alias("stop_at"))


def stop_on_all_duplicates(
    batched: DataFrame, outcomes: DataFrame, over: int | None = ALL_DUPLICATES_OVER
) -> DataFrame:
    """Drops what lies behind the first all-duplicate batch (that batch is kept).

    No classification depends on a later batch, so the cut comes after it.
    Works on anything with a ``batch_no``: rows, records, outcomes.
    """
    stop_at = all_duplicates_stop(outcomes, over).scalar()
    return batched.where(F.col("batch_no") <= F.coalesce(stop_at, F.col("batch_no")))


def stop_on_gap(manifest: DataFrame, max_years: int) -> DataFrame:
    """Landed batches up to the first missing number and up to ``max_years``.

    A batch that landed empty is no gap.
    """
    landed = manifest.where(F.col("batch_no").between(1, max_years))
    numbers = landed.select("batch_no").distinct()
    following = numbers.select((F.col("batch_no") + 1).alias("batch_no")).union(
        manifest.sparkSession.range(1, 2).select(F.col("id").cast("int").alias("batch_no"))
    )
    gap = following.join(numbers, "batch_no", "left_anti").agg(F.min("batch_no").alias("gap"))
    return landed.where(F.col("batch_no") < gap.scalar())


def run_totals(
    outcomes: DataFrame, manifest: DataFrame, state: DataFrame, over: int | None = ALL_DUPLICATES_OVER
) -> DataFrame:
    """Sums over the kept batches, the record count afterwards and the years fetched.

    The batch that ended the load counts in the sums, not among the years.
    """
    kept = stop_on_all_duplicates(outcomes, outcomes, over)
    fetched = manifest.agg(F.coalesce(F.max("batch_no"), F.lit(0)).alias("years")).scalar()
    ended = all_duplicates_stop(outcomes, over).scalar()
    return kept.agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("new", "updated", "duplicates")
        ]
    ).select(
        record_count(state).scalar().alias("records"),
        "new",
        "updated",
        "duplicates",
        F.coalesce(ended - 1, fetched).cast("int").alias("years_fetched"),
    )

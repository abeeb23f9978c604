"""Applies files as they land, each exactly once.

The stream carries file names only; every micro-batch reads its files by their
own headers and applies them with the operators of the batch refresh. There is
no watermark: a correction to an old survey year is never too late.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidetally.plans.refresh import stage_load, type_rows
from tidetally.sources.csv_batches import manifest_of, scan_csv_batches
from tidetally.sources.run_log import latest_value, scan_log, sink_metadata
from tidetally.sources.store import init_store, publish, staged_years
from tidetally.sources.versions import StaleVersion, latest, new_run

# Times a micro-batch is worked out anew because someone else published meanwhile.
ATTEMPTS = 5

_LANDED = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, landing: str, per_trigger: int = 100) -> DataFrame:
    """Stream of landed file names and sizes; contents are not read."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_LANDED)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(per_trigger))
        .load(landing)
        .select("path", "length")
    )


def stream_refresh(
    spark: SparkSession,
    landing: str,
    store: str,
    log: str,
    checkpoint: str,
    null_safe_key: bool = False,
    per_trigger: int = 100,
) -> StreamingQuery:
    """Works off everything that has landed since the last call, then stops.

    A micro-batch first stages the new state, then publishes it, and logs both
    steps. One that is replayed after a crash goes on from the last logged
    step, so its rows are never applied twice (records with a NULL key part
    would be inserted again). If another run publishes in between, the batch is
    worked out anew from there. The rules that end a batch load do not apply.
    """

    def apply(files: DataFrame, batch_id: int) -> None:
        def logged(step: str) -> str | None:
            entry = latest_value(scan_log(spark, log), f"{step}:{checkpoint}:{batch_id}")
            return entry.first().value

        def enter(step: str, value: str | None = None) -> None:
            sink_metadata(spark, log, datetime.now(), f"{step}:{checkpoint}:{batch_id}", value)

        def stage():
            init_store(spark, store)
            folder = f"{checkpoint}/stage/{batch_id}-{new_run()}"
            raw = scan_csv_batches(spark, manifest_of(files, by_file=True))
            typed = type_rows(spark, raw, folder)
            base = latest(spark, store)
            load = stage_load(
                spark, typed, store, base, datetime.now(), folder, null_safe_key, over=None
            )
            enter("staged", f"{load.staged.run} {load.staged.base}")
            return load.staged

        if logged("published"):
            return
        before = logged("staged")
        if before:
            run, base = before.split()
            staged = staged_years(spark, store, run, int(base))
        else:
            staged = stage()
        for attempt in range(ATTEMPTS):
            try:
                publish(spark, store, staged)
                break
            except StaleVersion:
                if attempt + 1 == ATTEMPTS:
                    raise
                staged = stage()
        enter("published")
        sink_metadata(spark, log, datetime.now())

    return (
        landed_files(spark, landing, per_trigger)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{checkpoint}/offsets")
        .trigger(availableNow=True)
        .start()
    )

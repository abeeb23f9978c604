"""Times the headline work; prints one JSON line.

The driver's tables are first loaded the way a user's data would be: records
into the partitioned table, text rows into typed ones. Queries then run on
that. Each runs once to warm up and then ``BENCH_RUNS`` times; its figure is
the median. All rows of a result are produced (written to a no-op sink).
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidetally.operators import aggregates, duplicates, ingest, options
from tidetally.operators.filters import FilterSpec
from tidetally.plans.dashboard import page_long
from tidetally.plans.map_page import map_page
from tidetally.plans.refresh import Paths, refresh
from tidetally.plans.report import report_long
from tidetally.registry import fixtures as fx
from tidetally.registry.queries import PICKED, RUN_AT
from tidetally.session import scratch_path
from tidetally.sources import csv_batches, store


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    table = scratch_path(spark, "bench-store")
    store.sink_store(fx.survey(spark, sf_dir), table)
    df = store.scan_store(spark, table)
    typed = fx.records(spark, sf_dir)
    landing = scratch_path(spark, "bench-landing")
    csv_batches.write_csv_batches(fx.raw_batches(spark, sf_dir), landing)

    def load_csv():
        base = scratch_path(spark, "bench-refresh")
        paths = Paths(landing, f"{base}/store", f"{base}/log")
        if not refresh(spark, paths, RUN_AT)["success"]:
            raise RuntimeError("refresh failed")
        return store.scan_store(spark, paths.store)

    def load_store():
        path = scratch_path(spark, "bench-store")
        store.sink_store(fx.survey(spark, sf_dir), path)
        return store.scan_store(spark, path)

    def trend(unit):
        return lambda: aggregates.trend(df, FilterSpec(time_unit=unit))

    some = FilterSpec("1997", "1999", PICKED, ("coho", "lingcod"), "weekly")
    work = {
        "stats": lambda: aggregates.stats(df),
        "stats_filtered": lambda: aggregates.stats(df, some),
        "trend_daily": trend("daily"),
        "trend_weekly": trend("weekly"),
        "trend_weekly_filtered": lambda: aggregates.trend(df, some),
        "trend_monthly": trend("monthly"),
        "trend_yearly": trend("yearly"),
        "yearly": lambda: aggregates.yearly(df),
        "species": lambda: aggregates.species(df),
        "areas": lambda: aggregates.areas(df),
        "monthly": lambda: aggregates.monthly(df),
        "map_data": lambda: aggregates.map_data(df),
        "filter_options": lambda: options.filter_options(df),
        "dashboard": lambda: page_long(df, FilterSpec(time_unit="weekly")),
        "choropleth": lambda: map_page(
            df, fx.area_features(spark, sf_dir), fx.nation_customs(spark, sf_dir)
        ),
        "collection_report": lambda: report_long(df),
        "project_record": lambda: ingest.project_record(fx.raw_batches(spark, sf_dir)),
        "upsert_classify": lambda: ingest.upsert_classify(typed),
        "upsert_latest": lambda: ingest.upsert_latest(typed, run_at=RUN_AT),
        "batch_outcomes": lambda: ingest.batch_outcomes(ingest.upsert_classify(typed)),
        "inspect_duplicates": lambda: duplicates.inspect_duplicates(typed),
        "load_store": load_store,
        "refresh": load_csv,
    }
    seconds = {}
    for name, run in work.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

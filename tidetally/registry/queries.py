"""One entry per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.functions import cleaning, dates, labels, measures
from tidetally.operators import aggregates, areas, duplicates, filters, ingest, options, series
from tidetally.operators.filters import FilterSpec
from tidetally.plans.dashboard import long_form, page_long, stored_dashboard
from tidetally.plans.map_page import map_page
from tidetally.plans.refresh import Paths, refresh, refresh_due
from tidetally.plans.report import report_long
from tidetally.registry import fixtures as fx
from tidetally.schema import KEY, SPECIES, VALUES
from tidetally.session import keep, scratch_path
from tidetally.sources import csv_batches, export, features, run_log, snapshots, store
from tidetally.streaming.landing import stream_refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_AT = datetime(2025, 6, 1, 12, tzinfo=timezone.utc)
YEARS = FilterSpec(year_start="1997", year_end="1999")
TWO_SPECIES = FilterSpec(species=("Coho", "lingcod"))
PICKED = ("Area 4, Zone 4", "NATION_15", "Area 9, Zone 9")


def query(name: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return add


def _values(df: DataFrame, **columns: Column) -> DataFrame:
    """Distinct values of expressions with their row counts."""
    return df.select(*[c.alias(n) for n, c in columns.items()]).groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- sources and sinks -------------------------------------------------------


def _landed(spark: SparkSession, sf_dir: str) -> str:
    landing = scratch_path(spark, "landing")
    csv_batches.write_csv_batches(fx.raw_batches(spark, sf_dir), landing)
    return landing


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "store")
    store.sink_store(fx.survey(spark, sf_dir), path)
    return path


@query("scan_csv_batches")
def scan_csv_batches(spark, sf_dir):
    manifest = csv_batches.list_batches(spark, _landed(spark, sf_dir))
    raw = csv_batches.scan_csv_batches(spark, manifest)
    texts = {
        "sample_date": "Sample date",
        "area": "Catch area",
        "interviews": "# Interviews (Boat or Shore)",
        "anglers": "Anglers",
        "chinook": "Chinook",
        "coho": "Coho",
    }
    blank = F.lit("")
    return _values(
        raw,
        batch_no=F.col("batch_no"),
        **{name: F.coalesce(F.col(f"`{header}`"), blank) for name, header in texts.items()},
    )


@query("scan_store")
def scan_store(spark, sf_dir):
    df = filters.filtered_records(store.scan_store(spark, _stored(spark, sf_dir)), YEARS)
    return df.groupBy("survey_year", "catch_area").agg(
        F.count(F.lit(1)).alias("n"), F.sum("coho").alias("coho")
    )


@query("init_store")
def init_store(spark, sf_dir):
    path = scratch_path(spark, "store")
    store.init_store(spark, path)
    store.sink_store(fx.survey(spark, sf_dir), path)
    return store.init_store(spark, path).groupBy("survey_year").agg(
        F.count(F.lit(1)).alias("n"), F.count("anglers").alias("with_anglers")
    )


@query("sink_store")
def sink_store(spark, sf_dir):
    """Loads batches 1 to 3, then 4 to 7 on top of them."""
    path = store_after_two_loads(spark, sf_dir)
    return _state(store.scan_store(spark, path))


def store_after_two_loads(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "store")
    rows = fx.records(spark, sf_dir)
    for part, day in (("batch_no <= 3", 1), ("batch_no > 3", 2)):
        existing = store.scan_store(spark, path)
        state = ingest.upsert_latest(rows.where(part), existing, RUN_AT.replace(day=day))
        store.sink_store(state, path)
    return path


def _state(df: DataFrame) -> DataFrame:
    return df.select(
        *KEY,
        "chinook",
        "coho",
        "data_hash",
        (F.col("updated_at") > F.col("created_at")).alias("changed"),
    )


@query("scan_metadata")
def scan_metadata(spark, sf_dir):
    last = run_log.scan_metadata(fx.run_log(spark, sf_dir))
    return last.select(
        F.date_format("last_update", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_update")
    )


@query("sink_metadata")
def sink_metadata(spark, sf_dir):
    """The log of ``events`` with two refreshes appended, the older one last."""
    path = scratch_path(spark, "log")
    fx.run_log(spark, sf_dir).write.parquet(path)
    run_log.sink_metadata(spark, path, RUN_AT)
    run_log.sink_metadata(spark, path, RUN_AT.replace(year=2024))
    log = run_log.scan_log(spark, path)
    entries = log.groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
    newest = log.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))
    return entries.join(newest, "key")


@query("export_json")
def export_json(spark, sf_dir):
    path = export.export_json(
        store.scan_store(spark, _stored(spark, sf_dir)), scratch_path(spark, "export"), "all.json"
    )
    back = spark.read.schema(
        "sample_date string, catch_area string, anglers bigint, chinook double, sockeye double,"
        " data_hash string, created_at string"
    ).json(path)
    return back.groupBy("catch_area").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("anglers").alias("with_anglers"),
        F.sum("chinook").alias("chinook"),
        F.sum("sockeye").alias("sockeye"),
        F.count("data_hash").alias("with_hash"),
        F.count("created_at").alias("with_created"),
    )


@query("snapshot_save")
def snapshot_save(spark, sf_dir):
    """Saves twice; both copies are listed and both are complete."""
    path, uri = _stored(spark, sf_dir), scratch_path(spark, "snapshots")
    for day in (1, 2):
        snapshots.snapshot_save(spark, path, uri, RUN_AT.replace(day=day))
    listed = snapshots.list_snapshots(spark, uri)
    first, second = (snapshots.scan_snapshot(spark, uri, version) for version in listed)
    return first.unionByName(second).groupBy("catch_area").agg(
        F.count(F.lit(1)).alias("n"), F.sum("coho").alias("coho")
    ).withColumn("copies", F.lit(len(listed)).cast("bigint"))


@query("snapshot_restore")
def snapshot_restore(spark, sf_dir):
    path, uri = _stored(spark, sf_dir), scratch_path(spark, "snapshots")
    snapshots.snapshot_save(spark, path, uri, RUN_AT)
    fresh = scratch_path(spark, "store")
    snapshots.snapshot_restore(spark, fresh, uri)
    snapshots.snapshot_restore(spark, fresh, uri)
    return store.scan_store(spark, fresh).groupBy("survey_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pink").alias("pink")
    )


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features")
    features.feature_lines(fx.supplier_features(spark, sf_dir)).write.text(path)
    return features.scan_features(spark, path, one_per_line=True)


@query("scan_features")
def scan_features(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "ma_number", "ma_name", "wac", F.get_json_object("geometry", "$.type").alias("kind")
    )


@query("scan_custom_areas")
def scan_custom_areas(spark, sf_dir):
    path = scratch_path(spark, "custom")
    fx.custom_lines(spark, sf_dir).write.text(path)
    return features.scan_custom_areas(spark, path, one_per_line=True).select(
        "name", "description", F.get_json_object("geometry", "$.type").alias("kind")
    )


@query("sink_features")
def sink_features(spark, sf_dir):
    written = features.sink_features(_features(spark, sf_dir), scratch_path(spark, "features"))
    return written.select("features", (F.col("bytes") > 0).alias("has_bytes"))


@query("result_json")
def result_json(spark, sf_dir):
    df = fx.survey(spark, sf_dir).select("sample_date", "catch_area", "interviews", "anglers")
    return series.result_json(df.distinct())


# --- projections and scalar functions ----------------------------------------


@query("safe_float")
def safe_float(spark, sf_dir):
    text = F.col("text")
    return _values(fx.messy_texts(spark, sf_dir), text=text, value=cleaning.safe_float(text))


@query("safe_int")
def safe_int(spark, sf_dir):
    text = F.col("text")
    return _values(fx.messy_texts(spark, sf_dir), text=text, value=cleaning.safe_int(text))


@query("normalize_area")
def normalize_area(spark, sf_dir):
    text = F.col("text")
    return _values(fx.area_texts(spark, sf_dir), text=text, area=cleaning.normalize_area(text))


@query("data_hash")
def data_hash(spark, sf_dir):
    return _values(fx.survey(spark, sf_dir).drop("data_hash"), data_hash=cleaning.data_hash())


@query("project_record")
def project_record(spark, sf_dir):
    return fx.records(spark, sf_dir).drop("part")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sample dates with their counts; some with a wrong day, month or case."""
    date = F.col("sample_date")
    odd = (
        F.when(F.col("interviews") == 1, F.regexp_replace(date, r" \d+,", " 30,"))
        .when(F.col("interviews") == 2, F.lower(date))
        .when(F.col("interviews") == 3, F.regexp_replace(date, "^Apr", "April"))
        .otherwise(date)
    )
    return fx.survey(spark, sf_dir).groupBy(odd.alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("year_of")
def year_of(spark, sf_dir):
    return _dates(spark, sf_dir).withColumn("year", dates.year_of(F.col("d")))


@query("month_no")
def month_no(spark, sf_dir):
    return _dates(spark, sf_dir).withColumn("month", dates.month_no(F.col("d")))


@query("month_text")
def month_text(spark, sf_dir):
    return _dates(spark, sf_dir).withColumn("month", dates.month_text(F.col("d")))


@query("day_text")
def day_text(spark, sf_dir):
    return _dates(spark, sf_dir).withColumn("day", dates.day_text(F.col("d")))


@query("date_text")
def date_text(spark, sf_dir):
    return _dates(spark, sf_dir).withColumn("date", dates.date_text(F.col("d")))


@query("period_key")
def period_key(spark, sf_dir):
    d = F.col("d")
    units = {unit: dates.period_key(d, unit) for unit in ("daily", "weekly", "monthly", "yearly")}
    return _dates(spark, sf_dir).withColumns({**units, "other": dates.period_key(d, "hourly")})


@query("week_label")
def week_label(spark, sf_dir):
    weeks = dates.with_period(_dates(spark, sf_dir).withColumnRenamed("d", "sample_date"), "weekly")
    totals = weeks.groupBy("period").agg(F.sum("n").alias("n"))
    return totals.withColumn("label", dates.week_label(F.col("period")))


@query("species_sum")
def species_sum(spark, sf_dir):
    """The sum over rows next to the sum of the species' own sums."""
    names = ["chinook", "sockeye", "halibut"]
    return fx.survey(spark, sf_dir).groupBy("ramp_site").agg(
        F.sum(measures.species_sum(names)).alias("of_rows"),
        sum([F.sum(name) for name in names[1:]], F.sum(names[0])).alias("of_species"),
    )


@query("species_list")
def species_list(spark, sf_dir):
    """Sums picked by four ways of asking."""
    df = fx.survey(spark, sf_dir)
    asked = {
        "none": None,
        "all": ["all", "coho"],
        "blank": [""],
        "two": ["Coho", "LINGCOD", "coho"],
    }
    sums = {
        name: F.sum(measures.species_sum(filters.species_list(wanted)))
        for name, wanted in asked.items()
    }
    return df.groupBy("ramp_site").agg(*[c.alias(f"sum_{name}") for name, c in sums.items()])


@query("area_number")
def area_number(spark, sf_dir):
    area = F.col("catch_area")
    return _values(fx.survey(spark, sf_dir), area=area, number=labels.area_number(area))


@query("area_label")
def area_label(spark, sf_dir):
    long = F.concat(F.col("ramp_site"), F.lit(" off the shore of "), F.col("catch_area"))
    return _values(fx.survey(spark, sf_dir), area=long, label=labels.area_label(long))


@query("species_label")
def species_label(spark, sf_dir):
    df = fx.survey(spark, sf_dir).unpivot(["ramp_site"], SPECIES, "species", "catch")
    return df.groupBy(labels.species_label(F.col("species")).alias("label")).agg(
        F.sum("catch").alias("catch")
    )


@query("display_name")
def display_name(spark, sf_dir):
    df = fx.table(spark, sf_dir, "supplier")
    area = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Zone "), F.col("s_suppkey")))
    name, number = F.col("s_name"), F.col("s_nationkey").cast("string")
    return df.select(
        "s_suppkey", labels.display_name(area, name, number).alias("display_name")
    )


@query("format_count")
def format_count(spark, sf_dir):
    value = F.col("o_totalprice")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", labels.format_count(value).alias("text")
    )


@query("coalesce_zero")
def coalesce_zero(spark, sf_dir):
    df = fx.survey(spark, sf_dir)
    caught, anglers = (measures.coalesce_zero(F.col(c)) for c in ("chinook", "anglers"))
    return _values(df, chinook=caught, anglers=anglers)


@query("rounding")
def rounding(spark, sf_dir):
    """Both rounding rules on halves and quarters, negative ones too."""
    value = (F.col("o_orderkey") % 41 - 20) / 4
    return _values(
        fx.table(spark, sf_dir, "orders"),
        value=value,
        half_even=measures.round_half_even(value),
        half_up=measures.round_half_up(value),
    )


@query("intensity")
def intensity(spark, sf_dir):
    totals = keep(aggregates.map_data(fx.survey(spark, sf_dir)), "totals")
    return areas.with_intensity(totals, totals)


# --- filters -----------------------------------------------------------------


@query("where_clause")
def where_clause(spark, sf_dir):
    spec = FilterSpec(year_start="1996", year_end="1999", catch_area=PICKED)
    return fx.survey(spark, sf_dir).where(filters.where_clause(spec)).select(*KEY, *VALUES)


@query("filter_year_range")
def filter_year_range(spark, sf_dir):
    """Row counts under four pairs of bounds."""
    df = fx.survey(spark, sf_dir)
    bounds = {
        "upper": (None, "1997"),
        "lower": ("1997", None),
        "both": ("1997", "1999"),
        "crossed": ("1999", "1997"),
    }
    counted = [
        filters.filter_year_range(df, *pair)
        .groupBy("sample_date")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("bounds"), "sample_date", "n")
        for name, pair in bounds.items()
    ]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


@query("filter_areas")
def filter_areas(spark, sf_dir):
    df = filters.filter_areas(fx.survey(spark, sf_dir), ["", *PICKED])
    return df.groupBy("catch_area").agg(F.count(F.lit(1)).alias("n"))


@query("filter_area_present")
def filter_area_present(spark, sf_dir):
    df = filters.filter_area_present(fx.survey(spark, sf_dir))
    return df.groupBy("catch_area", "ramp_site").agg(F.count(F.lit(1)).alias("n"))


@query("filter_date_present")
def filter_date_present(spark, sf_dir):
    df = filters.filter_date_present(fx.survey(spark, sf_dir))
    return df.groupBy("sample_date").agg(F.count(F.lit(1)).alias("n"))


@query("filter_month_known")
def filter_month_known(spark, sf_dir):
    df = _dates(spark, sf_dir).withColumn("month", dates.month_no(F.col("d")))
    return df.where("month IS NOT NULL").groupBy("month").agg(F.sum("n").alias("n"))


@query("filter_updated")
def filter_updated(spark, sf_dir):
    df = filters.filter_updated(fx.survey(spark, sf_dir))
    return df.groupBy("interviews").agg(F.count(F.lit(1)).alias("n"))


@query("filtered_records")
def filtered_records(spark, sf_dir):
    spec = FilterSpec.from_params(
        {"year_start": ["1998"], "catch_area": list(PICKED), "species": ["coho"]}
    )
    return filters.filtered_records(fx.survey(spark, sf_dir), spec).select(
        *KEY, *VALUES, "data_hash"
    )


# --- joins -------------------------------------------------------------------


@query("key_match")
def key_match(spark, sf_dir):
    rows = fx.records(spark, sf_dir)
    stored = ingest.upsert_latest(rows.where("batch_no <= 3"), run_at=RUN_AT)
    return ingest.key_match(rows.where("batch_no > 3"), stored).select(
        "batch_no", "seq", "data_hash", "stored_hash"
    )


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas.canonical_areas(options.filter_options_areas(fx.survey(spark, sf_dir)))


@query("canonical_areas")
def canonical_areas(spark, sf_dir):
    return _canonical(spark, sf_dir)


@query("area_match")
def area_match(spark, sf_dir):
    """Totals of a few areas only, so that all four steps find something."""
    spec = FilterSpec(catch_area=(*PICKED, "Area 1, Zone 1"))
    totals = keep(aggregates.map_data(fx.survey(spark, sf_dir), spec), "totals")
    return areas.area_match(
        fx.area_features(spark, sf_dir), totals, _canonical(spark, sf_dir)
    ).drop("geometry")


@query("custom_area_match")
def custom_area_match(spark, sf_dir):
    totals = aggregates.map_data(fx.survey(spark, sf_dir))
    return areas.custom_area_match(fx.nation_customs(spark, sf_dir), totals).drop("geometry")


@query("selected_flag")
def selected_flag(spark, sf_dir):
    area = F.col("catch_area")
    return _values(
        fx.survey(spark, sf_dir), area=area, selected=areas.selected_flag(area, PICKED)
    )


@query("dense_months")
def dense_months(spark, sf_dir):
    """The last year of the data ends early: its missing months get 0."""
    return aggregates.monthly(fx.survey(spark, sf_dir), FilterSpec(year_start="2001"))


# --- aggregates, sorts, limits -----------------------------------------------


@query("stats")
def stats(spark, sf_dir):
    return aggregates.stats(fx.survey(spark, sf_dir))


@query("stats_filtered")
def stats_filtered(spark, sf_dir):
    spec = FilterSpec(year_start="1997", year_end="1999", species=("halibut",))
    return aggregates.stats(fx.survey(spark, sf_dir), spec)


@query("stats_no_rows")
def stats_no_rows(spark, sf_dir):
    return aggregates.stats(fx.survey(spark, sf_dir), FilterSpec("2020", "2013"))


@query("count_areas")
def count_areas(spark, sf_dir):
    return aggregates.count_areas(fx.survey(spark, sf_dir), YEARS)


@query("areas")
def areas_query(spark, sf_dir):
    return aggregates.areas(fx.survey(spark, sf_dir))


@query("areas_two_species")
def areas_two_species(spark, sf_dir):
    return aggregates.areas(fx.survey(spark, sf_dir), TWO_SPECIES)


@query("top_areas")
def top_areas(spark, sf_dir):
    return aggregates.top_areas(fx.survey(spark, sf_dir), n=10)


@query("map_data")
def map_data(spark, sf_dir):
    return aggregates.map_data(fx.survey(spark, sf_dir))


@query("map_data_filtered")
def map_data_filtered(spark, sf_dir):
    spec = FilterSpec(year_end="1997", species=("chinook", "sockeye"))
    return aggregates.map_data(fx.survey(spark, sf_dir), spec)


@query("yearly")
def yearly(spark, sf_dir):
    return aggregates.yearly(fx.survey(spark, sf_dir))


def _trend(unit: str) -> Query:
    def run(spark, sf_dir):
        return aggregates.trend(fx.survey(spark, sf_dir), FilterSpec(time_unit=unit))

    return run


for _unit in dates.TIME_UNITS:
    QUERIES[f"trend_{_unit}"] = _trend(_unit)


@query("trend_weekly_filtered")
def trend_weekly_filtered(spark, sf_dir):
    spec = FilterSpec("1997", "1999", PICKED, ("coho", "lingcod"), "weekly")
    return aggregates.trend(fx.survey(spark, sf_dir), spec)


@query("species")
def species(spark, sf_dir):
    return aggregates.species(fx.survey(spark, sf_dir), FilterSpec(species=tuple(SPECIES)))


@query("monthly")
def monthly(spark, sf_dir):
    return aggregates.monthly(fx.survey(spark, sf_dir))


@query("record_count")
def record_count(spark, sf_dir):
    return aggregates.record_count(fx.survey(spark, sf_dir))


@query("effort_totals")
def effort_totals(spark, sf_dir):
    return aggregates.effort_totals(fx.survey(spark, sf_dir))


@query("records_by_year")
def records_by_year(spark, sf_dir):
    return aggregates.records_by_year(fx.survey(spark, sf_dir))


@query("top_areas_by_records")
def top_areas_by_records(spark, sf_dir):
    return aggregates.top_areas_by_records(fx.survey(spark, sf_dir))


@query("updated_count")
def updated_count(spark, sf_dir):
    return aggregates.updated_count(fx.survey(spark, sf_dir))


@query("max_area_total")
def max_area_total(spark, sf_dir):
    return areas.max_area_total(aggregates.map_data(fx.survey(spark, sf_dir)))


@query("filter_options_years")
def filter_options_years(spark, sf_dir):
    return options.filter_options_years(fx.survey(spark, sf_dir))


@query("filter_options_areas")
def filter_options_areas(spark, sf_dir):
    return options.filter_options_areas(fx.survey(spark, sf_dir))


@query("filter_options")
def filter_options(spark, sf_dir):
    both = options.filter_options(fx.survey(spark, sf_dir))
    return both.select(
        F.array_join("years", "|").alias("years"), F.array_join("areas", "|").alias("areas")
    )


# --- change detection --------------------------------------------------------


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged like the typed rows."""
    return keep(ingest.upsert_classify(fx.records(spark, sf_dir)), "classified")


@query("upsert_classify")
def upsert_classify(spark, sf_dir):
    return ingest.upsert_classify(fx.records(spark, sf_dir)).drop("part")


@query("upsert_classify_hot")
def upsert_classify_hot(spark, sf_dir):
    """The same rows with a bound so low that many keys are cut into pieces."""
    return ingest.upsert_classify(fx.records(spark, sf_dir), hot_rows=3).drop("part")


@query("upsert_classify_existing")
def upsert_classify_existing(spark, sf_dir):
    rows = fx.records(spark, sf_dir)
    stored = ingest.upsert_latest(rows.where("batch_no <= 3"), run_at=RUN_AT)
    return ingest.upsert_classify(rows.where("batch_no > 3"), stored).drop("part")


@query("upsert_classify_null_safe")
def upsert_classify_null_safe(spark, sf_dir):
    return ingest.upsert_classify(fx.records(spark, sf_dir), null_safe_key=True).drop("part")


@query("upsert_latest")
def upsert_latest(spark, sf_dir):
    return _state(ingest.upsert_latest(fx.records(spark, sf_dir), run_at=RUN_AT))


@query("conflicts")
def conflicts(spark, sf_dir):
    return ingest.conflicts(_classified(spark, sf_dir)).drop("part")


@query("first_conflicts")
def first_conflicts(spark, sf_dir):
    return ingest.first_conflicts(_classified(spark, sf_dir)).drop("part")


@query("batch_outcomes")
def batch_outcomes(spark, sf_dir):
    return ingest.batch_outcomes(_classified(spark, sf_dir))


@query("stop_on_all_duplicates")
def stop_on_all_duplicates(spark, sf_dir):
    rows = keep(ingest.project_record(fx.raw_with_stop(spark, sf_dir)), "typed")
    outcomes = keep(ingest.batch_outcomes(ingest.upsert_classify(rows)), "outcomes")
    return ingest.stop_on_all_duplicates(outcomes, outcomes, over=10)


@query("run_totals")
def run_totals(spark, sf_dir):
    rows = keep(ingest.project_record(fx.raw_with_stop(spark, sf_dir)), "typed")
    outcomes = keep(ingest.batch_outcomes(ingest.upsert_classify(rows)), "outcomes")
    kept = ingest.stop_on_all_duplicates(rows, outcomes, over=10)
    state = ingest.upsert_latest(kept, run_at=RUN_AT)
    return ingest.run_totals(outcomes, rows.select("batch_no"), state, over=10)


@query("stop_on_gap")
def stop_on_gap(spark, sf_dir):
    """Batch numbers from 5 on moved up by one, so batch 5 never landed."""
    raw = fx.raw_batches(spark, sf_dir)
    number = F.col("batch_no") + F.when(F.col("batch_no") >= 5, 1).otherwise(0)
    landed = raw.withColumn("batch_no", number.cast("int"))
    manifest = landed.groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"))
    return ingest.stop_on_gap(manifest, max_years=13)


@query("seq_in_batch")
def seq_in_batch(spark, sf_dir):
    return ingest.seq_in_batch(fx.records(spark, sf_dir), hot_rows=1000).select(
        "batch_no", "seq", "row"
    )


def _repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(duplicates.inspect_duplicates(fx.records(spark, sf_dir)), "repeats")


@query("inspect_duplicates")
def inspect_duplicates(spark, sf_dir):
    return duplicates.inspect_duplicates(fx.records(spark, sf_dir))


@query("inspect_duplicates_hot")
def inspect_duplicates_hot(spark, sf_dir):
    return duplicates.inspect_duplicates(fx.records(spark, sf_dir), hot_rows=3)


@query("duplicate_summary")
def duplicate_summary(spark, sf_dir):
    return duplicates.duplicate_summary(_repeats(spark, sf_dir))


@query("first_duplicates")
def first_duplicates(spark, sf_dir):
    return duplicates.first_duplicates(_repeats(spark, sf_dir))


# --- polygons ----------------------------------------------------------------


@query("explode_features")
def explode_features(spark, sf_dir):
    df = _features(spark, sf_dir)
    return df.select("ma_name", F.explode("properties").alias("property", "value"))


@query("explode_vertices")
def explode_vertices(spark, sf_dir):
    df = areas.explode_vertices(_features(spark, sf_dir))
    return df.select("ma_name", "lon", "lat")


@query("map_extent")
def map_extent(spark, sf_dir):
    return areas.map_extent(_features(spark, sf_dir))


@query("feature_stats")
def feature_stats(spark, sf_dir):
    """Count and property names; which feature comes first is up to the files."""
    return areas.feature_stats(_features(spark, sf_dir)).select("features", "pos", "key")


@query("choropleth")
def choropleth(spark, sf_dir):
    spec = FilterSpec("1997", "1999", PICKED)
    return map_page(
        fx.survey(spark, sf_dir),
        fx.area_features(spark, sf_dir),
        fx.nation_customs(spark, sf_dir),
        spec,
    ).drop("geometry")


# --- reshapes ----------------------------------------------------------------


@query("area_lookup")
def area_lookup(spark, sf_dir):
    lookup = series.area_lookup(aggregates.map_data(fx.survey(spark, sf_dir)))
    return lookup.select("area", "figures.total", "figures.surveys")


@query("trend_series")
def trend_series(spark, sf_dir):
    spec = FilterSpec(time_unit="weekly", species=("chinook", "sockeye", "halibut"))
    trend = aggregates.trend(fx.survey(spark, sf_dir), spec)
    return series.trend_series(trend, spec.species_names, spec.time_unit)


@query("species_series")
def species_series(spark, sf_dir):
    return series.species_series(aggregates.species(fx.survey(spark, sf_dir)))


@query("area_series")
def area_series(spark, sf_dir):
    return series.area_series(aggregates.areas(fx.survey(spark, sf_dir)))


@query("monthly_series")
def monthly_series(spark, sf_dir):
    return series.monthly_series(aggregates.monthly(fx.survey(spark, sf_dir)))


# --- refresh and composites --------------------------------------------------


@query("refresh_due")
def refresh_due_query(spark, sf_dir):
    """Three points in time against the log: 23 hours on, 24 hours on, and no log at all."""
    log = fx.run_log(spark, sf_dir)
    newest = run_log.scan_metadata(log).scalar()
    hour = F.expr("INTERVAL 1 HOUR")
    cases = {
        "23 hours": refresh_due(log, newest + hour * 23),
        "24 hours": refresh_due(log, newest + hour * 24),
        "never": refresh_due(log.where(F.col("key") == "none"), newest),
    }
    text = "yyyy-MM-dd HH:mm:ss"
    rows = [
        df.select(
            F.lit(name).alias("case"),
            "due",
            F.date_format("next_update_available", text).alias("next_update"),
            "message",
        )
        for name, df in cases.items()
    ]
    return rows[0].union(rows[1]).union(rows[2])


@query("refresh")
def refresh_query(spark, sf_dir):
    """CSV files to table, end to end; a second call in the same day does nothing."""
    paths = Paths(
        landing=_landed(spark, sf_dir),
        store=scratch_path(spark, "store"),
        log=scratch_path(spark, "log"),
        snapshots=scratch_path(spark, "snapshots"),
    )
    for _ in range(2):
        done = refresh(spark, paths, RUN_AT)
        if not done["success"]:
            raise RuntimeError(done["message"])
    return _state(store.scan_store(spark, paths.store))


@query("stream_refresh")
def stream_refresh_query(spark, sf_dir):
    """The same files through the file stream, in micro-batches."""
    base = scratch_path(spark, "stream")
    stream = stream_refresh(
        spark, _landed(spark, sf_dir), f"{base}/store", f"{base}/log", f"{base}/checkpoint"
    )
    stream.awaitTermination()
    return _state(store.scan_store(spark, f"{base}/store"))


@query("dashboard")
def dashboard(spark, sf_dir):
    return page_long(fx.survey(spark, sf_dir), FilterSpec("1996", "2000", time_unit="weekly"))


@query("dashboard_stored")
def dashboard_stored(spark, sf_dir):
    """The page of ``dashboard`` from the rollup, after the table was loaded in three steps.

    The first step holds other figures for the years that the second replaces.
    """
    path, rows = scratch_path(spark, "store"), fx.survey(spark, sf_dir)
    early = F.col("sample_date") < "F"
    store.sink_store(rows.withColumns({"coho": F.lit(1.0), "chum": F.lit(None).cast("double")}), path)
    store.sink_store(rows.where(early), path)
    store.sink_store(rows, path)
    spec = FilterSpec("1996", "2000", time_unit="weekly")
    return long_form(stored_dashboard(spark, path, spec), spec)


@query("collection_report")
def collection_report(spark, sf_dir):
    return report_long(fx.survey(spark, sf_dir))

from datetime import datetime

import pytest
from helpers import (
    incoming,
    load_row_by_row,
    random_rows,
    state_of,
    statuses_of,
)
from pyspark.sql import functions as F

from tidetally.operators import duplicates, ingest, skew
from tidetally.schema import KEY

AT = datetime(2025, 6, 1)
LATER = datetime(2025, 6, 2)
K = ("Apr 1, 2013", "Ramp 1", "", 1, 2)
LOOSE = ("Apr 1, 2013", "Ramp 1", "", 1, None)


def test_a_b_a_a(spark):
    rows = [(1, i, K, v) for i, v in enumerate([1, 2, 1, 1])]
    got = statuses_of(ingest.upsert_classify(incoming(spark, rows)))
    assert list(got.values()) == ["inserted", "updated", "updated", "duplicate"]


def test_null_key_parts(spark):
    rows = [(1, 0, LOOSE, 1), (1, 1, LOOSE, 1)]
    df = incoming(spark, rows)
    assert set(statuses_of(ingest.upsert_classify(df)).values()) == {"inserted"}
    assert ingest.upsert_latest(df, run_at=AT).count() == 2
    matched = ingest.upsert_classify(df, null_safe_key=True)
    assert sorted(statuses_of(matched).values()) == ["duplicate", "inserted"]
    assert ingest.upsert_latest(df, run_at=AT, null_safe_key=True).count() == 1
    repeats = duplicates.inspect_duplicates(df).collect()
    assert [(r.row, r.first_row, r.same_data) for r in repeats] == [(2, 1, True)]


@pytest.mark.parametrize("hot_rows", [1, 2, 7, 1_000_000])
@pytest.mark.parametrize("null_safe", [False, True])
def test_classify_equals_the_row_loop(spark, hot_rows, null_safe):
    rows = random_rows(hot_rows)
    got = ingest.upsert_classify(incoming(spark, rows), None, null_safe, hot_rows)
    assert statuses_of(got) == load_row_by_row(rows, null_safe=null_safe)[0]


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_second_load_equals_the_row_loop(spark, hot_rows):
    first, second = random_rows(11), random_rows(12, keys=20)
    _, table, loose = load_row_by_row(first)
    stored = ingest.upsert_latest(incoming(spark, first), run_at=AT)
    assert state_of(stored) == sorted([*table.items(), *loose], key=repr)

    statuses, table, more = load_row_by_row(second, table)
    df = incoming(spark, second)
    assert statuses_of(ingest.upsert_classify(df, stored, hot_rows=hot_rows)) == statuses
    state = ingest.upsert_latest(df, stored, LATER)
    assert state_of(state) == sorted([*table.items(), *loose, *more], key=repr)


def test_times_of_a_record(spark):
    """Created with the first row; updated moves only on a change."""
    other = ("Apr 2, 2013", "Ramp 1", "", 1, 2)
    stored = ingest.upsert_latest(
        incoming(spark, [(1, 0, K, 1), (1, 1, other, 1), (1, 2, other, 5)]), run_at=AT
    )
    second = incoming(spark, [(1, 0, K, 2), (1, 1, other, 5)])
    state = {
        r.sample_date: r for r in ingest.upsert_latest(second, stored, LATER).collect()
    }
    assert state["Apr 1, 2013"].created_at == AT and state["Apr 1, 2013"].updated_at == LATER
    assert state["Apr 2, 2013"].created_at == AT
    assert AT < state["Apr 2, 2013"].updated_at < LATER


def test_conflict_log(spark):
    rows = [(1, i, K, v) for i, v in enumerate(range(15))]
    classified = ingest.upsert_classify(incoming(spark, rows))
    log = ingest.conflicts(classified).orderBy("seq").collect()
    assert [(r.old_hash, r.new_hash) for r in log] == [(str(i), str(i + 1)) for i in range(14)]
    assert {r.catch_area for r in log} == {"N/A"}
    shown = ingest.first_conflicts(classified, 10).collect()
    assert sorted(r.seq for r in shown) == list(range(1, 11)) and {r.more for r in shown} == {4}
    few = ingest.first_conflicts(classified.where("seq < 3"), 10).collect()
    assert [r.more for r in few] == [0, 0]


def outcomes(spark, rows):
    return spark.createDataFrame(
        rows, "batch_no int, total bigint, new bigint, updated bigint, duplicates bigint"
    )


def test_stop_after_an_all_duplicate_batch(spark):
    found = outcomes(
        spark,
        [(1, 200, 200, 0, 0), (2, 100, 0, 0, 100), (3, 101, 0, 0, 101), (4, 10, 10, 0, 0)],
    )
    kept = ingest.stop_on_all_duplicates(found, found)
    assert sorted(r.batch_no for r in kept.collect()) == [1, 2, 3]
    assert ingest.stop_on_all_duplicates(found, found, over=None).count() == 4
    assert ingest.stop_on_all_duplicates(found, found, over=99).count() == 2
    state = spark.range(7)
    totals = ingest.run_totals(found, found, state).first()
    assert tuple(totals) == (7, 200, 0, 201, 2)
    totals = ingest.run_totals(found, found, state, over=None).first()
    assert tuple(totals) == (7, 210, 0, 201, 4)


def test_stop_on_gap(spark):
    def kept(numbers, max_years=13):
        manifest = spark.createDataFrame([(n,) for n in numbers], "batch_no int")
        return sorted(r.batch_no for r in ingest.stop_on_gap(manifest, max_years).collect())

    assert kept([1, 2, 4]) == [1, 2]
    assert kept([2, 3]) == []
    assert kept([1, 2, 3, 4], max_years=3) == [1, 2, 3]
    assert kept([]) == []


@pytest.mark.parametrize("hot_rows", [1, 4, 1_000_000])
def test_row_numbers(spark, hot_rows):
    rows = random_rows(5)
    numbered = ingest.seq_in_batch(incoming(spark, rows), hot_rows).collect()
    expected, seen = {}, {}
    for batch_no, seq, *_ in rows:
        seen[batch_no] = seen.get(batch_no, 0) + 1
        expected[batch_no, seq] = seen[batch_no]
    assert {(r.batch_no, r.seq): r.row for r in numbered} == expected


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_repeats_equal_the_row_loop(spark, hot_rows):
    rows = random_rows(6)
    got = {
        (r.batch_no, r.row): (r.first_row, r.same_data)
        for r in duplicates.inspect_duplicates(incoming(spark, rows), hot_rows).collect()
    }
    expected, first, place = {}, {}, {}
    for batch_no, _, key, value in rows:
        place[batch_no] = row = place.get(batch_no, 0) + 1
        if (batch_no, key) in first:
            first_row, first_value = first[batch_no, key]
            expected[batch_no, row] = (first_row, first_value == value)
        else:
            first[batch_no, key] = (row, value)
    assert got == expected


def test_first_repeats_and_summary(spark):
    rows = [(1, i, K, 1) for i in range(9)] + [(1, 9, K, 2)]
    repeats = duplicates.inspect_duplicates(incoming(spark, rows))
    assert tuple(duplicates.duplicate_summary(repeats).first()) == (1, 8, 1)
    shown = duplicates.first_duplicates(repeats).collect()
    assert [(r.row, r.more) for r in shown if r.same_data] == [(i, 3) for i in range(2, 7)]
    assert [(r.row, r.more) for r in shown if not r.same_data] == [(10, 0)]


def test_key_match(spark):
    first, second = random_rows(21), random_rows(22, keys=20)
    table = load_row_by_row(first)[1]
    stored = ingest.upsert_latest(incoming(spark, first), run_at=AT)
    got = ingest.key_match(incoming(spark, second), stored).collect()
    assert len(got) == len(second)
    found = {(r.batch_no, r.seq): r.stored_hash for r in got}
    for batch_no, seq, key, _ in second:
        value = None if None in key else table.get(key)
        assert found[batch_no, seq] == (None if value is None else str(value))


def test_hot_keys_are_split_and_others_are_not(spark):
    df = incoming(spark, random_rows(8))
    cut, any_hot = skew.with_piece(df, KEY, 60, F.lit(False))
    assert any_hot and cut.count() == df.count()
    assert cut.where("piece IS NOT NULL").select(*KEY).distinct().count() == 1
    assert cut.where("piece IS NULL").groupBy(*KEY).count().agg(F.max("count")).first()[0] <= 60
    assert not skew.with_piece(df, KEY, 10**6, F.lit(False))[1]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classify_moves_the_rows_once(spark, tmp_path):
    """One scan, one exchange, one window; with hot keys one more scan for their pieces' last rows."""
    incoming(spark, random_rows(9)).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    plan = plan_of(ingest.upsert_classify(df))
    assert [plan.count(x) for x in ("FileScan", "Exchange", "Window ")] == [1, 1, 1]
    plan = plan_of(ingest.upsert_classify(df, hot_rows=60))
    assert plan.count("FileScan") == 2 and plan.count("Window ") == 2


def test_rows_that_count_up_are_numbered_where_they_lie(spark, tmp_path):
    rows = [(b, p, 100 * p + i, *K, "1") for b in (1, 2) for p in (3, 4) for i in range(50)]
    schema = "batch_no int, part string, seq bigint, " + ", ".join(
        f"{name} {'bigint' if name in ('interviews', 'anglers') else 'string'}" for name in KEY
    )
    df = spark.createDataFrame(rows, f"{schema}, data_hash string")
    df.write.parquet(str(tmp_path / "rows"))
    numbered = ingest.seq_in_batch(spark.read.parquet(str(tmp_path / "rows")))
    plan = plan_of(numbered)
    rows_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in plan and "Exchange hash" not in rows_side and "Window" not in rows_side
    got = sorted((r.batch_no, r.part, r.seq, r.row) for r in numbered.collect())
    assert got == [(b, str(p), 100 * p + i, 50 * (p - 3) + i + 1) for b in (1, 2) for p in (3, 4) for i in range(50)]


def test_project_record_binds_by_header(spark):
    raw = spark.createDataFrame(
        [(1, "", 0, " N/A ", "3", " Ramp", "1.5", "Apr 1, 2013", None)],
        "batch_no int, part string, seq bigint, `Catch area` string, Anglers string,"
        " `Ramp/site` string, Chinook string, `Sample date` string, Coho string",
    )
    row = ingest.project_record(raw).first()
    assert tuple(row[k] for k in KEY) == ("Apr 1, 2013", " Ramp", "", None, 3)
    assert (row.chinook, row.coho, row.halibut) == (1.5, None, None)

import random
from datetime import datetime, timedelta

import pytest
from helpers import records, state_of

from tidetally.operators import key_filter
from tidetally.plans import refresh as plan
from tidetally.plans.refresh import Paths, refresh, refresh_due
from tidetally.schema import KEY
from tidetally.sources import csv_batches, run_log, snapshots, store, versions
from tidetally.sources.store import scan_store
from tidetally.streaming import landing as stream
from tidetally.streaming.landing import stream_refresh

HEAD = "Sample date,Ramp/site,Catch area,# Interviews (Boat or Shore),Anglers,Chinook\n"
AT = datetime(2025, 6, 1, 12)


def land(folder, batch_no, rows, name=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / f"{name or 'export'}_sample_date={batch_no}.csv"
    path.write_text(HEAD + "".join(f'"{d}",{r},{a},{i},{n},{c}\n' for d, r, a, i, n, c in rows))


@pytest.fixture
def paths(tmp_path):
    names = ("landing", "store", "log", "snapshots")
    return Paths(**{name: str(tmp_path / name) for name in names})


def test_due(spark, tmp_path):
    path = str(tmp_path / "log")
    never = refresh_due(run_log.scan_log(spark, path), AT).first()
    assert (never.due, never.last_update, never.message) == (True, None, None)
    run_log.sink_metadata(spark, path, AT)
    log = run_log.scan_log(spark, path)
    soon = refresh_due(log, AT + timedelta(hours=23)).first()
    assert (soon.due, soon.next_update_available) == (False, AT + timedelta(days=1))
    assert soon.message == "Data is current (updated 23.0 hours ago)"
    assert refresh_due(log, AT + timedelta(hours=24)).first().due


def test_due_in_another_session_zone(spark, tmp_path):
    path = str(tmp_path / "log")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        run_log.sink_metadata(spark, path, AT)
        row = refresh_due(run_log.scan_log(spark, path), AT + timedelta(hours=23)).first()
        assert (row.due, row.last_update) == (False, AT)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_refresh(spark, paths, tmp_path):
    landing = tmp_path / "landing"
    land(landing, 1, [("Apr 1, 2013", "R", "N/A", 1, 2, 3), ("Apr 1, 2013", "R", "", 1, "", 3)])
    land(landing, 2, [("", "R", "A", 1, 2, 4)])
    land(landing, 4, [("Apr 1, 2010", "R", "A", 1, 2, 4)])
    done = refresh(spark, paths, AT)
    assert done["success"] and done["should_reload"], done
    assert (done["records"], done["new"], done["updated"], done["years_fetched"]) == (3, 3, 0, 2)
    assert done["message"] == "Data updated successfully. Total records: 3"

    current = refresh(spark, paths, AT + timedelta(hours=5))
    assert current["message"] == "Data is current (updated 5.0 hours ago)"
    assert not current["should_reload"]
    assert current["next_update_available"] == (AT + timedelta(days=1)).isoformat()

    # A correction, a new year, and the row without anglers once more.
    land(landing, 1, [("Apr 1, 2013", "R", "", 1, 2, 9), ("Apr 1, 2013", "R", "", 1, "", 3)])
    land(landing, 2, [("", "R", "A", 1, 2, 4), ("Jul 1, 2014", "R", "A", 1, 2, 1)])
    done = refresh(spark, paths, AT + timedelta(days=1))
    assert (done["records"], done["new"], done["updated"], done["duplicates"]) == (5, 2, 1, 1)
    table = scan_store(spark, paths.store)
    assert state_of(table) == [
        (("", "R", "A", 1, 2), 4),
        (("Apr 1, 2013", "R", "", 1, 2), 9),
        (("Apr 1, 2013", "R", "", 1, None), 3),
        (("Apr 1, 2013", "R", "", 1, None), 3),
        (("Jul 1, 2014", "R", "A", 1, 2), 1),
    ]
    assert table.where("updated_at > created_at").count() == 1

    fresh = str(tmp_path / "fresh")
    assert snapshots.snapshot_restore(spark, fresh, paths.snapshots)
    assert state_of(scan_store(spark, fresh)) == state_of(table)


def test_all_duplicate_batch_ends_the_refresh(spark, paths, tmp_path):
    landing = tmp_path / "landing"
    rows = [("Apr 1, 2013", f"R{i}", "A", 1, 2, 3) for i in range(4)]
    land(landing, 1, rows)
    land(landing, 2, rows)
    land(landing, 3, [("Apr 1, 2011", "R", "A", 1, 2, 3)])
    done = refresh(spark, paths, AT, over=3)
    assert (done["records"], done["duplicates"], done["years_fetched"]) == (4, 4, 1)


def test_null_safe_refresh_can_be_repeated(spark, paths, tmp_path):
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, "", 3)])
    for day in range(2):
        done = refresh(spark, paths, AT + timedelta(days=day), null_safe_key=True)
        assert done["records"] == 1


def test_failed_refresh_is_not_logged(spark, paths, tmp_path, monkeypatch):
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 1, 3)])

    def broken(*_):
        raise OSError("disk")

    monkeypatch.setattr(plan, "publish", broken)
    done = refresh(spark, paths, AT)
    assert not done["success"] and done["message"] == "Error updating data: disk"
    monkeypatch.undo()
    assert refresh(spark, paths, AT + timedelta(hours=1))["records"] == 1


def run(spark, base, **options):
    stream_refresh(
        spark,
        str(base / "landing"),
        str(base / "store"),
        str(base / "log"),
        str(base / "checkpoint"),
        **options,
    ).awaitTermination()
    return state_of(scan_store(spark, str(base / "store")))


def test_stream_applies_each_file_once(spark, tmp_path):
    loose = ("Apr 1, 2013", "R", "", 1, "", 3)
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 2, 3), loose], "a")
    first = run(spark, tmp_path)
    assert len(first) == 2
    assert run(spark, tmp_path) == first
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 2, 8), loose], "b")
    land(tmp_path / "landing", 2, [("May 1, 2012", "R", "", 1, 2, 1)], "b")
    assert run(spark, tmp_path, per_trigger=1) == [
        (("Apr 1, 2013", "R", "", 1, 2), 8),
        (("Apr 1, 2013", "R", "", 1, None), 3),
        (("Apr 1, 2013", "R", "", 1, None), 3),
        (("May 1, 2012", "R", "", 1, 2), 1),
    ]


def test_replayed_stream_batch_is_not_applied_twice(spark, tmp_path, monkeypatch):
    """Dies after the table was replaced but before that was logged."""
    loose = ("Apr 1, 2013", "R", "", 1, "", 3)
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 2, 3), loose])

    def dies(*args):
        store.publish(*args)
        raise OSError("gone")

    monkeypatch.setattr(stream, "publish", dies)
    with pytest.raises(Exception, match="gone"):
        run(spark, tmp_path)
    monkeypatch.undo()
    assert len(run(spark, tmp_path)) == 2


def summary(done):
    return {k: v for k, v in done.items() if k not in ("last_update", "next_update_available")}


def test_unchanged_files_are_not_parsed_again(spark, paths, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    for batch, year in ((1, 2013), (2, 2012), (3, 2011)):
        land(landing, batch, [(f"Apr {d}, {year}", "R", "A", 1, 2, d) for d in range(1, 9)])
    (landing / "x_sample_date=4.csv").write_text("")
    refresh(spark, paths, AT, over=None)

    def parsed(manifest):
        return sorted(r.batch_no for r in manifest.collect())

    read = []

    def counting(spark, manifest):
        read.append(parsed(manifest))
        return csv_batches.scan_csv_batches(spark, manifest)

    monkeypatch.setattr(plan, "scan_csv_batches", counting)
    again = refresh(spark, paths, AT + timedelta(days=1), over=None)
    assert read == [] and versions.latest(spark, paths.store).number == 2
    assert (again["records"], again["new"], again["duplicates"], again["years_fetched"]) == (24, 0, 24, 4)
    # The rule that ends a load sees the batches that were not parsed.
    ended = refresh(spark, paths, AT + timedelta(days=2), over=5)
    assert read == [] and (ended["duplicates"], ended["years_fetched"]) == (8, 0)
    # A correction: its batch alone is parsed, and once more as its rows replaced some.
    land(landing, 2, [(f"Apr {d}, 2012", "R", "A", 1, 2, 9) for d in range(1, 9)])
    for day in (3, 4, 5):
        done = refresh(spark, paths, AT + timedelta(days=day), over=None)
    assert read == [[2], [2]] and done["duplicates"] == 24
    # Batch 3 now also has rows of 2013: batch 1 has to be looked at with it.
    land(landing, 3, [("Apr 3, 2013", "R", "A", 1, 2, 77)])
    done = refresh(spark, paths, AT + timedelta(days=6), over=None)
    assert read[2:] == [[3], [1]] and (done["updated"], done["duplicates"]) == (1, 16)
    # Someone else changes the table: nothing is known any more.
    store.sink_store(scan_store(spark, paths.store).where("survey_year = '2012'"), paths.store)
    refresh(spark, paths, AT + timedelta(days=7), over=None)
    assert read[4] == [1, 2, 3, 4]


@pytest.mark.parametrize("seed", [2])
def test_skipping_files_changes_nothing(spark, tmp_path, monkeypatch, seed):
    """Random landings, each loaded with and without what is known of the batches."""
    draw = random.Random(seed)
    bases = {skip: tmp_path / str(skip) for skip in (True, False)}
    known = plan.known_batches
    landed = {}
    for day in range(3):
        for batch in (1, 2, 3):
            if day == 0 or draw.random() < 0.4:
                years = draw.choice([[2014 - batch], [2014 - batch], [2014 - batch, 2013], [""]])
                landed[batch] = [
                    (f"Apr {draw.randrange(1, 4)}, {y}" if y else "", "R", "A", 1, draw.choice([1, 2, 2, 2, ""] if draw.random() < 0.2 else [1, 2]), draw.randrange(3))
                    for y in years
                    for _ in range(draw.randrange(1, 5))
                ]
        results = []
        for skip, base in bases.items():
            for batch, rows in landed.items():
                land(base / "landing", batch, rows)
            names = ("landing", "store", "log")
            monkeypatch.setattr(plan, "known_batches", known if skip else lambda *_: {})
            own = Paths(**{name: str(base / name) for name in names})
            done = refresh(spark, own, AT + timedelta(days=day), over=None)
            table = scan_store(spark, own.store)
            moved = sorted(map(str, table.select("*").drop("data_hash").collect()))
            results.append((summary(done), state_of(table), moved))
        assert results[0] == results[1]


def test_a_refresh_overtaken_by_another_reports_it(spark, paths, tmp_path, monkeypatch):
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 1, 3)])
    publish = plan.publish

    def overtaken(spark, path, staged):
        other = store.stage_years(helpers_records(spark), path, versions.latest(spark, path))
        store.publish(spark, path, other)
        return publish(spark, path, staged)

    monkeypatch.setattr(plan, "publish", overtaken)
    done = refresh(spark, paths, AT)
    assert not done["success"] and "version" in done["message"]
    assert [r.sample_date for r in scan_store(spark, paths.store).collect()] == ["May 1, 2001"]
    monkeypatch.undo()
    assert refresh(spark, paths, AT)["records"] == 2


def helpers_records(spark):
    return records(spark, [{"sample_date": "May 1, 2001"}])


def test_stream_goes_on_from_what_another_run_published(spark, tmp_path, monkeypatch):
    land(tmp_path / "landing", 1, [("Apr 1, 2013", "R", "", 1, 2, 3)])
    calls = []

    def overtaken(spark, path, staged):
        if not calls:
            other = store.stage_years(helpers_records(spark), path, versions.latest(spark, path))
            store.publish(spark, path, other)
        calls.append(staged)
        return store.publish(spark, path, staged)

    monkeypatch.setattr(stream, "publish", overtaken)
    assert len(run(spark, tmp_path)) == 2 and len(calls) == 2


def test_digests(spark, tmp_path):
    lines = [f'"Apr 1, 2013",R{i},A,1,{i},3' for i in range(3000)]

    def digests(name, lines, parts=1, size="128m"):
        folder = tmp_path / name / "batch_no=1"
        folder.mkdir(parents=True)
        for k in range(parts):
            some = lines[k * len(lines) // parts : (k + 1) * len(lines) // parts]
            (folder / f"part-{k}-{name}.csv").write_text("\n".join(some) + "\n")
        (tmp_path / name / "sample_date=2.csv").write_text("")
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            return csv_batches.batch_digests(spark, csv_batches.list_batches(spark, str(tmp_path / name)))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    first = digests("a", lines, parts=2)
    assert set(first) == {1, 2} and first[2] == ""
    assert digests("b", lines, parts=2, size="2000") == first  # however it is split
    others = [digests("c", lines[::-1], 2), digests("d", [*lines[:-1], "x"], 2), digests("e", lines, 1)]
    swapped = [lines[1], lines[0], *lines[2:]]
    others.append(digests("f", swapped, 2))
    assert len({first[1], *(o[1] for o in others)}) == 5
    assert csv_batches.batch_digests(spark, csv_batches.list_batches(spark, str(tmp_path / "none"))) == {}


def test_stored_rows_pass_a_filter_before_they_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "store")
    many = [{"sample_date": "Apr 1, 2013", "ramp_site": f"R{i}", "interviews": 1, "anglers": 1} for i in range(4000)]
    store.sink_store(records(spark, many), path)
    table = scan_store(spark, path)
    some = table.where("ramp_site IN ('R1', 'R17', 'R3999')")
    made = key_filter.key_filter(some, KEY, 3)
    marked = key_filter.with_possible(table, KEY, made, "possible")
    hits = {r.ramp_site for r in marked.where("possible").collect()}
    assert {"R1", "R17", "R3999"} <= hits and len(hits) < 30
    shuffled = marked.where("possible").groupBy(*KEY).count()
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    # The stored rows meet the filter below the one exchange of rows.
    below = plan[plan.index("Exchange hashpartitioning") :]
    assert "BroadcastHashJoin" in below and plan.count("Exchange hashpartitioning") == 1
    nothing = key_filter.key_filter(table.limit(0), KEY, 0)
    assert key_filter.with_possible(table, KEY, nothing, "possible").where("possible").count() == 0
    assert key_filter.key_filter(table, KEY, 1 << 25) is None
    loose = records(spark, [{"sample_date": "Apr 1, 2013"}])
    assert key_filter.with_possible(loose, KEY, key_filter.key_filter(loose, KEY, 1), "p").where("p").count() == 1


def test_changes_of_a_load_are_not_broadcast(spark, paths):
    """As Parquet their positions look small, whatever their number."""
    some = [
        {"sample_date": "Apr 1, 2013", "ramp_site": f"R{n}", "interviews": 1, "anglers": n}
        for n in range(50)
    ]
    rows = plan.project_record(
        records(spark, some)
        .selectExpr(
            "1 AS batch_no",
            "'p' AS part",
            "anglers AS seq",
            "sample_date AS `Sample date`",
            "ramp_site AS `Ramp/site`",
            "interviews AS `# Interviews (Boat or Shore)`",
            "anglers AS Anglers",
        )
    )
    incoming = store.with_survey_year(rows)
    stored = store.with_survey_year(records(spark, some[:5]))
    classified = store.with_survey_year(plan.upsert_classify(rows))
    state = plan._changed_state(incoming, stored, classified, AT, False)
    joins = [
        line
        for line in state._jdf.queryExecution().sparkPlan().toString().splitlines()
        if "LeftSemi" in line
    ]
    assert joins and not any("Broadcast" in line for line in joins)
    assert state.count() == 50

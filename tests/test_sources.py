import json
from datetime import datetime

import pytest
from helpers import records
from pyspark.sql import functions as F

from tidetally.operators import areas
from tidetally.operators.ingest import project_record, stop_on_gap
from tidetally.sources import csv_batches, export, features, run_log, snapshots, store, versions

AT = datetime(2025, 6, 1, 12)
HEAD = "Sample date,Ramp/site,Catch area,# Interviews (Boat or Shore),Anglers,Chinook,Coho"


def land(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def scan(spark, folder, **options):
    manifest = csv_batches.list_batches(spark, str(folder))
    return csv_batches.scan_csv_batches(spark, manifest, **options)


def test_columns_are_bound_by_each_batch_header(spark, tmp_path):
    land(tmp_path, "sample_date=1.csv", f'{HEAD}\n"Apr 1, 2013",R1,A,1,2,3,4\n')
    land(tmp_path, "sample_date=2.csv", 'Coho,Sample date,Anglers\n9,"May 1, 2012",7\n')
    rows = {r.batch_no: r for r in project_record(scan(spark, tmp_path)).collect()}
    assert (rows[1].sample_date, rows[1].chinook, rows[1].coho) == ("Apr 1, 2013", 3.0, 4.0)
    assert (rows[2].sample_date, rows[2].anglers, rows[2].coho) == ("May 1, 2012", 7, 9.0)
    assert (rows[2].ramp_site, rows[2].catch_area, rows[2].interviews) == ("", "", None)


def test_quotes_newlines_and_empty_batches(spark, tmp_path):
    land(tmp_path, "sample_date=1.csv", f'{HEAD}\n"Apr 1, 2013","R ""x""\ny",A,1,2,3,4\n')
    land(tmp_path, "sample_date=2.csv", "")
    land(tmp_path, "sample_date=3.csv", f"{HEAD}\n")
    land(tmp_path, "readme.txt", "no batch")
    manifest = csv_batches.list_batches(spark, str(tmp_path))
    assert sorted(r.batch_no for r in manifest.collect()) == [1, 2, 3]
    assert stop_on_gap(manifest, 13).count() == 3
    assert [r["Ramp/site"] for r in scan(spark, tmp_path).collect()] == ['R "x"\ny']
    # Too large to be read whole, but not safe to split.
    assert scan(spark, tmp_path, split_over=1).count() == 1


def test_split_read_keeps_file_order(spark, tmp_path):
    lines = [f'"Apr 1, 2013",R{i},A,1,{i},3,4' for i in range(4000)]
    land(tmp_path, "batch_no=1/b.csv", "\n".join([HEAD, *lines[2000:]]) + "\n")
    land(tmp_path, "batch_no=1/a.csv", "\n".join([HEAD, *lines[:2000]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        for over in (1, 10**9):
            df = scan(spark, tmp_path, split_over=over)
            parts = df.select("part").distinct().count()
            assert parts > 2 if over == 1 else parts == 2
            ordered = df.orderBy("batch_no", "part", "seq").collect()
            assert [r["Anglers"] for r in ordered] == [str(i) for i in range(4000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_part_files_with_another_header_are_refused(spark, tmp_path):
    land(tmp_path, "batch_no=1/a.csv", f"{HEAD}\nd,R,A,1,2,3,4\n")
    land(tmp_path, "batch_no=1/b.csv", "Coho,Chinook,Sample date,Ramp/site,x,y,z\n1,2,d,R,1,2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan(spark, tmp_path).collect()


def test_many_files_are_one_read(spark, tmp_path):
    """Whatever the number of files and headers."""
    for k in range(40):
        text = f'{HEAD}\n"Apr {k}, 2013","R\n{k}",A,1,2,3,4\n' if k % 2 else f'Coho,extra,Sample date,Coho\n9,"x,y",d{k},8\n'
        land(tmp_path, f"f{k}_sample_date={k}.csv", text)
    df = scan(spark, tmp_path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    rows = {r.batch_no: r for r in df.collect()}
    assert len(rows) == 40
    assert rows[3]["Ramp/site"] == "R\n3" and rows[3]["Coho"] == "4" and rows[3]["Anglers"] == "2"
    # A name that occurs twice is not bound, as in Spark's own reader.
    assert rows[4]["Sample date"] == "d4" and rows[4]["Coho"] is None and rows[4]["Anglers"] is None


def test_headers_with_line_breaks_and_blank_lines(spark, tmp_path):
    land(tmp_path / "a", "sample_date=1.csv", '"Sample\n date",Coho\n"a\nb",1\n')
    land(tmp_path / "a", "sample_date=2.csv", "\n\nANGLERS,coho\n5,2\n\n6\n")
    land(tmp_path / "b", "sample_date=2.csv", "\n\nANGLERS,coho\n5,2\n\n6\n7,8,9\n")
    assert sorted(r["Coho"] or "" for r in scan(spark, tmp_path / "a").collect()) == ["", "1", "2"]
    got = [(r["Anglers"], r["Coho"]) for r in scan(spark, tmp_path / "b").orderBy("seq").collect()]
    assert got == [("5", "2"), ("6", None), ("7", "8")]


def test_nothing_landed(spark, tmp_path):
    assert scan(spark, tmp_path / "none").count() == 0


def test_store_replaces_touched_years_only(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.scan_store(spark, path).count() == 0
    assert store.init_store(spark, path).count() == 0
    first = [{"sample_date": d, "coho": 1.0} for d in ("Apr 1, 2013", "Apr 1, 2014", "")]
    store.sink_store(records(spark, first), path)
    again = store.scan_store(spark, path).where("survey_year = '2013'").withColumn(
        "coho", F.lit(5.0)
    )
    store.sink_store(again, path)
    found = {r.survey_year: r.coho for r in store.init_store(spark, path).collect()}
    assert found == {"2013": 5.0, "2014": 1.0, "_other": 1.0}
    assert versions.latest(spark, path).number == 3


def test_readers_see_one_version(spark, tmp_path):
    """While two years are replaced, a reader has the old two until both are new."""
    path = str(tmp_path / "store")
    both = [{"sample_date": d, "coho": 1.0} for d in ("Apr 1, 2013", "Apr 1, 2014")]
    base = store.sink_store(records(spark, both), path)
    old = store.scan_store(spark, path)
    new = store.scan_store(spark, path).withColumn("coho", F.lit(2.0))
    staged = store.stage_years(new, path, base)
    assert [r.coho for r in store.scan_store(spark, path).collect()] == [1.0, 1.0]
    store.publish(spark, path, staged)
    assert [r.coho for r in store.scan_store(spark, path).collect()] == [2.0, 2.0]
    assert [r.coho for r in old.collect()] == [1.0, 1.0]
    # Published once more, nothing happens.
    assert store.publish(spark, path, staged).number == versions.latest(spark, path).number == 2


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    base = store.sink_store(records(spark, [{"sample_date": "Apr 1, 2013", "coho": 1.0}]), path)
    one, two = (
        store.stage_years(records(spark, [{"sample_date": "Apr 1, 2013", "coho": c}]), path, base)
        for c in (2.0, 3.0)
    )
    store.publish(spark, path, one)
    with pytest.raises(versions.StaleVersion):
        store.publish(spark, path, two)
    assert [r.coho for r in store.scan_store(spark, path).collect()] == [2.0]
    # Both may have looked before either wrote: the number can be taken only once.
    taken = versions.latest(spark, path)
    with pytest.raises(versions.StaleVersion):
        versions.commit(spark, path, taken)
    assert versions.latest(spark, path) == taken
    assert not list((tmp_path / "store" / "versions").glob(".*.part"))


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert run_log.scan_metadata(run_log.scan_log(spark, path)).first().last_update is None
    for day in (2, 3, 1):
        run_log.sink_metadata(spark, path, AT.replace(day=day))
    log = run_log.scan_log(spark, path)
    assert run_log.scan_metadata(log).first().last_update == AT.replace(day=3)
    run_log.sink_metadata(spark, path, AT.replace(year=2030), value="soon")
    assert run_log.scan_metadata(run_log.scan_log(spark, path)).first().last_update is None


def written(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_snapshots(spark, tmp_path):
    path, uri, fresh = (str(tmp_path / name) for name in ("store", "copies", "fresh"))
    assert not snapshots.snapshot_save(spark, path, uri, AT)
    assert not snapshots.snapshot_restore(spark, fresh, uri)
    store.sink_store(records(spark, [{"sample_date": "Apr 1, 2013"}]), path)
    assert not snapshots.snapshot_save(spark, path, None, AT)
    assert snapshots.snapshot_save(spark, path, uri, AT)
    store.sink_store(records(spark, [{"sample_date": "Apr 1, 2014"}]), path)
    assert snapshots.snapshot_save(spark, path, uri, AT.replace(day=2))
    assert snapshots.snapshot_restore(spark, fresh, uri)
    assert store.scan_store(spark, fresh).count() == 2
    assert not snapshots.snapshot_restore(spark, fresh, uri)


def test_snapshots_copy_changed_years_only(spark, tmp_path):
    path, uri = str(tmp_path / "store"), str(tmp_path / "copies")
    years = range(2013, 2019)

    def rows(years, coho):
        return records(
            spark,
            [{"sample_date": f"Apr 1, {y}", "ramp_site": f"R{i}", "coho": coho} for y in years for i in range(200)],
        )

    def content(df):
        return sorted((r.sample_date, r.ramp_site, r.coho) for r in df.collect())

    want, sizes = [], []
    for day, (changed, coho) in enumerate([(years, 1.0), ([2014], 2.0), ([], 0.0), ([2014, 2019], 3.0)], 1):
        if changed:
            store.sink_store(rows(changed, coho), path)
        assert snapshots.snapshot_save(spark, path, uri, AT.replace(day=day))
        want.append(content(store.scan_store(spark, path)))
        sizes.append(written(tmp_path / "copies"))
    grown = [b - a for a, b in zip([0, *sizes], sizes)]
    assert grown[2] == 0 and grown[1] < grown[0] / 4 and grown[1] < grown[3] < grown[0] / 2
    listed = snapshots.list_snapshots(spark, uri)
    assert [v.at[:10] for v in listed] == [f"2025-06-0{d}" for d in range(1, 5)]
    for number, version in enumerate(listed):
        fresh = str(tmp_path / f"fresh{number}")
        assert snapshots.snapshot_restore(spark, fresh, uri, version)
        assert content(store.scan_store(spark, fresh)) == want[number]


def test_export_keeps_nulls_and_drops_internals(spark, tmp_path):
    df = records(spark, [{"sample_date": "Apr 1, 2013", "coho": 1.5, "data_hash": "x"}])
    path = export.export_json(df, str(tmp_path))
    assert path.split("/")[-1].startswith("survey_export_") and path.endswith(".json")
    line = json.loads(spark.read.text(path).first().value)
    assert line["coho"] == 1.5 and line["chinook"] is None and line["sample_date"] == "Apr 1, 2013"
    assert not {"data_hash", "created_at", "updated_at", "id"} & set(line)


RING = [[-1.0, 2.0], [3.0, 2.5], [0.0, -4.0], [-1.0, 2.0]]
FAR = [[10.0, 20.0], [11.0, 20.0], [10.0, 21.0], [10.0, 20.0]]


def feature(number, name, geometry, **more):
    properties = {"OBJECTID": 7, "maNumber": number, "maName": name, "WAC": None, **more}
    return {"type": "Feature", "properties": properties, "geometry": geometry}


def test_features(spark, tmp_path):
    land(
        tmp_path,
        "areas.json",
        json.dumps(
            {
                "type": "FeatureCollection",
                "features": [
                    feature("4", "East", {"type": "Polygon", "coordinates": [RING]}, a=1, b=2),
                    feature(5, "West", {"type": "MultiPolygon", "coordinates": [[RING], [FAR]]}),
                ],
            },
            indent=2,
        ),
    )
    df = features.scan_features(spark, str(tmp_path / "areas.json"))
    assert [(r.ma_number, r.ma_name, r.wac) for r in df.collect()] == [
        ("4", "East", None),
        ("5", "West", None),
    ]
    assert areas.explode_vertices(df).count() == 12
    assert tuple(areas.map_extent(df).first()) == (-1.0, -4.0, 11.0, 21.0)
    assert tuple(areas.map_extent(df.where("false")).first()) == (None,) * 4
    shown = areas.feature_stats(df).collect()
    assert [(r.features, r.key, r.value) for r in shown] == [
        (2, "OBJECTID", "7"),
        (2, "maNumber", "4"),
        (2, "maName", "East"),
        (2, "WAC", None),
        (2, "a", "1"),
    ]
    written = features.sink_features(df, str(tmp_path / "lines")).first()
    assert written.features == 2 and written.bytes > 200
    back = features.scan_features(spark, str(tmp_path / "lines"), one_per_line=True)
    columns = ["ma_number", "ma_name", "properties"]
    assert sorted(map(repr, back.select(columns).collect())) == sorted(
        map(repr, df.select(columns).collect())
    )
    assert areas.map_extent(back).first() == areas.map_extent(df).first()


def test_custom_areas(spark, tmp_path):
    named = {
        "Bellingham Bay": {
            "type": "Feature",
            "properties": {"name": "Bellingham Bay", "description": "bay"},
            "geometry": {"type": "Polygon", "coordinates": [RING]},
        }
    }
    land(tmp_path, "custom.json", json.dumps(named, indent=1))
    row = features.scan_custom_areas(spark, str(tmp_path / "custom.json")).first()
    assert (row["name"], row.description) == ("Bellingham Bay", "bay")
    assert json.loads(row.geometry)["coordinates"] == [RING]
    assert features.custom_area_names(spark).count() == 8


def test_a_copy_sorts_nothing(spark, tmp_path):
    """Rows lie as they did in the file copied, here not in the table's order."""
    path, uri, fresh = (str(tmp_path / name) for name in ("store", "snapshots", "fresh"))
    areas = ["C", "A", "D", "B"]
    rows = [{"sample_date": "Apr 1, 2013", "catch_area": area} for area in areas]
    version = store.sink_store(records(spark, rows), path)
    folder = f"{path}/data/run={version.run}/survey_year=2013"
    table = store.with_survey_year(records(spark, rows)).select(*store.STORE.fieldNames())
    table.drop("survey_year").coalesce(1).write.mode("overwrite").parquet(folder)
    assert snapshots.snapshot_save(spark, path, uri, AT)
    assert snapshots.snapshot_restore(spark, fresh, uri)
    for copy in (uri, fresh):
        run = versions.latest(spark, copy).run
        found = spark.read.parquet(f"{copy}/data/run={run}/survey_year=2013")
        assert [row.catch_area for row in found.collect()] == areas
        assert store.scan_rollup(spark, copy).count() == len(areas)

import random
from datetime import datetime

import pytest
from helpers import records

from tidetally.operators import aggregates, options, series
from tidetally.operators.filters import FilterSpec
from tidetally.operators.rollup import page_fold_of
from tidetally.plans.dashboard import dashboard, stored_dashboard
from tidetally.plans.report import collection_report
from tidetally.schema import SALMON, SPECIES
from tidetally.sources import store


def catch(date="Apr 1, 2013", area="Area 1, East", **values):
    return {"sample_date": date, "catch_area": area, **dict.fromkeys(SALMON, 0.0), **values}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_total_of_rows_drops_null_species_but_stats_do_not(spark):
    df = records(spark, [catch(chinook=1.0, coho=2.0), catch(chinook=None, coho=5.0)])
    assert rows(aggregates.areas(df)) == [("Area 1, East", 3.0)]
    assert aggregates.stats(df).first().total_catch == 8


def test_stats_round_half_to_even_and_ignore_species(spark):
    df = records(spark, [catch(chinook=0.5, coho=1.5, halibut=9.0, anglers=3)])
    row = aggregates.stats(df, FilterSpec(species=("halibut",))).first()
    assert (row.total_catch, row.total_chinook, row.total_coho) == (2, 0, 2)
    assert (row.surveys, row.total_records, row.total_anglers, row.areas) == (1, 1, 3, 1)
    assert (row.min_year, row.max_year) == ("2013", "2013")


def test_blank_date_makes_the_first_year_unknown(spark):
    row = aggregates.stats(records(spark, [catch(), catch(date="")])).first()
    assert (row.min_year, row.max_year) == ("N/A", "2013")


def test_stats_without_rows(spark):
    row = aggregates.stats(records(spark, [])).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0, "N/A", "N/A", 0)


def test_null_totals(spark):
    df = records(spark, [catch(area="A", chinook=None), catch(area="B", coho=2.0)])
    assert rows(aggregates.areas(df)) == [("B", 2.0), ("A", None)]
    assert sorted(rows(aggregates.map_data(df))) == [("A", 0.0, 1), ("B", 2.0, 1)]
    assert rows(aggregates.top_areas(df, n=1)) == [("B", 2.0)]


def test_trend_keeps_null_and_groups_unknown_periods_first(spark):
    df = records(spark, [catch(chinook=None), catch(date="apr 1, 2013", coho=4.0), catch(date="")])
    spec = FilterSpec(time_unit="monthly", species=("chinook", "coho"))
    assert rows(aggregates.trend(df, spec)) == [(None, 0.0, 4.0), ("2013-04", None, 0.0)]
    assert rows(aggregates.yearly(df))[0][:3] == ("2013", 0.0, 4.0)


def test_monthly_is_dense(spark):
    df = records(spark, [catch(coho=2.0), catch(date="Apr 9, 2015", coho=1.0), catch(date="x 2013")])
    months = rows(aggregates.monthly(df))
    assert [m for m, _ in months] == list(range(1, 13))
    assert [t for _, t in months] == [0, 0, 0, 3.0, 0, 0, 0, 0, 0, 0, 0, 0]


def test_species_and_series(spark):
    df = records(spark, [catch(chinook=None, coho=2.5)])
    assert aggregates.species(df, FilterSpec(species=("chinook",))).first().chinook == 0
    slices = rows(series.species_series(aggregates.species(df)))
    assert slices[:2] == [(1, "Chinook", 0), (2, "Coho", 3)]
    assert slices[5:] == [(6, "Lingcod", None), (7, "Halibut", None)]


def test_trend_series_labels_weeks(spark):
    df = records(spark, [catch(date="Jan 6, 2025", coho=2.5)])
    spec = FilterSpec(time_unit="weekly", species=("coho",))
    out = series.trend_series(aggregates.trend(df, spec), ["coho"], "weekly")
    assert rows(out) == [("2025-W01", "2025-12-w5", "Coho", 3)]


def test_report(spark):
    at = datetime(2025, 1, 1)
    later = datetime(2025, 1, 2)
    df = records(
        spark,
        [
            catch(anglers=2, interviews=1, created_at=at, updated_at=later),
            catch(date="May 1, 2014", created_at=at, updated_at=at),
            catch(date="", area="", created_at=at, updated_at=at),
        ],
    )
    parts = collection_report(df)
    assert rows(parts["effort"]) == [(2, 1)]
    assert rows(parts["by_year"]) == [("2014", 1), ("2013", 1)]
    assert rows(parts["top_areas"]) == [("Area 1, East", 2)]
    assert rows(parts["updated"]) == [(1,)]


def test_filter_options(spark):
    df = records(spark, [catch(area="B"), catch(date="May 1, 2011", area="A"), catch(date="", area="")])
    row = options.filter_options(df).first()
    assert (row.years, row.areas) == (["2011", "2013"], ["A", "B"])
    assert rows(options.filter_options_years(df)) == [("2011",), ("2013",)]
    assert rows(options.filter_options_areas(df)) == [("A",), ("B",)]


@pytest.mark.parametrize("unit", ["daily", "weekly", "monthly", "yearly"])
def test_dashboard_equals_the_single_queries(spark, unit):
    df = records(
        spark,
        [
            catch(chinook=1.0, anglers=2),
            catch(chinook=None, coho=3.0, area="B"),
            catch(date="May 7, 2014", area="", pink=4.0),
            catch(date="", area="B", lingcod=7.0),
            catch(date="Feb 30, 2014", lingcod=None),
        ],
    )
    spec = FilterSpec(year_end="2014", species=("chinook", "lingcod"), time_unit=unit)
    page = dashboard(df, spec)
    singles = {
        "stats": aggregates.stats,
        "trend": aggregates.trend,
        "species": aggregates.species,
        "areas": aggregates.areas,
        "monthly": aggregates.monthly,
        "map_data": aggregates.map_data,
    }
    for name, single in singles.items():
        alone = single(df, spec)
        assert page[name].columns == alone.columns
        assert sorted(rows(page[name]), key=repr) == sorted(rows(alone), key=repr), name


def test_page_of_the_stored_rollup(spark, tmp_path):
    """After corrections of some years the rollup still gives what the records give."""
    draw = random.Random(4)
    path = str(tmp_path / "store")

    def load(years, rows):
        dates = [f"{m} {d}, {y}" if y else "" for y in years for m in ("Jan", "Jul") for d in (1, 9)]
        some = [
            {
                "sample_date": draw.choice(dates),
                "catch_area": draw.choice(["A", "B", "C", ""]),
                "anglers": draw.choice([None, 1, 5]),
                **{name: draw.choice([None, 0.0, 1.0, 2.5]) for name in SPECIES if draw.random() < 0.8},
            }
            for _ in range(rows)
        ]
        store.sink_store(records(spark, some), path)

    load([2012, 2013, 2014, ""], 300)
    load([2013, 2015], 100)
    load([2013], 50)
    table = store.scan_store(spark, path)
    specs = [
        FilterSpec(),
        FilterSpec("2013", "2014", ("A", "B"), ("coho", "lingcod"), "monthly"),
        FilterSpec(None, "2012", (), ("halibut",), "weekly"),
        FilterSpec("2099"),
    ]
    for spec in specs:
        page, stored = dashboard(table, spec), stored_dashboard(spark, path, spec)
        for name in page:
            assert sorted(map(str, stored[name].collect())) == sorted(map(str, page[name].collect())), (spec, name)
    one_year = page_fold_of(store.scan_rollup(spark, path), specs[1])
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "survey_year" in plan.split("PartitionFilters: [")[1].split("]")[0]

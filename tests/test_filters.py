import pytest
from helpers import records
from pyspark.sql import functions as F

from tidetally.operators import filters
from tidetally.operators.filters import FilterSpec, species_list
from tidetally.schema import SALMON
from tidetally.sources import store


def test_species_list():
    assert species_list(None) == SALMON
    assert species_list([]) == SALMON
    assert species_list(["", ""]) == SALMON
    assert species_list(["coho", "all"]) == SALMON
    assert species_list(["Coho", "", "HALIBUT", "coho"]) == ["coho", "halibut"]
    with pytest.raises(ValueError, match="id; drop"):
        species_list(["id; drop"])


def test_spec_from_params():
    spec = FilterSpec.from_params(
        {
            "year_start": ["2013", "2014"],
            "year_end": "2020",
            "catch_area": ["", "A", "B"],
            "species": "coho",
            "time_unit": ["weekly"],
        }
    )
    assert spec == FilterSpec("2013", "2020", ("A", "B"), ("coho",), "weekly")
    assert FilterSpec.from_params({}) == FilterSpec()


@pytest.fixture(scope="module")
def dated(spark):
    texts = ["", "Apr 1, 2012", "Apr 1, 2013", "May 1, 2014", "ab"]
    return records(spark, [{"sample_date": t, "catch_area": f"A{i}"} for i, t in enumerate(texts)])


def kept(df):
    return sorted(r.sample_date for r in df.collect())


def test_year_bounds_compare_text(dated):
    upper = filters.filter_year_range(dated, year_end="2013")
    assert kept(upper) == ["", "Apr 1, 2012", "Apr 1, 2013"]
    lower = filters.filter_year_range(dated, year_start="2013")
    assert kept(lower) == ["Apr 1, 2013", "May 1, 2014", "ab"]
    assert kept(filters.filter_year_range(dated, "2020", "2013")) == []


def test_blank_years_survive_the_partitioned_table(spark, dated, tmp_path):
    path = str(tmp_path / "store")
    store.sink_store(dated, path)
    table = store.scan_store(spark, path)
    for bounds in [(None, "2013"), ("2013", None), ("2013", "2013"), (None, None)]:
        assert kept(filters.filter_year_range(table, *bounds)) == kept(
            filters.filter_year_range(dated, *bounds)
        )


def test_year_bounds_prune_partitions(spark, dated, tmp_path):
    path = str(tmp_path / "store")
    store.sink_store(dated, path)
    df = filters.filtered_records(store.scan_store(spark, path), FilterSpec("2013", "2013"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "survey_year" in pruned and "2013" in pruned
    assert {r.survey_year for r in df.select("survey_year").collect()} == {"2013"}


def test_area_filter(spark, dated):
    assert filters.filter_areas(dated, ["", None]).count() == 5
    assert filters.filter_areas(dated, ["A1", "A3", ""]).count() == 2
    many = [f"A{i}" for i in range(2, 600)]
    assert filters.filter_areas(dated, many).count() == 3
    assert filters.filter_areas(dated, many).columns == ["catch_area"] + [
        c for c in dated.columns if c != "catch_area"
    ]


def test_area_present_drops_blank_and_null(spark):
    df = records(spark, [{"catch_area": "A"}, {"catch_area": ""}]).withColumn("i", F.lit(1))
    with_null = df.unionByName(df.limit(1).withColumn("catch_area", F.lit(None).cast("string")))
    assert [r.catch_area for r in filters.filter_area_present(with_null).collect()] == ["A"]


def test_where_clause_equals_filtered_records(spark, dated, tmp_path):
    path = str(tmp_path / "store")
    store.sink_store(dated, path)
    table = store.scan_store(spark, path)
    for first in (None, "", "2012", "2013", "zz"):
        for last in (None, "", "2013", "2014"):
            for areas in ((), ("",), (None,), ("A1", "A2"), ("", "A3"), ("none",)):
                spec = FilterSpec(first, last, areas)
                want = kept(filters.filtered_records(table, spec))
                assert kept(dated.where(filters.where_clause(spec))) == want, spec
                assert kept(table.where(filters.where_clause(spec, partitioned=True))) == want, spec
    assert dated.where(filters.where_clause(FilterSpec())).count() == 5
    pruned = table.where(filters.where_clause(FilterSpec("2013", "2013"), partitioned=True))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "survey_year" in plan.split("PartitionFilters: [")[1].split("]")[0]

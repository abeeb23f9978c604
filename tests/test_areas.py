import json

from tidetally.operators import areas

FEATURE = "ma_number string, ma_name string, wac string, geometry string"
TOTAL = "area string, total double, surveys bigint"


def feats(spark, *rows):
    return spark.createDataFrame([(n, name, None, None) for n, name in rows], FEATURE)


def canonical(spark, *names):
    return areas.canonical_areas(spark.createDataFrame([(n,) for n in names], "catch_area string"))


def test_the_four_steps(spark):
    totals = spark.createDataFrame(
        [("East Bay", 5.0, 2), ("Area 4, b", 7.0, 3), ("Area 4, a", 1.0, 1), ("Area 6", 9.0, 9)]
        + [("Area 8-1, Bay", 2.0, 1)],
        TOTAL,
    )
    names = canonical(spark, "Area 7, q", "Area 7, r", "Area 8-1, Bay", "Area 4, b")
    shapes = feats(
        spark, ("1", "East Bay"), ("4", "x"), ("6", "y"), ("7", "z"), ("8-1", "w"), ("", "v"), ("9", None)
    )
    found = {
        r.ma_number: (r.area, r.total, r.surveys)
        for r in areas.area_match(shapes, totals, names).collect()
    }
    assert found == {
        "1": ("East Bay", 5.0, 2),
        "4": ("Area 4, a", 1.0, 1),
        "6": ("Area 6, y", 0.0, 0),
        "7": ("Area 7, r", 0.0, 0),
        "8-1": ("Area 8-1, Bay", 2.0, 1),
        "": (None, 0.0, 0),
        "9": (None, 0.0, 0),
    }


def test_canonical_areas_keep_the_last_name(spark):
    rows = canonical(spark, "Area 2, b", "Area 2, a", "Area 8-1, Bay", "Bay").collect()
    assert [tuple(r) for r in rows] == [("2", "Area 2, b")]


def test_choropleth(spark):
    totals = spark.createDataFrame([("East", 5.0, 2), ("Bay", 10.0, 3)], TOTAL)
    customs = spark.createDataFrame([("Bay", None), ("Inlet", None)], "name string, geometry string")
    shapes = feats(spark, ("1", "East"), ("", "Nowhere"))
    drawn = areas.choropleth(shapes, customs, totals, canonical(spark, "Bay"), ["Bay", "Nowhere"])
    found = {r.display_name: r for r in drawn.collect()}
    assert set(found) == {"East", "Nowhere (Area )", "Bay", "Inlet"}
    assert (found["East"].intensity, found["East"].fill_opacity) == (0.5, 0.55)
    assert found["Bay"].custom and found["Bay"].selected and found["Bay"].intensity == 1.0
    assert not found["Nowhere (Area )"].selected and not found["Inlet"].selected
    assert found["Inlet"].total == 0.0 and found["Inlet"].surveys == 0


def test_largest_total_is_at_least_one(spark):
    none = spark.createDataFrame([], TOTAL)
    assert areas.max_area_total(none).first().max_total == 1.0
    small = spark.createDataFrame([("A", 0.25, 1)], TOTAL)
    assert areas.with_intensity(small, small).first().intensity == 0.25


def test_extent_makes_no_row_of_a_vertex(spark):
    rows = [
        (json.dumps({"type": "Polygon", "coordinates": [[[1.0, 9.0], [-2.0, 3.0]], [[0.0, 0.0]]]}),),
        (json.dumps({"type": "MultiPolygon", "coordinates": [[[[5.0, 5.0]]], [[[4.0, -7.0]]]]}),),
        (json.dumps({"type": "Point", "coordinates": [99.0, 99.0]}),),
        (json.dumps({"type": "Polygon", "coordinates": []}),),
        (None,),
    ]
    extent = areas.map_extent(spark.createDataFrame(rows, "geometry string"))
    assert tuple(extent.first()) == (-2.0, -7.0, 5.0, 9.0)
    assert "Generate" not in extent._jdf.queryExecution().executedPlan().toString()

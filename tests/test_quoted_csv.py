"""Files with quoted line breaks, read in splits, against Spark's reader over whole files."""

import random
from contextlib import contextmanager

import pytest
from test_sources import HEAD, land, scan

from tidetally.sources import csv_batches, quoted_csv


@contextmanager
def splits_of(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def field(draw, end):
    kind = draw.randrange(8)
    if kind == 0:
        return ""
    if kind == 1:
        return '""'
    if kind == 2:
        return draw.choice(['5" pipe', 'x"y"z', 'a ""b""', ' "c"'])  # quotes that open nothing
    if kind < 5:
        return draw.choice(["1", "plain", "two words", "é", "0.5"])
    inner = "".join(
        draw.choice(["a", "b,", end, '""', " ", "ö", f"{end}x", '"",""']) for _ in range(draw.randrange(12))
    )
    return f'"{inner}"'


def text(draw, rows, end="\n"):
    lines = [HEAD]
    for _ in range(rows):
        lines.append(",".join(field(draw, end) for _ in range(draw.choice([7, 7, 7, 3, 8]))))
        if draw.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if draw.random() < 0.8 else "")


def in_order(df):
    rows = df.orderBy("batch_no", "part", "seq").collect()
    return [tuple(r[c] for c in HEAD.split(",")) for r in rows]


@pytest.mark.parametrize(("seed", "size", "end"), [(1, 40, "\n"), (2, 97, "\n"), (3, 400, "\n"), (4, 64, "\r\n"), (5, 5, "\n")])
def test_random_files(spark, tmp_path, seed, size, end):
    draw = random.Random(seed)
    for name in ("a", "b"):
        path = tmp_path / "batch_no=1" / f"{name}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text(draw, 30 if size > 10 else 4, end).encode())
    with splits_of(spark, size):
        want = in_order(scan(spark, tmp_path))
        found = scan(spark, tmp_path, split_over=1)
        assert in_order(found) == want
        tasks = found.select("part").distinct().count()
        assert tasks > 5


def test_read_by_several_tasks_and_shuffles_borders_only(spark, tmp_path):
    rows = [f'"Apr 1,\n2013","R ""{i}""",A,1,{i},3,4' for i in range(5000)]
    land(tmp_path, "sample_date=1.csv", "\n".join([HEAD, *rows]) + "\n")
    with splits_of(spark, 8192):
        found = scan(spark, tmp_path, split_over=1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.rdd.getNumPartitions() > 10
        assert [r[4] for r in in_order(found)] == [str(i) for i in range(5000)]
        lines = quoted_csv._lines(spark, str(tmp_path / "sample_date=1.csv"))
        placed = quoted_csv.place_splits([r.asDict() for r in quoted_csv._walks(lines).collect()])
        # What is brought together: at most the two records at the borders of a split.
        moved = quoted_csv._crossing(lines, placed).count()
        assert len(placed) > 10 and 0 < moved <= len(placed)
    # The one exchange lies above the lines of the borders.
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_a_record_over_many_splits(spark, tmp_path):
    long = "line of text\n" * 400
    land(tmp_path, "sample_date=1.csv", f'{HEAD}\nd,R,A,1,2,3,4\nd,"{long}",A,1,2,3,4\nd,"x\ny",A,1,2,3,4\n')
    with splits_of(spark, 300):
        assert in_order(scan(spark, tmp_path, split_over=1)) == in_order(scan(spark, tmp_path))


def test_malformed_quotes_and_long_headers_are_read_as_a_whole(spark, tmp_path):
    land(tmp_path / "a", "sample_date=1.csv", f'{HEAD}\nd,"x"y,A,1,2,3,4\nd,"v\nw",A,1,2,3,4\n')
    land(tmp_path / "b", "sample_date=1.csv", '"Sample\n date",Coho\n"a\nb",1\n')
    with splits_of(spark, 16):
        root = str(tmp_path / "a" / "sample_date=1.csv")
        assert quoted_csv.read_in_splits(spark, root, HEAD.split(",")) is None
        assert in_order(scan(spark, tmp_path / "a", split_over=1)) == in_order(scan(spark, tmp_path / "a"))
        got = scan(spark, tmp_path / "b", split_over=1)
        assert [r["Coho"] for r in got.collect()] == ["1"]


def test_another_header_is_refused(spark, tmp_path):
    land(tmp_path, "batch_no=1/a.csv", f'{HEAD}\nd,"R\n",A,1,2,3,4\n')
    land(tmp_path, "batch_no=1/b.csv", 'Coho,Chinook,Sample date,Ramp/site,x,y,z\n1,2,"d\n",R,1,2,3\n')
    with splits_of(spark, 64), pytest.raises(Exception, match="(?i)header"):
        scan(spark, tmp_path, split_over=1).collect()


def test_line_ends():
    cases = {
        "a,b": (False, True), '"a': (True, None), 'a"b': (False, None), '"a","b': (True, None),
        '"a""': (True, None), '""': (False, True), '"","': (True, None), 'x,"': (True, False), 'x",y': (False, False),
        '"\r': (True, False), "": (False, True),
    }
    for line, ends in cases.items():
        for inside, end in zip((False, True), ends):
            if end is not None:
                assert quoted_csv.inside_after(line, inside) is end, (line, inside)
    with pytest.raises(quoted_csv.Malformed):
        quoted_csv.inside_after('"a"b', False)


def test_manifest_reads_nothing_twice(spark, tmp_path):
    """Below the limit a file goes to one task as before."""
    land(tmp_path, "sample_date=1.csv", f'{HEAD}\nd,"R\n",A,1,2,3,4\n')
    assert scan(spark, tmp_path).select("part").first().part.endswith("@" + "0" * 19)
    assert csv_batches.has_quoted_newlines(spark, str(tmp_path / "sample_date=1.csv"))

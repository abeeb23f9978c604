"""Hard negatives against SQL and against all products."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetally.llm import hard_negatives as hn
from tidetally.llm import registry

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, every):
    """Every anchor's windows over all products, in Python numbers."""
    rows = [
        (i, c, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v])
        for i, c, v in rows
        if i is not None and c is not None and v is not None
        and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, c, v in rows:
        if i % every:
            continue
        near = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, d) for j, d, w in rows if j != i and len(w) == len(v)
        )
        for minus, positive, _ in [n for n in near if n[2] == c][:5]:
            p = -minus
            inside = [n for n in near if n[2] != c and 30 * p <= -100 * n[0] <= 90 * p][:10]
            out += [(i, positive, k + 1, n[1], p, -n[0]) for k, n in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_against_sql(spark, sf):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = database.execute(registry.SQL["op11_hard_negatives"]).fetchall()
    got = registry.op11_hard_negatives(spark, f"/root/testdata/{sf}").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


EDGE = [
    *[(i, i % 3, [0.5 * (i % 4), 1.0, float(i % 7)]) for i in range(0, 140)],  # ties and copies
    *[(500, 1, [1.0, 1.0, 1.0])] * 3,  # repeated rows, one an anchor
    (500, 2, [4.0, 1.0, 0.0]),  # the same id and another vector
    (600, 1, [0.0, 0.0, 0.0]),  # scores of zero: windows hold zero only
    (700, 0, [-3.0, -1.0, -2.0]),  # positives below zero
    (800, None, [1.0, 1.0, 1.0]),
    (900, 1, None),
    (1000, 1, [1.0, None, 1.0]),
    (1100, 1, [1.0, NAN, 1.0]),
    (1200, 1, [INF, 1.0, 1.0]),
    (1300, 1, [2.0, 2.0]),
    (1301, 1, [2.0, 2.0]),
    (1302, 2, [1.0, 1.0]),
    (1400, 1, []),
    (1401, 1, []),
    (-100, 1, [1.0, 2.0, 1.0]),
    (None, 1, [1.0, 1.0, 1.0]),
]


def mined(spark, rows, every=100, **sizes):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("key", F.lit(1))
    table = table.withColumn("block", F.lit(None).cast("int")).withColumn("row", F.lit(0))
    return sorted(map(tuple, hn.hard_negatives(table, F.col("vec_id") % every == 0, **sizes).collect()))


def test_edge_rows(spark):
    assert mined(spark, EDGE) == plain(EDGE, 100)


def test_empty_table_and_lonely_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 2, [1.0])]) == []


def test_many_tiles_and_a_hot_label(spark, monkeypatch):
    """Over many blocks of both sides, with a label that holds most rows, nothing changes."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 7)
    draw = random.Random(5)
    rows = [
        (i, draw.choice([0, 0, 0, 1, 2]), [draw.choice([0.25, 0.5, 1.0, 3.0]) for _ in range(6)])
        for i in range(600)
    ]
    assert mined(spark, rows, every=10) == plain(rows, 10)


def test_keys_sort_as_their_parts():
    draw = random.Random(1)
    parts = [
        (draw.choice([0, 1, -1, 2**61, -(2**61), draw.randrange(-50, 50)]), draw.random() < 0.5, i)
        for i in (-(2**63), -1, 0, 1, 2**63 - 1)
        for _ in range(40)
    ]
    assert all(hn.unpack_key(hn.pack_key(*p)) == p for p in parts)
    in_order = sorted(parts, key=lambda p: (-p[0], not p[1], p[2]))
    assert sorted(hn.pack_key(*p) for p in parts) == [hn.pack_key(*p) for p in in_order]


def test_stream_holds_open_windows_only():
    """Negatives of one anchor pass through; a full window closes behind them."""
    rows = [(1, 100, hn.pack_key(1000, True, 7))]
    rows += [(1, 100, hn.pack_key(899, False, 5)), (1, 100, hn.pack_key(901, False, 4))]
    rows += [(1, 100, hn.pack_key(300 + k % 2, False, k)) for k in range(1000)]
    got = list(hn.stream(iter(sorted(rows, key=lambda r: r[2]))))
    assert [r[2] for r in got] == list(range(1, 11))
    assert got[0] == (100, 7, 1, 5, 1000, 899) and all(r[5] == 301 for r in got[1:])


def test_large_scores(spark):
    assert hn.products(np.array([[2.0**29, 1.0]]), np.array([[2.0**29, 1.0]])).tolist() == [[2**58 + 1]]
    with pytest.raises(ValueError):
        hn.products(np.array([[2.0**40]]), np.array([[2.0**40]]))

"""Both searches against all products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetally.llm import exact_topk, hnsw, registry

NAN, INF = float("nan"), float("inf")
EDGE = [
    *[(i, [1.0, 2.0, float(i % 3)]) for i in range(0, 90)],  # many ties and copies
    (100, [-1.0, 0.5, 0.25]),
    (100, [3.0, 0.5, 0.25]),
    (100, [3.0, 0.5, 0.25]),
    *[(7, [5.0, 2.0, float(i)]) for i in range(30)],  # one id with many vectors
    (101, None),
    (102, [1.0, None, 2.0]),
    (103, [1.0, NAN, 2.0]),
    (104, [INF, 1.0, 2.0]),
    (200, [0.0, 0.0, 0.0]),
    (300, [5.0, 5.0]),
    (301, [4.0, 5.0]),
    (400, []),
    (None, [1.0, 2.0, 3.0]),
]


def edge(spark):
    rows = spark.createDataFrame(EDGE, "vec_id long, embedding array<float>")
    return rows.withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))


def plain(rows, every, k, measure, zero):
    """All products in order; an id counts by its best row."""
    rows = [
        (i, v)
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (any(v) or zero)
    ]
    out = {}
    for i, q in rows:
        if i % every == 0:
            scores = out.setdefault(i, {})
            for j, c in rows:
                if j != i and len(c) == len(q):
                    scores[j] = max(scores.get(j, measure(q, c)), measure(q, c))
    best = {i: sorted((-s, j) for j, s in scores.items())[:k] for i, scores in out.items()}
    return {i: [(j, -s) for s, j in near] for i, near in best.items() if near}


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def whole(q, c):
    return int(sum(np.floor(1024 * np.float64(a)) * np.floor(1024 * np.float64(b)) for a, b in zip(q, c)))


def test_exact_against_sql(spark):
    database = duckdb.connect()
    database.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = database.execute(registry.SQL["op8_exact_top_k"]).fetchall()
    got = registry.op8_exact_top_k(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_edge_rows(spark):
    got = exact_topk.exact_top_k(edge(spark), F.col("vec_id") % 100 == 0)
    assert grouped(got.collect()) == plain(EDGE, 100, 10, whole, zero=True)
    assert exact_topk.exact_top_k(edge(spark).limit(0), F.lit(True)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(400, 19)) * rng.choice([1, 30, 4000], (400, 1)))
    for segments in (1, 4, 16, 40):
        s = exact_topk.statistics(x, segments)
        assert (s @ s.T + 1e-6 * (1 + np.abs(x @ x.T)) >= x @ x.T).all()


def test_large_numbers_stay_exact():
    a = np.array([[2.0**30, 1.0]])
    assert exact_topk.products(a, a).tolist() == [[2**60 + 1]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = registry.table(spark, path, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    got = grouped(registry.op3_hnsw(spark, path).collect())
    found = wanted = 0
    for q, own in got.items():
        scores = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        exact = dict(zip(ids, scores))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in own)
        assert len(own) == min(20, len(ids) - 1)
        found += len({i for i, _ in own} & set(ids[order]))
        wanted += len(order)
    assert set(got) == {i for i in ids if i % 20 == 0}
    assert found / wanted >= 0.95


def test_recall_unequal_norms():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.5, (3000, 1))
    graph, entry = hnsw.build(hnsw.equal_norms(x), 1)
    q = rng.normal(size=(100, 24))
    found = hnsw.search(hnsw.equal_norms(x), graph, entry, q, hnsw.SEARCH_WIDTH)[:, :20]
    exact = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, exact)]) >= 0.9


def test_hnsw_edge_rows(spark):
    got = grouped(hnsw.nearest(edge(spark), F.col("vec_id") % 20 == 0).collect())
    want = plain(EDGE, 20, 20, lambda q, c: float(np.dot(q, c)), zero=False)
    assert got == want
    assert hnsw.nearest(edge(spark).limit(0), F.lit(True)).collect() == []


def test_recall_over_merged_shards(spark):
    """Many small shards, each of which finds its own part of the nearest."""
    path = "/root/testdata/sf0.1"
    table = registry.table(spark, path, "embeddings")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    shard = len(rows) // 12
    got = grouped(hnsw.nearest(table, F.col("vec_id") % 20 == 0, shard=shard).collect())
    found = wanted = 0
    for q, own in got.items():
        order = [i for i in np.lexsort((ids, -(x @ x[ids == q][0]))) if ids[i] != q][:20]
        found += len({ids[i] for i in order} & {i for i, _ in own})
        wanted += 20
    assert found / wanted >= 0.95
    _, graphs, number = hnsw.index(table, shard)
    assert number >= 12 and graphs.count() == number


def test_entry_is_in_the_top_layer():
    rng = np.random.default_rng(9)
    for seed in range(6):
        x = hnsw.equal_norms(rng.normal(size=(200 + 40 * seed, 5)))
        layers, entry = hnsw.build(x, seed)
        used = [set(np.flatnonzero((layer >= 0).any(axis=1))) for layer in layers]
        assert all(entry in u for u in used if u)

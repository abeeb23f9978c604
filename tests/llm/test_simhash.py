"""Fingerprints and components against a plain version."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidetally.llm import registry, simhash
from tidetally.llm.components import components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, max_bits=3):
    """Fingerprint to the smallest fingerprint position reachable."""
    values = np.array(prints, np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= max_bits) + i + 1:
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = sorted(registry.table(spark, path, "documents").collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in docs]
    want = {
        r.doc_id: (f"{p:016x}", docs[c].doc_id)
        for r, p, c in zip(docs, prints, plain_components(prints), strict=True)
    }
    got = registry.op9_simhash_near_dedup(spark, path).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(docs)


def test_edge_rows(spark):
    rows = [(3, None), (4, " \n"), (None, "A b"), (9, "a B"), (9, "a b"), (1, "one"), (2, "ONE"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1), r.component_id or -1) for r in got) == sorted(
        [(3, 3), (4, 3), (-1, 9), (9, 9), (9, 9), (1, 1), (2, 1), (-1, -1)]
    )
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_crowded_keys(spark, monkeypatch):
    """Thousands of fingerprints within a few bits of each other, so that lists are divided."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    places = rng.sample(range(64), 14)
    prints = {rng.getrandbits(64) for _ in range(300)}
    while len(prints) < 2300:
        prints.add(centre ^ sum(1 << p for p in places if rng.random() < 0.3))
    for p in rng.sample(sorted(prints), 200):
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "LONGEST_LIST", 24)
    signed = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(s, s) for (s,) in signed]
    first = {}
    assert [first.setdefault(r, i) for i, r in enumerate(got)] == plain_components(prints)


def test_long_chain(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (601, 600)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(1, 201)}, 601: 600}


def test_variants_are_not_broadcast(spark, monkeypatch):
    """The planner takes the variants to be as few as the fingerprints, whatever their number."""
    plans = []

    def keep(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return simhash_keep(df, name)

    simhash_keep = simhash.keep
    monkeypatch.setattr(simhash, "keep", keep)
    simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"))
    lists = [plan for name, plan in plans if name == "lists"]
    assert lists and not any("Broadcast" in plan for plan in lists)

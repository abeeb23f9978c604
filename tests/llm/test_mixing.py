"""The mix against targets worked out by resharing, and the schedule's evenness."""

import re

import pytest
from pyspark.sql import functions as F

from tidetally.llm import mixing, registry


def plain_targets(size_of):
    """Shares by weight; what lies above twice a source goes to the others, again and again."""
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    open_ = set(names)
    rest = 1.5 * sum(size_of.values())
    while rest > 1e-9 and open_:
        unit = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in sorted(open_, key=names.index):
            target[s] += unit * weight[s]
        for s in list(open_):
            if target[s] >= 2 * size_of[s]:
                rest += target[s] - 2 * size_of[s]
                target[s] = 2.0 * size_of[s]
                open_.discard(s)
    return target


def check(docs, rows):
    size = {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size.setdefault(r.source, []).append((r.doc_id, n))
    totals = {s: sum(n for _, n in x) for s, x in size.items()}
    target = plain_targets(totals)
    want = sorted((d or -1, n, totals[s], round(target[s], 3)) for s, x in size.items() for d, n in x)
    got = sorted((r.doc_id or -1, r["size"], r.source_size, round(r.target, 3)) for r in rows)
    assert got == want
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(sum(target.values()), abs=len(target))
    return size, target


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    docs = registry.table(spark, path, "documents").collect()
    rows = registry.op5_mix_sources(spark, path).collect()
    size, target = check(docs, rows)
    taken = {r.doc_id: r.taken for r in rows}
    for s, own in size.items():
        assert sum(taken[d] for d, _ in own) == pytest.approx(target[s], abs=1)
    again = {r.doc_id: r.taken for r in registry.op5_mix_sources(spark, path).collect()}
    assert again == taken


def test_takes_are_whole_and_even(spark):
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents")
    documents, takes = mixing.mix_sources(docs, block=8)
    of = {r.row_id: r for r in documents.collect()}
    mix = sorted(takes.collect(), key=lambda r: r.slot)
    words = dict.fromkeys(of, 0)
    for t in mix:
        assert 0 <= t.from_word and t.from_word + t.words <= of[t.row_id]["size"]
        words[t.row_id] += t.words
    assert all(words[k] == r.taken for k, r in of.items())
    # After any share of the mix each source has had close to that share of its target.
    total, done, by = sum(words.values()), 0, {}
    sources = {(r.source_size, r.target) for r in of.values()}
    for t in mix:
        key = (of[t.row_id].source_size, of[t.row_id].target)
        by[key] = by.get(key, 0) + t.words
        done += t.words
        if done % 50 == 0:
            for k in sources:
                assert abs(by.get(k, 0) - k[1] * done / total) < 8 * 8


def test_edge_rows(spark):
    rows = [
        (1, None, "a"),
        (2, "", None),
        (3, "one two\x0bthree four", None),
        (3, "one two\x0bthree four", None),
        (None, "x " * 5000, "z"),
        (4, "y", ""),
        (5, " \n", "é"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("size", F.lit("clash")).withColumn("number", F.lit(1))
    check(docs.collect(), mixing.mixed_documents(docs).collect())
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs.where("doc_id = 1")).first().taken == 0


def test_pieces_are_not_broadcast(spark, monkeypatch):
    """The planner takes the pieces to be as few as the documents, whatever their length."""
    joins = []

    def keep(df, name):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        joins.extend(line for line in plan.splitlines() if name == "takes" and "Join" in line)
        return mixing_keep(df, name)

    mixing_keep = mixing.keep
    monkeypatch.setattr(mixing, "keep", keep)
    docs = spark.createDataFrame([(1, "s", "a b " * 900), (2, "t", "c d")], "doc_id long, source string, text string")
    mixing.mix_sources(docs)
    of_pieces = [line for line in joins if "block#" in line]
    assert of_pieces and not any("Broadcast" in line for line in of_pieces)

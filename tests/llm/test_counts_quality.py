"""Unigram counts against the tokenizers library; the classifier on its held-out fold."""

import random
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidetally.llm import compression_quality as quality
from tidetally.llm import batches, registry, unigram_counts

SPACE = "[ \t\n\r\x0b\x0c\x1c-\x1f\x85   -     　]+"


@pytest.fixture(scope="module")
def library():
    vocabulary = unigram_counts.vocabulary()
    floor = min(s for _, s in vocabulary)
    tokenizer = Tokenizer(models.Unigram([*vocabulary, ("<unk>", floor)], unk_id=len(vocabulary)))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(SPACE), "removed"),
            pre_tokenizers.Metaspace(prepend_scheme="always", split=True),
        ]
    )
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_random_text(library):
    @given(st.text("abcdeinorst \n▁éüñ☃☄1,", max_size=60) | st.text(max_size=40))
    @settings(max_examples=400, deadline=None)
    def check(text):
        assert unigram_counts.word_counts().of(text)[0] == library(text)

    check()


def test_counts_whole_table(spark, library):
    docs = registry.table(spark, "/root/testdata/sf0.001", "documents").collect()
    got = {r.doc_id: r for r in registry.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {r.doc_id: library(r.text) for r in docs}
    assert all(r.score < 0 for r in got.values())


def test_counts_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (2, " \t\n "), (None, "word"), (3, "☃☄ x"), (4, "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = unigram_counts.token_counts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (d or 0, library(t)) for d, t in rows
    )
    assert unigram_counts.token_counts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.92), ("sf0.1", 0.97)])
def test_quality_on_the_held_out_fold(spark, sf, least):
    path = f"/root/testdata/{sf}"
    labels = registry.table(spark, path, "labels")
    rows = registry.op7_quality_classifier(spark, path)
    assert rows.count() == registry.table(spark, path, "documents").count()
    found = rows.join(labels, "doc_id").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) >= least
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) >= 0.98


def test_quality_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "x" * 200_000), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3]
    assert all(0 <= r.score <= 1 for r in got)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    mixed = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    assert quality.keep_good(docs, mixed).columns == docs.columns


def test_quality_of_texts_that_open_alike(spark):
    """The first 2,500 bytes are the same in all; what is good or bad about a text comes later."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    opening = " ".join(rng.choice(words) for _ in range(500))[:2500]
    rows = []
    for i in range(400):
        own = words[:200] if i % 2 else words[200:]
        rows.append((i, opening + " " + " ".join(rng.choice(own) for _ in range(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    held = quality.quality_scores(docs, labels).where("held_out").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held) >= 0.9 * len(held)


def test_quality_of_very_long_labelled_texts(spark):
    """Twenty labelled texts of 5 MB: whole texts are learnt from, a bounded share of samples is sent."""
    draw = random.Random(3)
    good = [" ".join(draw.choice(["river", "stone", "cloud", "winter"]) + draw.choice(["s", "", "ly"]) for _ in range(9000)) for _ in range(10)]
    bad = ["".join(draw.choice("qxz$%#@ ") for _ in range(60_000)) for _ in range(10)]
    rows = [(i, t * (5_000_000 // len(t))) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(20)], "doc_id long, quality int")
    both = quality.sample(docs, labels, 100).where("first_half")
    sent = quality.training_samples(both, {0: 0.02, 1: 0.02})
    size, n = sent.agg(F.sum(F.octet_length("part")), F.count("*")).first()
    assert 0 < size < 0.1 * 20 * 5_000_000 and n > 20
    scored = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    held = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((scored[i] > 0.5) == (i < 10) for i in held)


def test_slices_go_by_bytes():
    texts = ["x" * n for n in (10, 3_000_000, 3_000_000, 9_000_000, 1, 1)] + ["y"] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    pieces = list(batches.slices([batch]))
    assert [t for p in pieces for t in batches.column(p, "text")] == texts
    assert all(p.num_rows == 1 or p.nbytes <= batches.PIECE_BYTES for p in pieces)
    assert max(p.num_rows for p in pieces) <= 256 and len(pieces) < 12

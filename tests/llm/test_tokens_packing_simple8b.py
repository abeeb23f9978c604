"""Packing and the token file against the tokenizers library itself."""

import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidetally.llm import packing, registry, simple8b
from tidetally.llm.tokens import word_ids

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

EDGE = [
    (5, None, "a"),
    (None, "no id here", "b"),
    (5, "same id twice", "c"),
    (5, "same id twice", "c"),
    (7, "", None),
    (8, " \t\n\x0b  ", "d"),
    (9, "It's <|endoftext|> x<|startoftext|>y 123abc Ünïcodé ÀÉ!!! a b   don't", "e"),
    (10, "word, " * 9000, "f"),
    (11, "x" * 30000, "g"),
]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, sequence_id string")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@given(st.text(max_size=60) | st.text("aB'sÀé́  \t\n.,!|<>endoftextΣς1", max_size=80))
@settings(max_examples=400, deadline=None)
def test_word_ids_equal_the_library(text):
    assert np.frombuffer(word_ids().of(text), "<u4").tolist() == library_ids(text)


def check_packing(rows, expected):
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc_id, text in expected:
        ids = [*library_ids(text), 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id or -1, k, at, len(part), crc(part)))
    assert got == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in rows) // 2048)


def test_packing_whole_table(spark):
    docs = registry.table(spark, SF, "documents")
    rows = registry.op2_best_fit_packing(spark, SF).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= max(least, best_fit_decreasing([r.length for r in rows], 2048))


def test_packing_edge_rows(spark):
    check_packing(packing.best_fit_packing(edge(spark)).collect(), [r[:2] for r in EDGE])
    assert packing.best_fit_packing(edge(spark).limit(0)).collect() == []


def best_fit_decreasing(lengths, capacity):
    """Sequences that plain best fit on exact lengths needs."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_as_few_sequences_as_can_be(spark, sf):
    """The whole tables of given sizes: the floor of all tokens, or what plain best fit needs."""
    rows = registry.op2_best_fit_packing(spark, f"/root/testdata/{sf}").select("length", "sequence_id").collect()
    lengths = [r.length for r in rows]
    floor = -(-sum(lengths) // 2048)
    assert len({r.sequence_id for r in rows}) <= max(floor, best_fit_decreasing(lengths, 2048))


def test_empty_texts_share_a_sequence(spark):
    docs = spark.range(2048).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert packing.best_fit_packing(docs).select("sequence_id").distinct().count() == 1


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
@settings(max_examples=60, deadline=None)
def test_patterns_use_up_the_histogram(histogram):
    used = {}
    for pattern, times in packing.fit_patterns(dict(histogram), 64):
        assert times > 0 and sum(b * n for b, n in pattern.items()) <= 64
        for b, n in pattern.items():
            used[b] = used.get(b, 0) + n * times
    assert used == histogram


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60_000) | st.just(0), max_size=9000))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    words, offsets, places, escapes = simple8b.encode(np.array(ids, np.uint64))
    assert len(offsets) == -(-len(ids) // simple8b.BLOCK_IDS)
    assert simple8b.decode(words, offsets, places, escapes, len(ids)).tolist() == ids


def test_token_file_whole_table(spark):
    docs = registry.table(spark, SF, "documents").collect()
    got = {r.doc_id: r for r in registry.op10_token_ids(spark, SF).collect()}
    start = 0
    for row in sorted(docs, key=lambda r: r.doc_id):
        ids = [*library_ids(row.text), 2]
        r = got.pop(row.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not got


def test_token_file_edge_rows(spark, tmp_path):
    simple8b.write_ids(edge(spark), str(tmp_path / "ids"))
    rows = simple8b.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r[0] for r in EDGE], key=lambda x: (x is not None, x))
    assert rows[0].start == 0
    for a, b in zip(rows, rows[1:]):
        assert b.start == a.start + a.n_tokens
    by_text = sorted((r[0] or -1, *[*library_ids(r[1]), 2]) for r in EDGE)
    assert sorted((r.doc_id or -1, *np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == by_text
    assert simple8b.token_file(edge(spark).where(F.lit(False))).collect() == []


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])

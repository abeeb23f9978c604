"""Removed bytes against every 400-byte string of the table."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidetally.llm import prefix_free, registry


def plain(docs):
    count = Counter()
    for _, text in docs:
        data = (text or "").encode()
        count.update(hash(data[i : i + 400]) for i in range(len(data) - 399))
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        end = 0
        for i in range(len(data) - 399):
            if count[hash(data[i : i + 400])] > 1:
                low = max(i, end)
                gone[low : i + 400] = b"\1" * (i + 400 - low)
                end = i + 400
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((-1 if doc_id is None else doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in df.collect())


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in registry.table(spark, path, "documents").select("doc_id", "text").collect()]
    assert rows(registry.op4_suffix_array_dedup(spark, path)) == plain(docs)


def test_edge_rows(spark):
    rng = random.Random(2)
    prose = "".join(rng.choice("abcdefgh \n") for _ in range(6000))
    texts = [
        (1, None),
        (2, ""),
        (3, "x" * 399),
        (3, "y" * 400),
        (4, "z" * 5000),  # one letter
        (5, "no no no " * 300),
        (5, "no no no " * 300),
        (None, prose),
        (6, prose[:400]),
        (7, "é" + prose[1000:1399] + "ü"),  # one byte short
        (8, "é" + prose[1000:1400] + "ü" + prose[3000:3900]),
        (9, prose[100:900] + "!" + prose[901:2500]),
        (10, prose[5500:] + prose[:500] + prose[5500:]),
        *[(20 + i, f"{i} " * 30 + prose[2000 : 2405 + i] + f" {i}" * 200) for i in range(30)],
        (60, "ab" * 230),
        (61, "ba" * 205),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("row", F.lit("clash"))
    assert rows(prefix_free.remove_repeats(docs)) == plain(texts)
    assert prefix_free.remove_repeats(docs.limit(0)).collect() == []


def test_entries_name_every_byte_of_a_piece():
    """Two texts that differ in one byte, at each place of a piece far from its trigger."""
    rng = random.Random(4)
    wide = prefix_free.STEP - 1
    found = None
    while found is None:
        data = bytes(rng.choice(b"abcdefgh") for _ in range(60_000))
        p = prefix_free.parse(data, [len(data)])
        at = {(int(s), int(e)): int(n) for s, e, n in zip(p.first, p.last, p.entry, strict=True)}
        # The third step: its windows begin 256 bytes or more before the trigger.
        marks = prefix_free.names_by_doubling(data)[prefix_free.TRIGGER] >> prefix_free.np.uint64(40)
        places = set(prefix_free.np.flatnonzero(marks % prefix_free.np.uint64(64) == 0).tolist())
        for s, e in at:
            ahead = [k for k in range(s, e + 2 * prefix_free.STEP + 1) if k in places]
            if e - s == wide and ahead == [e + 2 * prefix_free.STEP] and s >= 64:
                found = s, e
                break
    s, e = found
    begin, end = s - 64, e + prefix_free.WINDOW + 64
    piece = data[begin:end]
    first = prefix_free.parse(piece, [len(piece)])

    def entries(p):
        return {(int(a), int(b)): int(n) for a, b, n in zip(p.first, p.last, p.entry, strict=True)}

    base = entries(first)
    assert (64, 64 + wide) in base
    for k in range(64, 64 + wide + prefix_free.WINDOW):
        other = piece[:k] + b"!" + piece[k + 1 :]
        changed = entries(prefix_free.parse(other, [len(other)]))
        for (a, b), name in base.items():
            if a <= k < b + prefix_free.WINDOW:
                assert changed.get((a, b)) != name, k - a

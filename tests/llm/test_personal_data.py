"""Base spans against the plain patterns; the weak supervision against planted answers."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidetally.llm import personal_data as pd
from tidetally.llm import registry

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def plain(text):
    spans = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            own = m.group()
            digits = re.sub("[^0-9]", "", own)
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in own.split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), number, m.end()))
    return sorted(spans)


def listed(spans):
    return ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_of_random_text():
    draw = random.Random(2)
    pieces = [*"abZ.@-+%_ ()é0123456789", "4111 1111-1111 1111", "a@b.c", "1.2.3.4", "255.", "+1 (20", "\n", "00"]
    for _ in range(6000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randrange(0, 40)))
        assert pd.base_spans(text) == plain(text), text


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text or "" for r in registry.table(spark, path, "documents").collect()}
    got = registry.op13_personal_data(spark, path).collect()
    assert len(got) == len(texts)
    added = 0
    for r in got:
        base = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        spans = [(int(a), list(PLAIN).index(k), int(b)) for k, a, b in spans]
        assert spans == sorted(spans) and set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        for a, k, b in set(spans) - set(base):
            assert all(b <= x or y <= a for x, _, y in spans if (x, _, y) != (a, k, b))
            own = texts[r.doc_id][a:b]
            digits = re.sub("[^0-9]", "", own)
            assert k != 2 or plain_luhn(digits), own
        added += r.n_added
    assert added or sf == "sf0.01"


def numbers(draw):
    """A card number that passes its check."""
    body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
    return next(body + d for d in "0123456789" if plain_luhn(body + d))


def planted(draw, n):
    """(texts, spans that are personal, spans that only look so)."""
    texts, true, false = [], [], []
    for _ in range(n):
        text, yes, no = "", [], []
        for _ in range(draw.randrange(1, 4)):
            text += " ".join(draw.choice(["lorem", "ipsum", "the", "and", "tion"]) for _ in range(12)) + " "
            what = draw.randrange(7)
            card, phone = numbers(draw), f"+1 ({draw.randrange(200, 999)}) 555-{draw.randrange(1000, 9999)}"
            start = len(text)
            if what == 0:  # each swallows the other
                text += f"{phone} {card}"
                yes += [(start, 3, start + len(phone)), (start + len(phone) + 1, 2, len(text))]
            elif what in (1, 2):
                text += card
                yes.append((start, 2, len(text)))
            elif what in (3, 4):
                text += phone
                yes.append((start, 3, len(text)))
            elif what == 5:  # digits of a checksum
                wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
                text += f"key {draw.choice('bcdf')}{wrong}{draw.choice('bcdf')}"
                no.append((start + 5, 2, len(text) - 1))
            else:
                text += "x".join(draw.choice("abcdef0123456789") for _ in range(20))
            text += " "
        texts.append(text)
        true.append(yes)
        false.append(no)
    return texts, true, false


def test_planted_spans(spark):
    texts, true, false = planted(random.Random(4), 600)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pd.personal_data(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == listed(sorted(true[i])), text
    assert any(false)


def test_rows(spark):
    card = numbers(random.Random(1))
    rows = [
        (1, None), (2, ""), (3, f"{card} ok a.b@c.example.com"), (3, f"{card} ok a.b@c.example.com"),
        (None, "10.0.0.1"), (5, "é😀 10.0.0.1 999.1.1.1"), (6, "no data"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({"spans": F.lit("x"), "code": F.lit(1), "n": F.lit(2), "n_email": F.lit("y")})
    got = pd.personal_data(docs).collect()
    key = lambda r: (str(r[0]), r[1])
    want = sorted(((i, listed(plain(t))) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.spans) for r in got), key=key) == want
    assert [r.base_sha256 for r in got if r.doc_id == 1] == [hashlib.sha256(b"").hexdigest()]
    assert pd.personal_data(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text",
    ["1" * 2_000_000, "1." * 700_000, "a" * 2_000_000 + "@", "a@" * 700_000, "+1" + " " * 2_000_000, "+1 " * 500_000,
     "4 " * 800_000, "a(at)" * 300_000, "123-456-" * 200_000, "a@b.c " * 100_000],
)
def test_long_texts_take_linear_time(text):
    start = time.perf_counter()
    base = pd.base_spans(text)
    model = pd.Model({}, {}, {})
    pd.added_spans(text, base, model)
    for span in pd.candidates(text, base)[:1000]:
        pd.votes(text, span, False)
    assert time.perf_counter() - start < 20


def test_reliabilities_are_estimated():
    """Votes drawn with known reliabilities: the estimates and the answers come back."""
    rng = np.random.default_rng(6)
    n = 20_000
    answer = rng.random(n) < 0.3
    chances = np.array(
        [[[0.8, 0.1, 0.1], [0.05, 0.15, 0.8]], [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]], [[0.1, 0.8, 0.1], [0.1, 0.8, 0.1]],
         [[0.7, 0.1, 0.2], [0.2, 0.1, 0.7]], [[0.9, 0.05, 0.05], [0.1, 0.1, 0.8]]]
    )  # labeler, answer, vote
    votes = np.column_stack(
        [[rng.choice(3, p=chances[k, int(a)]) for a in answer] for k in range(len(chances))]
    )
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    share, found, yes = pd.expectation(rows, counts, tuple("abcde"))
    assert share == pytest.approx(0.3, abs=0.02)
    assert np.abs(found.transpose(1, 0, 2) - chances).max() < 0.04
    spread = {tuple(r): y for r, y in zip(rows, yes)}
    right = np.mean([(spread[tuple(v)] > 0.5) == a for v, a in zip(votes, answer)])
    assert right > 0.95


def test_codes():
    draw = random.Random(3)
    cases = [
        (draw.randrange(4), tuple(draw.randrange(-1, 2) for _ in pd.LABELERS), draw.randrange(24)) for _ in range(200)
    ]
    kinds, votes, forms = pd._decoded(np.array([pd._coded(*c) for c in cases]))
    assert [(k, tuple(v - 1), f) for k, v, f in zip(kinds.tolist(), votes, forms.tolist())] == cases

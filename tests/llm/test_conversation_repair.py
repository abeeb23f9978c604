"""Repairs against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidetally.llm import conversation_repair as cr
from tidetally.llm import registry

GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text): b, d, t or a space."""
    seen, out = set(), ""
    for role, text in rows:
        bare = text.strip(SPACE)
        if not bare:
            out += "b"
        elif (role, text) in seen:
            out += "d"
        else:
            out += " " if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def least(rows, found):
    """Cheapest edits by (cost, audit): all scripts in that order until one ends well."""
    heap = [(0, "", 0, "", "")]  # cost, audit, rows read, initials, what was kept
    done = set()
    while heap:
        cost, audit, at, roles, made = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, made
        state = (at, roles[-1:] if roles != "s" else "S")
        if (state, audit) in done:
            continue
        done.add((state, audit))

        def push(more, letter, step, initial="", line=None, cost=cost, audit=audit, at=at, roles=roles, made=made):
            new = roles + initial
            if re.fullmatch(r"(s?(ua)*u?)", new):
                # Only what lies last decides; keep that much.
                text = made if line is None else made + ("\n" if made else "") + line
                heapq.heappush(heap, (cost + more, audit + letter, at + step, new, text))

        if cost > 3 * len(rows):
            continue
        push(2, "I", 0, "u", "user:")
        push(2, "I", 0, "a", "assistant:")
        if at < len(rows):
            role, text = rows[at]
            push(3, "D", 1)
            if found[at] not in "bd":
                cut = found[at] == "t"
                if role[:1] in ("s", "u", "a"):
                    push(cut, "K", 1, role[0], f"{role}:{text}")
                push(2 + cut, "R", 1, "u", f"user:{text}")
                push(2 + cut, "R", 1, "a", f"assistant:{text}")
    raise AssertionError("deleting every row is always a repair")


def harm(rows):
    """The damage, row by row."""
    for conv, turn, role, text in rows:
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        code = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = show[2], show[3]
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)


def by_hand(rows, damage=True, search=least):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in (harm(rows) if damage else rows) if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = {r[1] for r in own} - {None}
        lines = [(r[2], r[3]) for r in own]
        found = faults(lines)
        cost, audit, made = search(lines, found)
        legal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(found.count(x) for x in "bdt"),
            legal, cost, audit, hashlib.sha256(made.encode()).hexdigest(),
        )
    return out


def collected(df):
    rows = df.collect()
    assert df.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return table.withColumns({"mark": F.lit("x"), "audit": F.lit("K"), "copies": F.lit(7), "place": F.lit(1)})


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in registry.table(spark, path, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = collected(registry.op12_conversation_repair(spark, path))
    assert got == by_hand(rows)
    assert len({a for r in got.values() for a in r[6]}) == 4  # all edits occur


def chatter(draw, conversations, longest):
    texts = ["Fine.", "Yes", "No!", "", " \t", None, "Why?", "One. Two", "émoi…", "a.  \n"]
    return [
        (c, draw.choice([t, t, t, None, 2]), draw.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), draw.choice(texts))
        for c in range(conversations)
        for t in range(draw.randrange(1, longest))
    ]


def test_random_rows(spark):
    rows = chatter(random.Random(3), 60, 7)
    rows += [(None, t, "user", "Same.") for t in (None, 1, 1, 4)] + [(-1, None, None, None)] * 3
    table = frame(spark, rows)
    assert collected(cr.repair_digest(table, cr.damaged(table))) == by_hand(rows)


def test_nothing_left_and_empty_table(spark):
    gone = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*gone, "user", "Hello.")]
    table = frame(spark, rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert collected(cr.repair_digest(table, cr.damaged(table))) == {gone[0]: (0, 0, 0, 0, 0, 0, "", empty)}
    assert collected(cr.repair_digest(frame(spark, []), cr.damaged(frame(spark, [])))) == {}


def plain_program(lines, found):
    """Least (cost, audit) of each state after each row, with whole strings."""
    held = {cr.NOTHING: (0, "")}
    for (role, _), fault in zip(lines, found):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        row = cr.ways(initial, fault == "t", fault in "bd")
        new = {}
        for start, (cost, audit) in held.items():
            for end in cr.STATES:
                if row[start][end]:
                    way = (cost + row[start][end][0], audit + row[start][end][1])
                    new[end] = min(new.get(end, way), way)
        held = new
    return min((c + 2 * cr._ENDING[s], a + "I" * cr._ENDING[s]) for s, (c, a) in held.items())


@pytest.mark.parametrize("size", [1, 2, 7, 100])
def test_pieces_give_what_one_run_gives(size):
    draw = random.Random(size)
    rows, want = [], []
    for conv in range(40):
        lines = [(draw.choice(["s", "u", "a", "x"]), draw.choice("abcd") + draw.choice(". ")) for _ in range(draw.randrange(1, 60))]
        found = faults(lines)
        rows += [(conv, role, f == "b", f == "t", f == "d", 1) for (role, _), f in zip(lines, found)]
        illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        want.append((conv, illegal, *plain_program(lines, found)))
    # Cut anywhere into parts, as range partitions are.
    at = sorted(draw.sample(range(1, len(rows)), 5))
    parts = [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]
    cut = [p for number, part in enumerate(parts) for p in cr.pieces(part, number, size)]
    assert sorted(cut, key=lambda p: p[:3]) == cut
    assert list(cr.linked(cut)) == want


@pytest.mark.parametrize("modulus", [1, 2, 5, cr.MODULUS])
def test_colliding_hashes(modulus):
    draw = random.Random(modulus)
    for _ in range(150):
        lines = [(draw.choice("suaax"), "x" + draw.choice([".", ""])) for _ in range(draw.randrange(1, 70))]
        found = faults(lines)
        program = cr.Program(modulus=modulus)
        for (role, _), f in zip(lines, found):
            program.step(cr.ways(role if role != "x" else "-", f == "t", f in "bd"))
        assert program.result() == plain_program(lines, found)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation cut over several tasks and pieces, with a line it repeats throughout."""
    draw = random.Random(8)
    rows = [(1, t, draw.choice(["user", "assistant", "tool"]), draw.choice(["So. ", "So", f"T{t}."])) for t in range(9000)]
    rows += [(1, 7, "user", "Twice.")] * 300 + [(c, t, "user", "x" * 50_000 + ".") for c in (0, 2) for t in (1, 2)]
    table = frame(spark, rows).repartition(4)
    report, repaired = cr.repair(table)
    want = by_hand(rows, damage=False, search=lambda lines, found: (*plain_program(lines, found), ""))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    assert got == {c: w[:-1] for c, w in want.items()}
    kept = repaired.where("conv_id = 1").orderBy("place").collect()
    assert GOOD.fullmatch("".join(r.role[0] for r in kept))
    assert [r.place for r in kept] == list(range(len(kept)))
    assert "".join(r.edit for r in kept) == got[1][6].replace("D", "")


def test_digest_lines():
    rows = [(1, 0, "user", "a", "K"), (1, 1, "assistant", "", "I"), (2, 0, "u", "ß\n", "R")]
    want = {c: hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in g).encode()).hexdigest() for c, g in groupby(rows, lambda r: r[0])}
    assert dict(cr.digests(iter(rows))) == want

"""Conversation structure repair: the cheapest edits, by a dynamic program whose audits are shared.

A conversation's roles should read ``(s?(ua)+)?`` by their initials: perhaps a
system row, then user and assistant in turn. Rows are kept, given another role,
deleted, and empty ones inserted, at the least cost; of audits (one letter an
edit: K, R, D, I) that cost the same the ASCII-least is taken.

**Audits.** After each row the program holds, for each of four states of the
output (nothing, a system row, a user, an assistant), the least cost and its best
audit. Audits are linked nodes: a node holds its row's letters (insertions before
it included), its parent, a rolling hash of the whole audit and its binary-lifting
ancestors, so that all audits share their prefixes. Two that cost the same are
compared at their first difference, found by lifting both while the hashes of
their ancestors differ. Within one program equal audits are one node (an audit
determines rows and state, and one node is made for each), so what the hashes say
is verified by whether both ends hang on one node; where they collide the search
is made again by the nodes themselves.

Audits of the same rows have as many letters other than I, and end in one, so
none is a proper prefix of another and the first difference decides.

**Long conversations.** Rows are ordered by ranges of (conversation, turn), so
that a conversation that holds a third of all rows is cut over many tasks, and
each run of ``PIECE`` rows is worked out by itself, from any state to any state.
The pieces of a conversation, which are few, are then linked by the same program,
a piece taking a row's place. Writing out the repaired rows and a digest over them
goes through a conversation's rows in order: a sorted stream that holds its audit
and one row at a time.

Rows: a null role or text counts as one space, null ids are one conversation. Rows go by
turn, nulls first, then role, then text (by its first 64 characters and its MD5).
Repeated rows are duplicates of the first. A conversation without rows has an empty
audit; an empty table gives no rows; further columns are ignored.
"""

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.session import keep

#: Rows worked out at a time.
PIECE = 4096
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; CUT: a truncated row that stays

#: States of the output: nothing, a system row, last a user, last an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the role that may follow
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that end a conversation well.
_ENDING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

MODULUS, BASE = (1 << 61) - 1, 1_000_003

_SPACE = " \t\n\x0b\f\r"
_LEGAL = ("su", "ua", "au")


class Audit:
    """A node: its row's letters, what lies before, and the hash of both."""

    __slots__ = ("ancestors", "digest", "letters", "parent")

    def __init__(self, parent: "Audit | None", letters: str, modulus: int = MODULUS):
        self.parent, self.letters = parent, letters
        self.ancestors = []
        if parent is None:
            self.digest = 0
            return
        self.digest = (parent.digest * BASE + int.from_bytes(letters.encode())) % modulus
        node, k = parent, 0
        while node is not None:  # ancestors[k] lies 2**k nodes back
            self.ancestors.append(node)
            node = node.ancestors[k] if k < len(node.ancestors) else None
            k += 1

    def text(self) -> str:
        parts, node = [], self
        while node is not None:
            parts.append(node.letters)
            node = node.parent
        return "".join(reversed(parts))


def _apart(a: Audit, b: Audit, same) -> tuple[Audit, Audit]:
    """The highest ancestors that differ, by ``same``."""
    k = len(a.ancestors) - 1
    while k >= 0:
        if k < len(a.ancestors) and not same(a.ancestors[k], b.ancestors[k]):
            a, b = a.ancestors[k], b.ancestors[k]
        k -= 1
    return a, b


def before(a: Audit, b: Audit) -> bool:
    """Whether the audit of ``a`` is the smaller; both of the same rows, not the same node."""
    x, y = _apart(a, b, lambda p, q: p.digest == q.digest)
    if x.parent is not y.parent:  # two audits share a hash
        x, y = _apart(a, b, lambda p, q: p is q)
    return x.letters < y.letters


#: Best way from a state to a state: (cost, letters). None: there is none.
Ways = tuple[tuple[tuple[int, str] | None, ...], ...]


@cache
def ways(initial: str, truncated: bool, delete: bool) -> Ways:
    """The ways past one row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state = start
        for inserted in range(3):  # three come back to where one was
            cost, letters = INSERT * inserted, "I" * inserted
            ends = [(state, DELETE, "D")]
            if not delete:
                cut, follows = CUT * truncated, _NEXT[state]
                ends.append((follows, REROLE + cut, "R"))
                if initial == "ua"[follows == ASSISTANT]:
                    ends.append((follows, KEEP + cut, "K"))
                if initial == "s" and state == NOTHING:
                    ends.append((SYSTEM, KEEP + cut, "K"))
            for end, more, letter in ends:
                way = (cost + more, letters + letter)
                best[start, end] = min(best.get((start, end), way), way)
            state = _NEXT[state]
    return tuple(tuple(best.get((x, y)) for y in STATES) for x in STATES)


class Program:
    """Costs and audits of all states after the rows so far, from one start."""

    def __init__(self, start: int = NOTHING, modulus: int = MODULUS):
        self.modulus = modulus
        self.held: list[tuple[int, Audit] | None] = [None] * 4
        self.held[start] = (0, Audit(None, ""))

    def step(self, row: Ways) -> None:
        new: list[tuple[int, Audit] | None] = [None] * 4
        for end in STATES:
            found = None  # cost, audit before, letters
            for start, held in enumerate(self.held):
                way = row[start][end]
                if held is None or way is None:
                    continue
                cost, audit, letters = held[0] + way[0], held[1], way[1]
                if (
                    found is None
                    or cost < found[0]
                    or (cost == found[0] and before(audit, found[1]))
                ):
                    found = (cost, audit, letters)
            if found:
                new[end] = (found[0], Audit(found[1], found[2], self.modulus))
        self.held = new

    def result(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation."""
        best = None
        for state, held in enumerate(self.held):
            if held:
                cost = held[0] + INSERT * _ENDING[state]
                if best is None or cost < best[0] or (cost == best[0] and before(held[1], best[1])):
                    best = (cost, held[1], "I" * _ENDING[state])
        return best[0], best[1].text() + best[2]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated and mistaken by a checksum of conversation and turn."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = (
        F.when(code == 1, "")
        .when(code == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(code == 4, "user").otherwise(F.col("role"))
    times = F.when(code == 3, 2).otherwise(1)
    return rows.where(code != 0).select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


#: Order of a conversation's rows; nulls sort first.
_ORDER = ("turn", "role", "opening", "mark")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with what orders them and what the text alone says of them."""
    text, role = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("text", "role"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(_SPACE)), -1, 1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).select(
        "*",
        F.substring("text", 1, 64).alias("opening"),
        F.md5("text").alias("mark"),
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("cut"),
    )


def _lines(marked: DataFrame) -> DataFrame:
    """One row for each distinct (conversation, turn, role, text), without the text.

    ``copies`` counts the rows; ``seen`` says that an earlier turn has the role and text.
    """
    lines = marked.groupBy("conv_id", "turn", "role", "opening", "mark").agg(
        F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    lines = keep(lines, "lines")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = lines.groupBy("conv_id", "role", "mark").agg(F.min(place).alias("first"))
    firsts = firsts.select(*(F.col(n).alias(f"f_{n}") for n in firsts.columns))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv_id"))
    for name in ("role", "mark"):
        same = same & (F.col(name) == F.col(f"f_{name}"))
    seen = ~place.eqNullSafe(F.col("f_first"))
    return keep(
        lines.join(firsts, same).select(*lines.columns, seen.alias("seen")), "lines-seen"
    )


def _counted(lines: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of the conversations that have rows."""
    blank, seen = F.col("blank"), F.col("seen")
    turns = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    fresh = ~blank & ~seen
    return lines.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(blank, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(
            F.when(~blank & seen, F.col("copies")).when(fresh, F.col("copies") - 1).otherwise(0)
        ).alias("duplicate"),
        F.sum((fresh & F.col("cut")).cast("long")).alias("truncated"),
    )


_PIECE = (
    "conv_id {0}, part int, piece int, illegal long, head string, tail string, "
    "costs array<long>, audits array<string>"
)


def _table(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=t) for c, (_, t) in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in some.columns), strict=True)


def _batched(
    schema: list[tuple[str, pa.DataType]], rows: Iterable[tuple], weight=lambda row: 1, most: int = 1024
) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` by ``weight``."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += weight(row)
        if held >= most:
            yield _table(schema, some)
            some, held = [], 0
    if some:
        yield _table(schema, some)


class Piece:
    """Rows in order: the program from each start, and the pairs of roles that can't follow."""

    def __init__(self, starts: Iterable[int]):
        self.programs = {start: Program(start) for start in starts}
        self.rows = self.illegal = 0
        self.head = self.tail = None

    def add(self, role: str, blank: bool, cut: bool, duplicate: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        row = ways(initial, cut and not blank and not duplicate, blank or duplicate)
        for program in self.programs.values():
            program.step(row)
        if self.rows:
            self.illegal += self.tail + initial not in _LEGAL
        else:
            self.head = initial
        self.tail = initial
        self.rows += 1

    def matrix(self) -> tuple[list, list]:
        costs, audits = [], []
        for start in STATES:
            held = self.programs[start].held if start in self.programs else [None] * 4
            costs += [h and h[0] for h in held]
            audits += [h and h[1].text() for h in held]
        return costs, audits


def pieces(rows: Iterable[tuple], part: int, size: int = PIECE) -> Iterator[tuple]:
    """Rows (conv_id, role, blank, cut, seen, copies) in order, as the rows of ``_PIECE``."""
    none = object()
    current, piece, number, conversations = none, None, 0, 0

    def closed():
        return (current, part, number, piece.illegal, piece.head, piece.tail, *piece.matrix())

    for conv_id, role, blank, cut, seen, copies in rows:
        if conv_id != current or current is none:
            if piece:
                yield closed()
            conversations += 1
            # The first conversation of a part may have begun in the part before.
            current, number = conv_id, 0
            piece = Piece([NOTHING] if conversations > 1 else STATES)
        for copy in range(copies):
            if piece.rows == size:
                yield closed()
                number += 1
                piece = Piece(STATES)
            piece.add(role, blank, cut, seen or copy > 0)
    if piece:
        yield closed()


def linked(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces of conversations in order, as (conv_id, illegal, cost, audit)."""
    none = object()
    current, program, illegal, tail = none, None, 0, None
    for conv_id, _, _, own, head, last, costs, audits in rows:
        if conv_id != current or current is none:
            if program:
                yield (current, illegal, *program.result())
            current, program, illegal, tail = conv_id, Program(), 0, None
        both = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
        program.step(tuple(tuple(both[4 * x : 4 * x + 4]) for x in STATES))
        illegal += own + (tail is not None and tail + head not in _LEGAL)
        tail = last
    if program:
        yield (current, illegal, *program.result())


def apply_audits(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, audit or None, role, text), an audit before its rows, as
    (conv_id, place, role, text, edit), without what is deleted.
    """
    audit, at, place, state, owner = "", 0, 0, NOTHING, None

    def inserted():
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            state = _NEXT[state]
            yield owner, place, _NAMES[state], "", "I"
            at, place = at + 1, place + 1

    for conv_id, own, role, text in rows:
        if own is not None:
            owner, audit, at, place, state = conv_id, own, 0, 0, NOTHING
            yield from inserted()  # also where all that follows are insertions
            continue
        edit = audit[at]
        at += 1
        if edit != "D":
            if edit == "K" and role[:1] == "s":
                state = SYSTEM
            else:
                state = _NEXT[state]
            yield conv_id, place, role if edit == "K" else _NAMES[state], text, edit
            place += 1
        yield from inserted()


def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, SHA-256 of its ``role:text`` lines) of repaired rows in order."""
    none = object()
    current, digest = none, None
    for conv_id, _, role, text, _ in rows:
        if conv_id != current or current is none:
            if digest:
                yield current, digest.hexdigest()
            current, digest = conv_id, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:".encode())
        digest.update(text.encode())
    if digest:
        yield current, digest.hexdigest()


def audits(lines: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of the conversations that have rows."""
    kind = lines.schema["conv_id"].dataType.simpleString()
    ordered = lines.repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = [
            ("conv_id", first.schema.field("conv_id").type),
            ("part", pa.int32()),
            ("piece", pa.int32()),
            ("illegal", pa.int64()),
            ("head", pa.string()),
            ("tail", pa.string()),
            ("costs", pa.list_(pa.int64())),
            ("audits", pa.list_(pa.string())),
        ]
        rows = _records(b for some in ([first], batches) for b in some)
        done = pieces(rows, TaskContext.get().partitionId())
        yield from _batched(schema, done, lambda r: 64 + sum(len(a or "") for a in r[7]), 1 << 20)

    cuts = ordered.select("conv_id", "role", "blank", "cut", "seen", "copies").mapInArrow(
        cut, _PIECE.format(kind)
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = [
            ("conv_id", first.schema.field("conv_id").type),
            ("illegal", pa.int64()),
            ("cost", pa.int64()),
            ("audit", pa.string()),
        ]
        rows = linked(_records(b for some in ([first], batches) for b in some))
        yield from _batched(schema, rows, lambda r: 64 + len(r[3]), 1 << 20)

    in_order = cuts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return in_order.mapInArrow(link, f"conv_id {kind}, illegal long, cost long, audit string")


def repaired_rows(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the rows that stay and come in.

    A conversation's rows lie in one partition, in order.
    """
    kind = marked.schema["conv_id"].dataType.simpleString()
    turn = marked.schema["turn"].dataType
    texts = marked.withColumn("audit", F.lit(None).cast("string"))
    heads = found.select(
        "conv_id",
        F.lit(None).cast(turn).alias("turn"),
        *(F.lit("").alias(n) for n in ("role", "text", "opening", "mark")),
        "audit",
    )
    both = texts.select(heads.columns).unionByName(heads)
    ordered = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("audit").isNull(), *_ORDER
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = [
            ("conv_id", first.schema.field("conv_id").type),
            ("place", pa.int64()),
            ("role", pa.string()),
            ("text", pa.string()),
            ("edit", pa.string()),
        ]
        rows = apply_audits(_records(b for some in ([first], batches) for b in some))
        yield from _batched(schema, rows, lambda r: 64 + len(r[3]), 1 << 20)

    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(
        write, f"conv_id {kind}, place long, role string, text string, edit string"
    )


def digested(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from ``repaired_rows`` as they come."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = [("conv_id", first.schema.field("conv_id").type), ("repaired_sha256", pa.string())]
        yield from _batched(schema, digests(_records(b for some in ([first], batches) for b in some)))

    return repaired.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a report for each conversation that has rows, the repaired rows)."""
    marked = keep(_marked(rows), "rows")
    lines = _lines(marked)
    found = keep(audits(lines), "audits")
    counts = _counted(lines)
    counts = counts.withColumnRenamed("conv_id", "c_id")
    report = found.join(counts, F.col("conv_id").eqNullSafe(F.col("c_id"))).drop("c_id")
    return report, repaired_rows(marked, found)


def repair_digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conversations``: faults, audit and digest of ``rows`` repaired."""
    report, repaired = repair(rows)
    every = conversations.select("conv_id").distinct()
    for name, part in (("r_id", report), ("d_id", digested(repaired))):
        part = part.withColumnRenamed("conv_id", name)
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id",
        *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

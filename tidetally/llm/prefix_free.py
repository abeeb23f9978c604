"""Repeated strings by prefix-free parsing.

A document's bytes are parsed at rolling-hash triggers: a place is a trigger when
the hash of its next 16 bytes says so. Equal strings hold equal triggers, so a
string of ``WINDOW`` bytes is told by the rest of its first phrase, a dictionary
suffix, and by the parse from its first trigger on. Instead of sorting all
suffixes of a corpus on one machine, equal ones are brought together by name:

1. Windows that begin in one phrase, at similar distance from its trigger, are a
   piece. Its *family* is named by the parse that all its windows share, its
   *entry* by all bytes that they touch. Names are hashes made by doubling, as
   ranks are in the building of a suffix array: the name of 2n bytes is made of
   the names of their halves.
2. A family that occurs once holds no repeat. One with a single entry that
   occurs often is repeated as a whole: in corpus order its suffixes are
   neighbours with long common prefixes. Only families with several entries
   are looked at in detail, each distinct entry once: their single windows are
   named and counted.

Each step counts names with a fold on the map side, whatever their number, and
joins the counts back; a passage that a third of the documents share is one hot
name, not pairs. Where no trigger lies in a window's beginning a denser kind is
used; windows without either (short periods) are named one by one, each distinct
one of a document once.

Names have 64 bits: among n of them two unequal strings share one with a chance
of about ``n**2 / 2**65``.

Rows: a null text counts as empty; equal rows repeat each other; documents with
null ids are documents; an empty table gives no rows; further columns are
ignored.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.llm.batches import column, slices
from tidetally.session import keep

WINDOW = 400
TRIGGER = 16
#: One place in so many is a trigger; of the denser kind, used where there is none.
SPACING = (64, 8)
#: Windows are grouped by their distance from the trigger, in steps of so many bytes.
STEP = 128
STEPS = 3
REACH = STEP * STEPS

#: Bytes of text that are hashed at a time.
CHUNK = 1 << 19

# Any odd constants do.
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

WHOLE, WHOLE_AND_NAMED, NAMED = 1, 2, 3


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One name from two, in order."""
    x = a * K1
    x ^= x >> np.uint64(32)
    x += b
    x *= K2
    x ^= x >> np.uint64(29)
    return x


def names_by_doubling(data: bytes) -> dict[int, np.ndarray]:
    """Names of the next 16, 128 and 256 bytes at each place (of 256 zeros after the end)."""
    padded = data + bytes(512)
    size = len(data) + 264
    name = np.ndarray(size, "<u8", padded, 0, (1,)) * K2
    kept, length = {}, 8
    while length < 256:
        name = mix(name[:-length], name[length:]) if len(name) > length else name[:0]
        length *= 2
        if length in (TRIGGER, 128, 256):
            kept[length] = name
    return kept


@dataclass
class Parse:
    """Pieces of several documents: first and last window, family, entry; and the rest."""

    document: np.ndarray
    first: np.ndarray
    last: np.ndarray
    family: np.ndarray
    entry: np.ndarray
    loose: np.ndarray  # places of windows in no piece
    loose_document: np.ndarray
    names: dict[int, np.ndarray]

    def window_names(self, places: np.ndarray) -> np.ndarray:
        whole = self.names[256]
        return mix(whole[places], whole[places + WINDOW - 256])


def parse(data: bytes, ends: np.ndarray) -> Parse:
    """Parses documents that lie end to end in ``data``."""
    ends = np.asarray(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    names = names_by_doubling(data)
    found = []
    # Stretches of window starts that still lack a trigger: the whole documents at first.
    documents = np.flatnonzero(ends - begins >= WINDOW)
    low, high = begins[documents], ends[documents] - WINDOW
    for kind, spacing in enumerate(SPACING):
        marks = (names[TRIGGER][: len(data)] >> np.uint64(40)) % np.uint64(spacing) == 0
        places = np.flatnonzero(marks)
        # For each stretch its triggers, with a last one out of reach.
        a = np.searchsorted(places, low)
        b = np.searchsorted(places, high + REACH - 1, side="right")
        counts = b - a + 1
        owner = np.repeat(np.arange(len(low)), counts)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        is_last = rank == (b - a)[owner]
        at = np.where(
            is_last,
            high[owner] + REACH,
            places[np.minimum(a[owner] + rank, max(len(places) - 1, 0))] if len(places) else 0,
        )
        previous = np.where(rank == 0, low[owner] - 1, np.concatenate([[0], at[:-1]]))
        for step in range(STEPS):
            first = np.maximum(previous + 1, at - step * STEP - STEP + 1)
            last = np.minimum(at - step * STEP, high[owner])
            good = (first <= last) & ~is_last
            shared = WINDOW - step * STEP - STEP + 1  # bytes from the trigger in all these windows
            half = max(k for k in names if k <= shared)
            n, s, e = at[good], first[good], last[good]
            family = mix(names[half][n], names[half][n + shared - half] + np.uint64(8 * step + kind))
            offsets = ((n - s) * 1024 + (n - e)).astype(np.uint64)
            # Three names of 256 bytes: the first and the last leave out some in between.
            ends_named = mix(names[256][s], names[256][e + WINDOW - 256])
            entry = mix(ends_named, names[256][s + STEP]) + offsets * K1
            found.append((documents[owner[good]], s, e, family, mix(entry, family)))
        first = previous + 1
        last = np.minimum(at - REACH, high[owner])
        rest = first <= last
        documents, low, high = documents[owner[rest]], first[rest], last[rest]
    pieces = [np.concatenate(c) for c in zip(*found, strict=True)]
    counts = high - low + 1
    loose = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return Parse(*pieces, loose, np.repeat(documents, counts), names)


def parsed(texts: list[str | None]) -> Iterator[tuple[int, bytes, np.ndarray, Parse]]:
    """(number of the first text, bytes, document ends, parse) for some texts at a time."""
    held: list[bytes] = []
    size = first = 0
    for number, text in enumerate(texts):
        own = (text or "").encode()
        held.append(own)
        size += len(own)
        if size >= CHUNK or number == len(texts) - 1:
            data, ends = b"".join(held), np.cumsum([len(x) for x in held])
            yield first, data, ends, parse(data, ends)
            first, held, size = number + 1, [], 0


def distinct_entries(document: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each first occurrence in its document, times, number of the entry by piece)."""
    order = np.lexsort((entry, document))
    d, e = document[order], entry[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    group = np.cumsum(new) - 1
    number = np.empty(len(order), np.int64)
    number[order] = group
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    return first, np.bincount(group, minlength=len(first)), number


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = batch.column(batch.schema.get_field_index("row")).to_numpy(zero_copy_only=False)
        for first, _, _, p in parsed(column(batch, "text")):
            own, times, _ = distinct_entries(p.document, p.entry)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[first + p.document[own]], pa.int64()),
                    pa.array(signed(p.family[own])),
                    pa.array(signed(p.entry[own])),
                    pa.array(np.minimum(times, 2).astype(np.int32)),
                ],
                names=["row", "family", "entry", "times"],
            )


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes (begin, end) that windows starting at first to last cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate(last[order] + WINDOW) if len(order) else last
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    starts = np.flatnonzero(new)
    return begin[starts], end[np.append(starts[1:], len(begin)) - 1] if len(starts) else end[:0]


def kept_bytes(data: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    cuts = [0, *np.column_stack([begin, end]).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_FIELDS = [
    ("doc_id", pa.int64()),
    ("n_bytes", pa.int64()),
    ("n_removed", pa.int64()),
    ("n_spans", pa.int64()),
    ("kept_sha256", pa.string()),
]
DRAFT = pa.schema(
    [
        *RESULT_FIELDS,
        ("row", pa.int64()),
        ("text", pa.string()),
        ("first", pa.binary()),
        ("last", pa.binary()),
        ("windows", pa.binary()),
        ("names", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)
DRAFT_DDL = (
    RESULT + ", row long, text string, first binary, last binary, windows binary, "
    "names array<long>, times array<int>"
)


def outcome(doc_id, data: bytes, first: np.ndarray, last: np.ndarray) -> tuple:
    begin, end = merged(first, last)
    kept = kept_bytes(data, begin, end)
    return doc_id, len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()


def _draft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pieces decide; documents with windows left to look at keep their text.

    Of a piece that is repeated as a whole only one document names the windows,
    as partners for others; those count twice.
    """
    for batch in slices(batches):
        texts, doc_ids, rows = (column(batch, n) for n in ("text", "doc_id", "row"))
        entries, states = column(batch, "entries"), column(batch, "states")
        out = []
        for at, data, ends, p in parsed(texts):
            begins = np.concatenate([[0], ends[:-1]])
            by_document = np.argsort(p.document, kind="stable")
            cut = np.searchsorted(p.document[by_document], np.arange(len(ends) + 1))
            loose_cut = np.searchsorted(p.loose_document, np.arange(len(ends) + 1))
            for d in range(len(ends)):
                k = at + d
                own = by_document[cut[d] : cut[d + 1]]
                state = np.zeros(len(own), np.int8)
                if entries[k] and len(own):
                    known = np.array(entries[k], np.int64)
                    order = np.argsort(known)
                    place = np.minimum(
                        np.searchsorted(known[order], signed(p.entry[own])), len(known) - 1
                    )
                    hit = known[order][place] == signed(p.entry[own])
                    state = np.where(hit, np.array(states[k], np.int8)[order][place], 0)
                first, last = p.first[own], p.last[own]
                whole = (state == WHOLE) | (state == WHOLE_AND_NAMED)
                windows = np.concatenate(
                    [np.zeros(0, np.int64)]
                    + [np.arange(a, b + 1) for a, b in zip(first[state == NAMED], last[state == NAMED])]
                    + [p.loose[loose_cut[d] : loose_cut[d + 1]]]
                )
                names, number, times = np.unique(
                    signed(p.window_names(windows)), return_inverse=True, return_counts=True
                )
                # Windows that occur twice in this document are settled.
                settled = times[number] > 1 if len(windows) else np.zeros(0, bool)
                partners = [
                    np.arange(a, b + 1)
                    for a, b in zip(first[state == WHOLE_AND_NAMED], last[state == WHOLE_AND_NAMED])
                ]
                named = [(n, min(int(t), 2)) for n, t in zip(names.tolist(), times)]
                if partners:
                    named += [(n, 2) for n in set(signed(p.window_names(np.concatenate(partners))).tolist())]
                removed = np.concatenate([first[whole], windows[settled]]) - begins[d]
                removed_to = np.concatenate([last[whole], windows[settled]]) - begins[d]
                open_windows = windows[~settled] - begins[d]
                own_bytes = data[begins[d] : ends[d]]
                if len(open_windows):
                    result = (doc_ids[k], len(own_bytes), None, None, None)
                    rest = (
                        own_bytes.decode(),
                        removed.astype("<i4").tobytes(),
                        removed_to.astype("<i4").tobytes(),
                        open_windows.astype("<i4").tobytes(),
                    )
                else:
                    result, rest = outcome(doc_ids[k], own_bytes, removed, removed_to), (None,) * 4
                out.append((*result, rows[k], *rest, [n for n, _ in named], [t for _, t in named]))
        columns = list(zip(*out, strict=True)) or [[]] * len(DRAFT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, DRAFT, strict=True)], schema=DRAFT
        )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(RESULT_FIELDS)
    for batch in slices(batches):
        out = []
        for row in batch.to_pylist():
            data = row["text"].encode()
            first, last, windows = (np.frombuffer(row[n], "<i4") for n in ("first", "last", "windows"))
            names = names_by_doubling(data)[256]
            own = signed(mix(names[windows], names[windows + WINDOW - 256]))
            more = windows[np.isin(own, np.array(row["repeated"] or [], np.int64))]
            out.append(
                outcome(row["doc_id"], data, np.concatenate([first, more]), np.concatenate([last, more]))
            )
        columns = list(zip(*out, strict=True)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte that a ``WINDOW``-byte string covers which also starts
    anywhere else in the input.
    """
    texts = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    pieces = texts.select("row", "text").mapInArrow(
        _pieces, "row long, family long, entry long, times int"
    )
    # Stored counts are joined from outside, so that the join can split a family of any size.
    families = keep(
        pieces.groupBy("family")
        .agg(F.sum("times").alias("n"), F.min("entry").alias("a"), F.max("entry").alias("b"))
        .where("n > 1")
        .select("family", (F.col("a") == F.col("b")).alias("single")),
        "family-counts",
    )
    repeated = keep(pieces.join(families, "family").drop("family"), "families")
    entries = keep(
        repeated.where("not single")
        .groupBy("entry")
        .agg(F.sum("times").alias("n"), F.min("row").alias("partner")),
        "entry-counts",
    )
    state = (
        F.when(F.col("n") < 2, NAMED)
        .when(F.col("row") == F.col("partner"), WHOLE_AND_NAMED)
        .otherwise(WHOLE)
    )
    decided = (
        repeated.where("single")
        .select("row", "entry", F.lit(WHOLE).alias("state"))
        .union(repeated.where("not single").join(entries, "entry").select("row", "entry", state))
    )
    per_row = (
        decided.groupBy("row")
        .agg(F.collect_set(F.struct("entry", "state")).alias("known"))
        .select("row", F.col("known.entry").alias("entries"), F.col("known.state").alias("states"))
    )
    draft = keep(texts.join(per_row, "row", "left").mapInArrow(_draft, DRAFT_DDL), "draft")

    windows = draft.select(
        "row", F.col("text").isNotNull().alias("open"), F.explode(F.arrays_zip("names", "times")).alias("w")
    ).select("row", "open", F.col("w.names").alias("name"), F.col("w.times").alias("times"))
    often = windows.groupBy("name").agg(F.sum("times").alias("n")).where("n > 1").select("name")
    found = (
        windows.where("open")
        .join(often, "name")
        .groupBy("row")
        .agg(F.collect_set("name").alias("repeated"))
    )
    result = [name for name, _ in RESULT_FIELDS]
    finished = (
        draft.where("text is not null")
        .select("row", "doc_id", "text", "first", "last", "windows")
        .join(found, "row", "left")
        .mapInArrow(_finish, RESULT)
    )
    return draft.where("text is null").select(*result).unionByName(finished)

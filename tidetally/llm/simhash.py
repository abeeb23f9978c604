"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint is the bitwise majority of its shingles' XXH64. To find
fingerprints at most three bits apart, the 64 bits are cut into two segments of
32: one of them differs by at most one bit. Each distinct fingerprint is listed
under every segment variant with one bit left out, so that such a pair meets
under an equal key; within a key each pair is verified on all 64 bits.

A key shared by very many fingerprints is not given to one task: it is divided
again by one-wildcard variants of halves of the other segment, then of quarters.
That holds every pair, and the last keys leave 11 bits free, so no list is
longer than ``2 ** 11``. A task reports the links of a list as a forest of at
most one link per entry, never all pairs, which is all that components need.
Copies share a fingerprint and are listed once.

Rows: null and wordless texts have fingerprint zero, linked like any other;
shorter texts are one shingle; repeated rows and ids keep their rows; a
component whose ids are all null is null; an empty table gives no rows; further
columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetally.llm.batches import column, record, slices
from tidetally.llm.components import components
from tidetally.session import keep

SHINGLE = 3
MAX_BITS = 3
SEED = 42

#: A list of more fingerprints than this is divided again, while it can be.
LONGEST_LIST = 1024

#: Segments (lowest bit, width) that each level lists variants of, given the segment above.
LEVELS = ((0, 32), (32, 32)), ((0, 16), (16, 16)), ((0, 8), (8, 8))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the shingles' hashes; zero without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False)
    rows = map(b" ".join, grams) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(row, SEED) for row in rows], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, row (its id and text hashed) and fp, the fingerprint as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = [fingerprint(text, shingle) for text in column(batch, "text")]
            own = np.array(marks, np.uint64).view(np.int64)
            yield record(schema, column(batch, "doc_id"), column(batch, "row"), own)

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    return rows.mapInArrow(mark, "doc_id long, row long, fp long")


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """Lists each fingerprint under the variants of the level's segments.

    ``base`` is where the part of the fingerprint begins that the levels above
    have not fixed; ``path`` names the key, ``bit`` the bit left out.
    """
    out = None
    for number, (low, width) in enumerate(LEVELS[level]):
        places = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        at = F.col("base") + F.lit(low)
        segment = F.expr(f"shiftrightunsigned(fp, base + {low})").bitwiseAND(F.lit((1 << width) - 1))
        one = places.select(
            "fp",
            F.xxhash64(
                "path",
                F.lit(number),
                "place",
                segment.bitwiseAND(F.expr(f"~shiftleft(1L, place) & {(1 << width) - 1}L")),
            ).alias("path"),
            (at + F.col("place")).cast("int").alias("bit"),
            (F.col("place") == 0).alias("first"),
            # The rest lies in the other segment of this level.
            (F.col("base") + F.lit(width - low)).cast("int").alias("base"),
        )
        out = one if out is None else out.union(one)
    return out


def forest(values: np.ndarray, bit: int, first: bool, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect whatever the verified pairs of one list connect.

    Pairs that agree on the bit left out meet under every variant of the
    segment; they are looked at in the first one only.
    """
    n = len(values)
    links: list[tuple[int, int]] = []
    root = np.arange(n)
    side = (values >> np.uint64(bit)) & np.uint64(1)
    for i in range(n - 1):
        near = np.bitwise_count(values[i + 1 :] ^ values[i]) <= max_bits
        near &= root[i + 1 :] != root[i]
        if not first:
            near &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that give the right components.

    Verified pairs within ``max_bits`` (at most three, what two segments with
    one wildcard can hold).
    """
    if max_bits > 3:
        raise ValueError("two segments with one wildcard hold pairs of at most three bits")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists come sorted by path; one may go over the end of a batch."""
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(_rows(batch))
            rows = np.concatenate(held)
            cut = np.flatnonzero(rows["path"][1:] != rows["path"][:-1]) + 1
            if len(cut):
                yield from linked(rows[: cut[-1]], cut)
                rows = rows[cut[-1] :].copy()
            held = [rows]
        if held and len(held[0]):
            yield from linked(held[0], np.array([len(held[0])]))

    def linked(rows: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], ends[:-1]])
        a, b = [], []
        for low, high in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            own = rows[low:high]
            values = own["fp"].view(np.uint64)
            for i, j in forest(values, int(own["bit"][0]), bool(own["first"][0]), max_bits):
                a.append(own["fp"][i])
                b.append(own["fp"][j])
        yield record(schema, np.array(a, np.int64), np.array(b, np.int64))

    rows = distinct.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).alias("base"))
    found = None
    for level in range(len(LEVELS)):
        listed = _variants(rows, level)
        if level < len(LEVELS) - 1:
            sizes = listed.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
            sizes = sizes.withColumn("long", F.col("n") > LONGEST_LIST).drop("n")
            # A merge join by hint: the planner takes the variants to be as few as the fingerprints
            # they come from, a table to send to the driver.
            listed = keep(listed.join(sizes.hint("merge"), "path"), "lists")
            rows, listed = listed.where("long"), listed.where("not long")
        ordered = listed.select("path", "fp", "bit", "first").repartition("path")
        links = ordered.sortWithinPartitions("path").mapInArrow(link, "a long, b long")
        found = links if found is None else found.union(links)
        if level < len(LEVELS) - 1 and rows.isEmpty():
            break
    return found


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    kinds = [("path", np.int64), ("fp", np.int64), ("bit", np.int32), ("first", np.bool_)]
    rows = np.empty(batch.num_rows, kinds)
    for name, _ in kinds:
        rows[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return rows


def classes(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): each distinct fingerprint of ``marked`` with its component's."""
    distinct = keep(marked.select("fp").distinct(), "distinct")
    roots = components(fingerprint_links(distinct, max_bits))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    marked = keep(fingerprints(docs, shingle), "fingerprints")
    roots = classes(marked, max_bits)
    low = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    lowest = roots.join(low, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, all columns, one of each component: that with the smallest doc_id.

    A document is told by its id and text; of equal ids the smallest hash stays,
    and a null id only where all are null.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), whole)
    marked = keep(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    smallest = marked.groupBy("fp").agg(first)
    kept = (
        classes(marked, max_bits)
        .join(smallest, "fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    # Texts are shuffled once: repeats lie together where the join has put them.
    alike = Window.partitionBy("row").orderBy("row")
    first_of = rows.join(kept, "row").withColumn("place", F.row_number().over(alike))
    return first_of.where("place = 1").select(*(F.col(f"doc.`{c}`") for c in docs.columns))

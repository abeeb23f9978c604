"""Hard-negative mining: a secondary sort of packed pair scores, read as a stream.

For an anchor, its positives are the nearest other rows of its label; the hard
negatives of a positive are the nearest rows of other labels whose score lies
between two shares of the positive's. Anchors meet all rows in tiles, a block of
rows with a block of anchors. Of each tile only what can count is passed on: an
anchor's best rows of its own label first, from which its positives are known,
and then, for each positive, the best rows inside its window. That many per tile
are enough, whatever the labels' sizes.

A pair's score becomes the key (anchor, descending score, id): 17 bytes in which
byte order is that order, with positives before negatives of the same score.
``repartition`` by anchor and ``sortWithinPartitions`` by key (what
``repartitionAndSortWithinPartitions`` is for RDDs) bring an anchor's pairs
together in order. One pass over them opens a window at each positive and hands
it negatives until it has enough or the scores fall below it, so a task holds no
more of an anchor than its open windows.

Rows: a null id, label or vector, or a null, NaN or infinite component takes no
part; a vector meets those of its own length. Every other row takes part, also
those that share an id; partners of an anchor are the rows with another id, and
anchors that share an id are mined one by one. Repeated rows count each time.
Ties go to the smaller id. A score must fit 64 bits. An empty table gives no rows;
further columns are ignored.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetally.llm.batches import record
from tidetally.session import keep

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
SHARES = (30, 90)

#: Numbers that a block of rows holds at most, and rows of a block; anchors of a block.
BLOCK_NUMBERS = 1 << 22
BLOCK_ROWS = 1 << 16
ANCHOR_BLOCK = 1024
#: Tables of few rows are cut finer, into about so many blocks.
LEAST_BLOCKS = 32

PACKED = "block long, ids binary, rows binary, labels binary, numbers binary"
PAIRS = "anchor_row long, anchor_id long, vec_id long, score long"
PAIRS_SCHEMA = pa.schema([(n, pa.int64()) for n in ("anchor_row", "anchor_id", "vec_id", "score")])
KEYED = "anchor_row long, anchor_id long, key binary"
KEYED_SCHEMA = pa.schema(
    [("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("key", pa.binary())]
)
MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)
MINED_SCHEMA = pa.schema(
    [
        ("anchor_id", pa.int64()),
        ("positive_id", pa.int64()),
        ("rank", pa.int32()),
        ("negative_id", pa.int64()),
        ("positive_score", pa.int64()),
        ("negative_score", pa.int64()),
    ]
)

#: Largest value of each half of a key; signed numbers are shifted to sort as bytes.
_TOP = (1 << 63) - 1
_KEY = struct.Struct(">QBQ")


def pack_key(score: int, positive: bool, vec_id: int) -> bytes:
    """Bytes that sort by descending score, positives first, then ascending id."""
    return _KEY.pack(_TOP - score, 0 if positive else 1, vec_id + (1 << 63))


def unpack_key(key: bytes) -> tuple[int, bool, int]:
    score, kind, vec_id = _KEY.unpack(key)
    return _TOP - score, kind == 0, vec_id - (1 << 63)


def window(positive: int, shares: tuple[int, int] = SHARES) -> tuple[int, int]:
    """Least and largest score of a negative of this positive."""
    return -(-shares[0] * positive // 100), shares[1] * positive // 100


def labelled(embeddings: DataFrame, label: str | Column = "label", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, label, numbers) of the rows that take part, components as whole numbers."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    label = F.col(label) if isinstance(label, str) else label
    rows = embeddings.select("vec_id", label.cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        whole.alias("numbers"),
    )


def _blocks(rows: DataFrame, number: int) -> DataFrame:
    """About ``number`` blocks for each vector length, their rows sorted by id, as binary columns."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        own = {n: table[n].to_numpy().astype("<i8").tobytes() for n in ("vec_id", "row", "label")}
        flat = table["numbers"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.Table.from_pydict(
            {
                "block": pa.array([table["block"][0].as_py()], pa.int64()),
                "ids": pa.array([own["vec_id"]], pa.binary()),
                "rows": pa.array([own["row"]], pa.binary()),
                "labels": pa.array([own["label"]], pa.binary()),
                "numbers": pa.array([flat.astype("<f8").tobytes()], pa.binary()),
            }
        )

    block = F.size("numbers") * F.lit(number).cast("long") + F.pmod(F.xxhash64("row"), F.lit(number))
    return rows.withColumn("block", block).groupBy("block").applyInArrow(pack, PACKED)


def _tiles(blocks: DataFrame, number: int, anchors: DataFrame, anchor_blocks: int) -> DataFrame:
    """Each block of rows with each block of anchors of its vector length (columns q_...).

    The anchors, which are few, are copied to the blocks. Both sides are dealt to a
    stated number of tasks, which adaptive execution doesn't merge by bytes.
    """
    sent = anchors.select(
        F.expr(f"block div {anchor_blocks}").alias("dim"),
        *(F.col(n).alias(f"q_{n}") for n in anchors.columns if n != "block"),
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    sent = sent.select((F.col("dim") * number + F.col("part")).alias("block"), *sent.columns[1:-1])
    tasks = 2 * number
    return blocks.repartition(tasks, "block").join(sent.repartition(tasks, "block"), "block")


def _unpacked(row: dict, mark: str = "") -> tuple[np.ndarray, ...]:
    ids, rows, labels = (np.frombuffer(row[mark + n], "<i8") for n in ("ids", "rows", "labels"))
    return ids, rows, labels, np.frombuffer(row[mark + "numbers"], "<f8").reshape(len(ids), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exactly; raises where they might not fit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number a double can hold
    if most >= 2.0**62:
        raise ValueError("scores of these vectors don't fit 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The k of ``among`` with the highest scores; ``among`` is in order of preference at ties."""
    if len(among) > k:
        own = scores[among]
        floor = np.partition(own, len(own) - k)[len(own) - k]
        among = among[own >= floor]
    return among[np.argsort(-scores[among], kind="stable")[:k]]


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}


def _own_label(tiles: DataFrame, positives: int) -> DataFrame:
    """Each anchor's best rows of its label in each tile."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _rows_of(batches):
            ids, _, labels, x = _unpacked(tile)
            q_ids, q_rows, q_labels, q = _unpacked(tile, "q_")
            scores = products(q, x)
            out = [[], [], [], []]
            for i, own in enumerate(scores):
                near = first(
                    own, np.flatnonzero((labels == q_labels[i]) & (ids != q_ids[i])), positives
                )
                for column, values in zip(
                    out,
                    (np.full(len(near), q_rows[i]), np.full(len(near), q_ids[i]), ids[near], own[near]),
                    strict=True,
                ):
                    column.append(values)
            yield record(PAIRS_SCHEMA, *(np.concatenate(c) for c in out))

    return tiles.mapInArrow(find, PAIRS)


def positives_of(tiles: DataFrame, positives: int) -> DataFrame:
    """(anchor_row, anchor_id, vec_id, score): the first rows of each anchor's label."""
    order = Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id")
    found = _own_label(tiles, positives).withColumn("place", F.row_number().over(order))
    return found.where(F.col("place") <= positives).drop("place")


def _inside(tiles: DataFrame, negatives: int, shares: tuple[int, int]) -> DataFrame:
    """Keys of the rows of other labels that are among the first of one of an anchor's windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _rows_of(batches):
            ids, _, labels, x = _unpacked(tile)
            q_ids, q_rows, q_labels, q = _unpacked(tile, "q_")
            anchors, names, keys = [], [], []
            opened = dict(zip(tile["q_own"], tile["q_scores"], strict=True))
            scores = products(q, x)
            for i, own in enumerate(scores):
                other = np.flatnonzero((labels != q_labels[i]) & (ids != q_ids[i]))
                taken = set()
                for low, high in {window(p, shares) for p in opened.get(int(q_rows[i]), ())}:
                    near = other[(own[other] >= low) & (own[other] <= high)]
                    taken.update(first(own, near, negatives).tolist())
                anchors += [int(q_rows[i])] * len(taken)
                names += [int(q_ids[i])] * len(taken)
                keys += [pack_key(int(own[j]), False, int(ids[j])) for j in taken]
            yield record(KEYED_SCHEMA, anchors, names, keys)

    return tiles.mapInArrow(find, KEYED)


def _openings(found: DataFrame) -> DataFrame:
    """Keys of the positives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names, ids, scores = (batch.column(i).to_pylist() for i in range(4))
            keys = [pack_key(score, True, i) for score, i in zip(scores, ids, strict=True)]
            yield record(KEYED_SCHEMA, rows, names, keys)

    return found.select("anchor_row", "anchor_id", "vec_id", "score").mapInArrow(pack, KEYED)


def stream(
    rows: Iterator[tuple[int, int, bytes]], negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Mined rows from (anchor row, anchor id, key) in order; holds the open windows only."""
    current, opened = None, []
    for anchor_row, anchor_id, key in rows:
        if anchor_row != current:
            current, opened = anchor_row, []
        score, positive, vec_id = unpack_key(key)
        if positive:
            opened.append([vec_id, score, *window(score, shares), 0])
            continue
        # Scores only fall: a window that is full or lies above is done.
        opened = [w for w in opened if w[4] < negatives and w[2] <= score]
        for w in opened:
            if score <= w[3]:
                w[4] += 1
                yield anchor_id, w[0], w[4], vec_id, w[1], score


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    label: str | Column = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shares: tuple[int, int] = SHARES,
    scale: int = SCALE,
) -> DataFrame:
    """Each anchor's positives with their hard negatives, ranked from 1."""
    rows = keep(labelled(embeddings, label, scale), "labelled")
    anchors = rows.where(is_anchor)
    count, width, asked = rows.agg(
        F.count("*"), F.max(F.size("numbers")), F.count(F.when(is_anchor, 1))
    ).first()
    size = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // max(1, width or 1), -(-count // LEAST_BLOCKS)))
    number, asked_blocks = max(1, -(-count // size)), max(1, -(-asked // ANCHOR_BLOCK))
    blocks = keep(_blocks(rows, number), "blocks")
    asking = keep(_blocks(anchors, asked_blocks), "anchors")

    found = keep(positives_of(_tiles(blocks, number, asking, asked_blocks), positives), "positives")
    # An anchor's windows travel with its block: at most ``positives`` numbers an anchor.
    block = F.size("numbers") * F.lit(asked_blocks).cast("long") + F.pmod(
        F.xxhash64("row"), F.lit(asked_blocks)
    )
    windows = (
        found.groupBy(F.col("anchor_row").alias("row"))
        .agg(F.collect_list("score").alias("scores"))
        .join(anchors.select("row", block.alias("block")), "row")
        .groupBy("block")
        .agg(F.collect_list(F.struct("row", "scores")).alias("all"))
        .select("block", F.col("all.row").alias("own"), F.col("all.scores").alias("scores"))
    )
    tiles = _tiles(blocks, number, asking.join(windows, "block"), asked_blocks)

    pairs = _inside(tiles, negatives, shares).unionByName(_openings(found))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = (
            pair
            for batch in batches
            for pair in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        )
        out = []
        for row in stream(pairs, negatives, shares):
            out.append(row)
            if len(out) == 4096:
                yield record(MINED_SCHEMA, *zip(*out, strict=True))
                out = []
        if out:
            yield record(MINED_SCHEMA, *zip(*out, strict=True))

    ordered = pairs.repartition(2 * number, "anchor_row").sortWithinPartitions("anchor_row", "key")
    return ordered.mapInArrow(mine, MINED)

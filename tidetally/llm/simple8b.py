"""Token ids in a file: Simple-8b words in frames of whole documents.

A word of 64 bits holds a selector of 4 bits and as many ids as fit in equal
widths into the other 60. Ids of more than ``ESCAPE_BITS`` bits are escapes: the
words hold a zero and the id is listed with its place. A frame is one row of the
written table: ids of consecutive documents in ascending doc_id order (of equal
ids by the text's hash), cut into blocks that begin on a word; the blocks' word
offsets let a reader decode any block alone, with array operations only. A
frame ends after the document that fills it, so that a long text is one frame.

Rows: a null text counts as empty; documents with a null id come first;
repeated rows are written as often as they occur; an empty table gives an empty
file; further columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetally.llm.batches import column, record, slices
from tidetally.llm.tokens import word_ids
from tidetally.session import scratch_path

#: Ids per word and bits per id of each selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

ESCAPE_BITS = 20
BLOCK_IDS = 4096
FRAME_IDS = 65_536
END_ID = 2

FRAMES = pa.schema(
    [
        ("part", pa.int32()),
        ("frame", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("n", pa.int64()),
        ("words", pa.binary()),
        ("block_offsets", pa.list_(pa.int32())),
        ("escape_places", pa.list_(pa.int32())),
        ("escape_ids", pa.list_(pa.int64())),
    ]
)
FRAMES_DDL = (
    "part int, frame long, doc_ids array<long>, n_tokens array<long>, n long, words binary, "
    "block_offsets array<int>, escape_places array<int>, escape_ids array<long>"
)


#: Zeros behind each block while it is worked on, so that no word reaches the next one.
STRIDE = BLOCK_IDS + int(COUNTS[0])


def selectors_of(ids: np.ndarray, real: np.ndarray) -> np.ndarray:
    """For each place the selector of a word that starts there: the most ids that fit.

    ``real`` says where there are ids; the zeros behind them only fill words up.
    """
    widths = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    best = np.full(len(ids), len(COUNTS) - 1, np.uint8)
    widest, count = widths, 1  # the widest of the next ``count`` ids
    for s in range(len(COUNTS) - 2, -1, -1):
        ahead = int(COUNTS[s]) - count
        widest = np.maximum(widest[: len(widest) - ahead], widest[ahead:])
        count += ahead
        fits = widest <= WIDTHS[s]
        if not (fits & real[: len(fits)]).any():  # then more ids in fewer bits don't fit either
            break
        best[: len(fits)][fits] = s
    return best


def encode(ids: np.ndarray) -> tuple[bytes, list[int], np.ndarray, np.ndarray]:
    """(words, first word of each block, places of escapes, their ids)."""
    n = len(ids)
    ids = ids.astype(np.uint64)
    places = np.flatnonzero(ids >> np.uint64(ESCAPE_BITS))
    escapes = ids[places]
    ids[places] = 0
    blocks = -(-n // BLOCK_IDS)
    padded = np.zeros((blocks + 1, STRIDE), np.uint64)
    padded[:blocks, :BLOCK_IDS] = np.pad(ids, (0, blocks * BLOCK_IDS - n)).reshape(blocks, BLOCK_IDS)
    padded = padded.ravel()
    real = np.zeros((blocks + 1, STRIDE), bool)
    real[:blocks, :BLOCK_IDS] = np.arange(blocks * BLOCK_IDS).reshape(blocks, BLOCK_IDS) < n
    best = selectors_of(padded, real.ravel())
    steps = COUNTS[best].tolist()
    starts, offsets = [], []
    for k in range(blocks):
        offsets.append(len(starts))
        at = k * STRIDE
        end = at + min(BLOCK_IDS, n - k * BLOCK_IDS)
        while at < end:
            starts.append(at)
            at += steps[at]
    starts = np.array(starts, np.int64)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selectors):
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            packed = words[rows]
            for k in range(COUNTS[s]):
                packed |= padded[starts[rows] + k] << np.uint64(k * WIDTHS[s])
            words[rows] = packed
    return words.astype("<u8").tobytes(), offsets, places, escapes


def decode(words: bytes, offsets: list[int], places, escapes, n: int) -> np.ndarray:
    """The ``n`` ids that ``encode`` was given; the offsets give each block its place."""
    data = np.frombuffer(words, "<u8")
    selectors = (data >> np.uint64(60)).astype(np.int64)
    blocks = len(offsets)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    sizes = np.diff([*offsets, len(data)]) if blocks else np.zeros(0, np.int64)
    first = before[np.asarray(offsets, np.int64)]
    starts = before + np.repeat(np.arange(blocks) * STRIDE - first, sizes)
    out = np.zeros(blocks * STRIDE, np.uint64)
    for s in np.unique(selectors):
        if WIDTHS[s]:
            rows = np.flatnonzero(selectors == s)
            at, own = starts[rows], data[rows]
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                out[at + k] = (own >> np.uint64(k * WIDTHS[s])) & mask
    ids = out.reshape(blocks, STRIDE)[:, :BLOCK_IDS].ravel()[:n]
    ids[np.asarray(places, np.int64)] = np.asarray(escapes, np.uint64)
    return ids


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Tokenizes whole texts and writes their ids in ascending doc_id order."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        frame, doc_ids, lengths, held, size = 0, [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            data, offsets, places, escapes = encode(ids)
            row = (part, frame, doc_ids, lengths, len(ids), data, offsets, places, escapes)
            return record(FRAMES, *([x] for x in row))

        for batch in slices(batches):
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = words.of(text) + end
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= FRAME_IDS:
                    yield flush()
                    frame, doc_ids, lengths, held, size = frame + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(frames, FRAMES_DDL)
        .write.parquet(path)
    )


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document of a written file: doc_id, start, n_tokens, ids_crc32 and the ids.

    ``start`` counts the ids of all documents before it; ``ids`` is binary,
    little-endian unsigned 32 bits. Frame starts are summed within the file's
    parts and over the parts' totals, one row each.
    """
    frames = spark.read.schema(FRAMES_DDL).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_start"))
    earlier = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        frames.select("part", "frame", "n")
        .withColumn("frame_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(parts, "part")
        .select("part", "frame", (F.col("frame_start") + F.col("part_start")).alias("frame_start"))
    )
    schema = pa.schema(
        [
            ("part", pa.int32()),
            ("frame", pa.int64()),
            ("doc_id", pa.int64()),
            ("in_frame", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("ids", pa.binary()),
        ]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = decode(
                row["words"], row["block_offsets"], row["escape_places"], row["escape_ids"], row["n"]
            )
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(row["n_tokens"])
            begins = ends - row["n_tokens"]
            own = [data[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]
            count = len(own)
            yield record(
                schema,
                [row["part"]] * count,
                [row["frame"]] * count,
                row["doc_ids"],
                begins,
                row["n_tokens"],
                [zlib.crc32(x) for x in own],
                [bytes(x) for x in own] if with_ids else [None] * count,
            )

    decoded = frames.mapInArrow(
        documents,
        "part int, frame long, doc_id long, in_frame long, n_tokens long, ids_crc32 long, ids binary",
    )
    columns = ["n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return decoded.join(starts, ["part", "frame"]).select(
        "doc_id", (F.col("frame_start") + F.col("in_frame")).alias("start"), *columns
    )


def token_file(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' ids to a new file and describes each document from it."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, tokenizer)
    return read_ids(spark, path, with_ids=False)

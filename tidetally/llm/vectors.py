"""Vectors in blocks: what the two searches have in common."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one task holds at a time; candidates come in blocks of their own.
QUERY_BLOCK = 2048

PACKED = "block int, dim int, ids binary, numbers binary"
PACKED_SCHEMA = pa.schema(
    [("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary())]
)


def usable(embeddings: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part.

    Null ids and vectors, null, NaN and infinite components do not, nor, unless
    ``zero``, vectors of zeros. Rows that share an id all do: as candidates their id
    counts by its best row, as queries by the best of theirs.
    """
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    good = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>")).where(good)
    if not zero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("dim", F.size("embedding"))


def packed(rows: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    """(blocks, their number): about ``size`` rows each, of one dimension, as binary columns.

    All rows of an id lie in one block.
    """
    blocks = max(1, -(-count // size))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table["vec_id"].to_numpy().astype("<i8")
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.Table.from_pylist(
            [
                {
                    "block": table["block"][0].as_py(),
                    "dim": table["dim"][0].as_py(),
                    "ids": ids.tobytes(),
                    "numbers": flat.astype("<f8").tobytes(),
                }
            ],
            schema=PACKED_SCHEMA,
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block", "dim").applyInArrow(pack, PACKED), blocks


def unpack(ids: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, "<i8")
    return names, np.frombuffer(numbers, "<f8").reshape(len(names), -1)


def against_queries(blocks: DataFrame, number: int, queries: DataFrame, count: int) -> DataFrame:
    """Each of ``number`` blocks with each block of queries (q_ids, q_numbers) of its dimension.

    The queries, which are few, are copied to the blocks. Both are dealt to a stated
    number of tasks, which adaptive execution does not merge by bytes.
    """
    query_blocks, _ = packed(queries, count, QUERY_BLOCK)
    tile = F.col("dim").cast("long") * number
    asked = query_blocks.select(
        tile.alias("first_tile"), F.col("ids").alias("q_ids"), F.col("numbers").alias("q_numbers")
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    asked = asked.select((F.col("first_tile") + F.col("part")).alias("tile"), "q_ids", "q_numbers")
    tasks = 2 * number
    return (
        blocks.withColumn("tile", tile + F.col("block"))
        .repartition(tasks, "tile")
        .join(asked.repartition(tasks, "tile"), "tile")
    )


def distinct_best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each by its best row: highest score, then smallest id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query: highest score, then smallest vec_id."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}

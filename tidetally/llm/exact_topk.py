"""Exact top-k by inner product: multi-resolution segment statistics.

A vector is cut into segments; each is described by its mean and its deviation
(the norm of what is left without the mean). With those alone the squared
distance of two vectors is at least

    sum over segments of  length * (mean - mean')**2 + (deviation - deviation')**2

and so, the vectors' norms being known, their inner product is at most the sum
of length * mean * mean' + deviation * deviation'. Candidates come in blocks with
their statistics at all resolutions. Within a block the exact scores of the
candidates with the best coarse bounds give a query its threshold; candidates
whose bound lies below it fall out, coarse to fine, and the survivors' products
are computed exactly. The blocks' best rows are merged.

Rows: see ``vectors.usable``; vectors are compared with those of their own
dimension; the query's own row is the one with its id; an empty table gives no
rows; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.llm.batches import record
from tidetally.llm.vectors import (
    against_queries,
    best,
    distinct_best,
    packed,
    rows_of,
    unpack,
    usable,
)
from tidetally.session import keep

SCALE = 1024
TOP = 10
BLOCK = 8192
#: Tables of few rows are cut finer, into about so many blocks.
LEAST_BLOCKS = 16
#: Segments of a vector at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)
#: Queries worked on at a time within a block.
CHUNK = 256

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means (times the root of their lengths) and deviations."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, max(1, x.shape[1])))
    columns = []
    for part in parts:
        own = x[:, part]
        mean = own.mean(axis=1) if len(part) else np.zeros(len(x))
        columns += [np.sqrt(len(part)) * mean, np.linalg.norm(own - mean[:, None], axis=1)]
    return np.column_stack(columns)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exactly."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2.0**53:
        return (a @ b.T).astype(np.int64)  # every partial sum is a whole number a double can hold
    return a.astype(np.int64) @ b.astype(np.int64).T


def top_of_block(
    ids: np.ndarray, x: np.ndarray, stats: list[np.ndarray], q_ids: np.ndarray, q: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, candidate ids, scores) of each query's best k in the block."""
    # Bounds are rounded up by more than their sums can be off.
    slack = 1e-9 * (1 + np.linalg.norm(x, axis=1).max(initial=0))
    for at in range(0, len(q), CHUNK):
        some, names = q[at : at + CHUNK], q_ids[at : at + CHUNK]
        own = [statistics(some, s) for s in RESOLUTIONS]
        extra = slack * (1 + np.linalg.norm(some, axis=1))
        coarse = own[0] @ stats[0].T + extra[:, None]
        coarse[names[:, None] == ids[None, :]] = -np.inf
        first = min(2 * k, len(ids))
        probe = np.argpartition(-coarse, first - 1, axis=1)[:, :first]
        for i, name in enumerate(names):
            tried = probe[i][coarse[i, probe[i]] > -np.inf]
            exact = products(some[i : i + 1], x[tried])[0]
            leading = distinct_best(ids[tried], exact, k)
            floor = exact[leading[-1]] if len(leading) >= k else -np.inf
            alive = np.flatnonzero((coarse[i] >= floor) & (coarse[i] > -np.inf))
            for mine, theirs in zip(own[1:], stats[1:], strict=True):
                alive = alive[theirs[alive] @ mine[i] + extra[i] >= floor]
            exact = products(some[i : i + 1], x[alive])[0]
            order = distinct_best(ids[alive], exact, k)
            yield int(name), ids[alive][order], exact[order]


def exact_top_k(embeddings: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products."""
    scaled = F.transform("embedding", lambda v: F.floor(v * scale).cast("double"))
    rows = keep(usable(embeddings, zero=True).withColumn("embedding", scaled), "vectors")
    queries = rows.where(is_query)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in rows_of([batch]):
                _, x = unpack(row["ids"], row["numbers"])
                found.append([statistics(x, s).tobytes() for s in RESOLUTIONS])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.binary()))],
                names=[*batch.schema.names, "stats"],
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, x = unpack(row["ids"], row["numbers"])
            stats = [np.frombuffer(s).reshape(len(ids), -1) for s in row["stats"]]
            q_ids, q = unpack(row["q_ids"], row["q_numbers"])
            names, others, scores = [], [], []
            for name, near, score in top_of_block(ids, x, stats, q_ids, q, k):
                names.append(np.full(len(near), name))
                others.append(near)
                scores.append(score)
            yield record(FOUND, *(np.concatenate(c) for c in (names, others, scores)))

    count = rows.count()
    blocks, number = packed(rows, count, max(1, min(BLOCK, -(-count // LEAST_BLOCKS))))
    described = keep(
        blocks.mapInArrow(
            describe, "block int, dim int, ids binary, numbers binary, stats array<binary>"
        ),
        "segments",
    )
    paired = against_queries(described, number, queries, queries.count())
    return best(paired.mapInArrow(search, "query_id long, vec_id long, score long"), k)

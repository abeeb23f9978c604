"""Approximate nearest neighbours: a navigable small-world graph per shard.

Rows are dealt to shards by id. A shard's distinct vectors become the nodes of a
hierarchical navigable small-world graph, stored as one flat array of
neighbours a layer; every row is indexed, copies through their node. Queries
come in blocks and search each shard's graph in lock step; all members of the
nodes found are scored exactly on the original vectors and the shards' results
merged.

The largest inner product is the smallest distance once each vector of a shard
has a further component that makes all norms equal, so the graph is built on
those. Nodes are added in batches (in an order of their own hash): a batch
searches the graph as it is, sees its own members directly, and links to chosen
neighbours, which link back and choose anew where they have too many.

Rows: see ``vectors.usable`` (vectors of zeros take no part here); vectors are
compared with those of their own dimension; the query's own row is the one with
its id; an empty table gives no rows; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

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

TOP = 20
SHARD = 4096
#: Links of a node in the lowest layer and in the others.
LINKS = (32, 16)
#: Candidates a node is linked from, and that a query keeps in each shard.
BUILD_WIDTH = 64
SEARCH_WIDTH = 192
#: Nodes expanded at a time, and added at a time.
BEAM = 8
BATCH = 256

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search_layer(
    x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: (nodes, products), best first.

    Free places hold node -1 and -inf.
    """
    n = len(q)
    each = np.arange(n)[:, None]
    width = max(width, start.shape[1])
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where -1 points
    nodes = np.full((n, width), -1)
    nodes[:, : start.shape[1]] = start
    near = np.full((n, width), -np.inf, x.dtype)
    near[:, : start.shape[1]] = np.einsum("bsd,bd->bs", x[start], q)
    near[nodes < 0] = -np.inf
    seen[each, start] = True
    opened = nodes < 0
    while True:
        rank = np.where(opened, -np.inf, near)
        pick = np.argpartition(-rank, min(BEAM, width) - 1, axis=1)[:, : min(BEAM, width)]
        live = rank[each, pick] > -np.inf
        active = np.flatnonzero(live.any(axis=1))
        if not len(active):
            order = np.argsort(-near, axis=1, kind="stable")
            return nodes[each, order], near[each, order]
        pick, live, at = pick[active], live[active], active[:, None]
        opened[at, pick] |= live
        from_nodes = np.where(live, nodes[at, pick], -1)
        new = np.where(from_nodes[:, :, None] >= 0, links[from_nodes], -1).reshape(len(active), -1)
        new = np.sort(new, axis=1)  # the same node may be reached from two
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[at, new]] = -1
        seen[at, new] = True
        products = np.einsum("bsd,bd->bs", x[new], q[active])
        products[new < 0] = -np.inf
        all_near = np.concatenate([near[active], products], axis=1)
        top = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        row = np.arange(len(active))[:, None]
        near[active] = all_near[row, top]
        nodes[active] = np.concatenate([nodes[active], new], axis=1)[row, top]
        opened[active] = np.concatenate([opened[active], new < 0], axis=1)[row, top]


def choose(x: np.ndarray, owners: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each owner out of ``nodes`` (best first, -1 free).

    One that is closer to a chosen one than to the owner is passed over; what
    then remains free is filled with the best of those passed over.
    """
    n, width = nodes.shape
    own = np.einsum("bsd,bd->bs", x[nodes], x[owners])
    own[nodes < 0] = -np.inf
    between = np.einsum("bsd,btd->bst", x[nodes], x[nodes])
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), -np.inf, x.dtype)  # to any chosen one
    for j in range(width):
        take = (nodes[:, j] >= 0) & (closest[:, j] < own[:, j]) & (chosen.sum(axis=1) < most)
        chosen[:, j] = take
        closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
    order = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")
    picked = np.take_along_axis(nodes, order[:, :most], axis=1)
    if width < most:
        picked = np.pad(picked, ((0, 0), (0, most - width)), constant_values=-1)
    return picked


def link_back(x: np.ndarray, links: np.ndarray, sources: np.ndarray, picked: np.ndarray) -> None:
    """Adds the reverse of new links; nodes with too many choose among old and new."""
    most = links.shape[1]
    targets, origins = picked.ravel(), np.repeat(sources, picked.shape[1])
    order = np.argsort(targets, kind="stable")
    order = order[targets[order] >= 0]
    targets, origins = targets[order], origins[order]
    nodes, first, counts = np.unique(targets, return_index=True, return_counts=True)
    for low in range(0, len(nodes), BATCH):
        some, begin, count = nodes[low : low + BATCH], first[low : low + BATCH], counts[low : low + BATCH]
        place = np.arange(count.max())
        new = np.where(
            place < count[:, None], origins[np.minimum(begin[:, None] + place, len(origins) - 1)], -1
        )
        both = np.concatenate([links[some], new], axis=1)
        near = np.einsum("bsd,bd->bs", x[both], x[some])
        near[both < 0] = -np.inf
        best_first = np.argsort(-near, axis=1, kind="stable")[:, : 2 * most]
        links[some] = choose(x, some, np.take_along_axis(both, best_first, axis=1), most)


def equal_norms(x: np.ndarray) -> np.ndarray:
    """The vectors with the component that gives all the largest norm; a row of zeros for -1."""
    squares = (x * x).sum(axis=1)
    extra = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.vstack([np.column_stack([x, extra]), np.zeros(x.shape[1] + 1)]).astype(np.float32)


def build(x: np.ndarray, seed: int) -> tuple[list[np.ndarray], int]:
    """(layers, entry): neighbours of each node, lowest layer first (-1: free), and where to begin.

    ``x`` has the row for -1.
    """
    n = len(x) - 1
    rng = np.random.default_rng(seed)
    levels = np.minimum(np.floor(rng.exponential(1 / np.log(LINKS[1]), n)), 8).astype(int)
    order = rng.permutation(n)
    order = np.concatenate([[order[levels[order].argmax()]], order[order != order[levels[order].argmax()]]])
    top = int(levels.max(initial=0))
    # One row more, for -1.
    layers = [np.full((n + 1, LINKS[0] if k == 0 else LINKS[1]), -1) for k in range(top + 1)]
    done = 1
    while done < n:
        batch = order[done : done + min(BATCH, done)]
        start = np.full((len(batch), 1), order[0])
        for k in range(top, -1, -1):
            joins = levels[batch] >= k
            found, _ = search_layer(x, layers[k], x[batch], start, BUILD_WIDTH if joins.any() else 4)
            start = found[:, :4]
            if joins.any():
                sources = batch[joins]
                near = np.where(found >= 0, found, -1)[joins]
                # What joins at the same time isn't in the graph yet.
                mates = np.broadcast_to(sources, (len(sources), len(sources))).copy()
                np.fill_diagonal(mates, -1)
                both = np.concatenate([near, mates], axis=1)
                products = np.concatenate(
                    [np.einsum("bsd,bd->bs", x[near], x[sources]), x[sources] @ x[sources].T], axis=1
                )
                products[both < 0] = -np.inf
                best_first = np.argsort(-products, axis=1, kind="stable")[:, :BUILD_WIDTH]
                picked = choose(x, sources, np.take_along_axis(both, best_first, axis=1), LINKS[1])
                layers[k][sources, : LINKS[1]] = picked
                link_back(x, layers[k], sources, picked)
        done += len(batch)
    return layers, int(order[0])


def search(
    x: np.ndarray, layers: list[np.ndarray], entry: int, q: np.ndarray, width: int
) -> np.ndarray:
    """The nodes found for each query, -1 where fewer."""
    start = np.full((len(q), 1), entry)
    q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
    for k in range(len(layers) - 1, 0, -1):
        start = search_layer(x, layers[k], q, start, 4)[0]
    return search_layer(x, layers[0], q, start, width)[0]


def index(embeddings: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame, int]:
    """(rows that take part, one graph a shard, shards): every row is in one of the graphs."""
    rows = keep(usable(embeddings, zero=False), "vectors")
    blocks, number = packed(rows, rows.count(), shard)

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, entries, nodes = [], [], []
            for row in rows_of([batch]):
                _, numbers = unpack(row["ids"], row["numbers"])
                distinct, node = np.unique(numbers, axis=0, return_inverse=True)
                layers, entry = build(equal_norms(distinct), row["block"])
                entries.append(entry)
                flat.append([layer.astype("<i4").tobytes() for layer in layers])
                nodes.append(node.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(nodes, pa.binary()),
                    pa.array(flat, pa.list_(pa.binary())),
                    pa.array(entries, pa.int32()),
                ],
                names=[*batch.schema.names, "nodes", "layers", "entry"],
            )

    graphs = blocks.mapInArrow(
        graph,
        "block int, dim int, ids binary, numbers binary, nodes binary, layers array<binary>, entry int",
    )
    return rows, keep(graphs, "graphs"), number


def search_graphs(
    graphs: DataFrame, number: int, queries: DataFrame, k: int = TOP, width: int = SEARCH_WIDTH
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query in ``number`` shards."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ids, numbers = unpack(row["ids"], row["numbers"])
            node = np.frombuffer(row["nodes"], "<i4")
            distinct = np.zeros((node.max() + 1, numbers.shape[1]))
            distinct[node] = numbers
            layers = [
                np.frombuffer(flat, "<i4").reshape(len(distinct) + 1, -1) for flat in row["layers"]
            ]
            # Members of each node, by id: the first k + 1 hold any k but the query's own.
            order = np.lexsort((ids, node))
            repeat = (np.diff(ids[order]) == 0) & (np.diff(node[order]) == 0)
            order = order[np.concatenate([[True], ~repeat])]
            begins = np.searchsorted(node[order], np.arange(len(distinct) + 1))
            x = equal_norms(distinct)
            q_ids, q = unpack(row["q_ids"], row["q_numbers"])
            names, others, scores = [], [], []
            for at in range(0, len(q), BATCH):
                part = q[at : at + BATCH]
                found = search(x, layers, row["entry"], part, width)
                for name, vector, hits in zip(q_ids[at : at + BATCH], part, found, strict=True):
                    hits = hits[hits >= 0]
                    members = np.concatenate(
                        [order[begins[h] : min(begins[h + 1], begins[h] + k + 1)] for h in hits]
                    )
                    members = members[ids[members] != name]
                    product = numbers[members] @ vector
                    top = distinct_best(ids[members], product, k)
                    names.append(np.full(len(top), name))
                    others.append(ids[members][top])
                    scores.append(product[top])
            yield record(FOUND, *(np.concatenate(c) for c in (names, others, scores)))

    paired = against_queries(graphs, number, queries, queries.count())
    return best(paired.mapInArrow(find, "query_id long, vec_id long, score double"), k)


def nearest(embeddings: DataFrame, is_query, k: int = TOP, shard: int = SHARD) -> DataFrame:
    """Indexes all rows and searches for those that ``is_query`` names."""
    rows, graphs, number = index(embeddings, shard)
    return search_graphs(graphs, number, rows.where(is_query), k)

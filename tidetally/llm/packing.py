"""Best-fit packing: pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens. Their lengths form a
histogram of at most ``capacity`` bins, the only thing the driver sees. Patterns
of up to three lengths that fill a sequence, listed on a grid, are fitted to it
and their repeat counts rounded down. A pattern takes the longest pieces of its
grid cells, by exact length, and one that fills what the others leave to the
token; what is left in the end is packed by best fit on exact lengths, whole bins
at a time. The result is a list of patterns with counts, at most about one
for each length; Spark then numbers the pieces of each length and joins number
to pattern.

Rows: a null text counts as empty (one piece holding the closing id); repeated
rows and null ids are packed like any other; an empty table gives no rows;
further columns are ignored.
"""

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidetally.llm.batches import column, record, slices
from tidetally.llm.running import running_total, spread
from tidetally.llm.tokens import word_ids
from tidetally.session import keep

CAPACITY = 2048
GRID = 8
CLOSING_ID = 0
#: Shares of the fitted repeat counts that are tried.
SHARES = (1, 0.75, 0.5, 0.25, 0)

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Each document's ids with the closing id, cut every ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = memoryview(words.of(text) + closing)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield record(PIECES, *(list(zip(*rows, strict=True)) or [[]] * 5))

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def full_patterns(bins: int) -> list[tuple[int, ...]]:
    """Every set of one to three bins that fills a sequence."""
    found: list[tuple[int, ...]] = [(bins,)]
    for a in range(1, bins):
        if bins - a >= a:
            found.append((a, bins - a))
        for b in range(a, bins - a):
            if bins - a - b >= b:
                found.append((a, b, bins - a - b))
    return found


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative x that minimises |ax - b|, by the active-set method."""
    x = np.zeros(a.shape[1])
    chosen: list[int] = []
    scale = 1e-7 * max(1.0, float(b.max()))
    for _ in range(3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= scale:
            break
        chosen.append(best)
        while chosen:
            fit = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if fit.min() > 0:
                break
            now = x[chosen]
            low = fit <= 0
            step = (now[low] / np.maximum(now[low] - fit[low], 1e-300)).min()
            moved = now + step * (fit - now)
            x[chosen] = np.where(moved > 1e-9, moved, 0)
            chosen = [c for c in chosen if x[c] > 0]
        x[:] = 0
        if not chosen:
            break
        x[chosen] = fit
    return x


def _grid_patterns(histogram: Counter, capacity: int, grid: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of grid cells with their fitted repeat counts, the most frequent first."""
    bins = capacity // grid
    cells: Counter = Counter()
    for length, n in histogram.items():
        if -(-length // grid) < bins:  # full sequences need no partner
            cells[-(-length // grid)] += n
    patterns = [p for p in full_patterns(bins) if all(c in cells for c in p)]
    if not patterns:
        return []
    rows = sorted(cells)
    at = {c: i for i, c in enumerate(rows)}
    a = np.zeros((len(rows), len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            a[at[c], j] += 1
    counts = least_squares(a, np.array([cells[c] for c in rows], float))
    order = np.argsort(-counts, kind="stable")
    return [(patterns[j], int(counts[j])) for j in order if counts[j] >= 1]


def best_fit(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, the longest first, for all pieces of a length and all sequences alike at a time.

    A piece goes where it leaves the least room. That is again the sequence that
    took the one before, while another fits.
    """
    rooms: list[int] = []
    alike: dict[int, list[tuple[Counter, int]]] = {}

    def put(room: int, pattern: Counter, count: int) -> None:
        if room not in alike:
            alike[room] = []
            bisect.insort(rooms, room)
        alike[room].append((pattern, count))

    for b in sorted(left, reverse=True):
        n = left[b]
        while n:
            at = bisect.bisect_left(rooms, b)
            if at < len(rooms):
                room = rooms[at]
                pattern, count = alike[room].pop()
                if not alike[room]:
                    del alike[rooms.pop(at)]
            else:
                room, pattern, count = capacity, Counter(), -(-n // (capacity // b))
            each = room // b
            full = min(count, n // each)
            if full:
                put(room - each * b, pattern + Counter({b: each}), full)
                n, count = n - full * each, count - full
            if count and n:  # fewer are left than one sequence takes
                put(room - n * b, pattern + Counter({b: n}), 1)
                n, count = 0, count - 1
            if count:
                put(room, pattern, count)
    return [(dict(pattern), count) for groups in alike.values() for pattern, count in groups]


def fit_patterns(
    histogram: dict[int, int], capacity: int, grid: int = GRID
) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to how often) with repeat counts that use up the histogram exactly.

    Of several ways to round the fitted counts, from all the way to the next whole
    number down to nothing, the one that needs the fewest sequences is taken.
    """
    left = Counter({b: n for b, n in histogram.items() if n > 0})
    fitted = _grid_patterns(left, capacity, grid) if left else []
    floor = -(-sum(b * n for b, n in left.items()) // capacity)
    best: list[tuple[dict[int, int], int]] | None = None
    for share in SHARES:
        plan = _packed(left.copy(), [(c, int(share * n)) for c, n in fitted], capacity, grid)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) == floor:
            break
    return best


def _packed(
    left: Counter, fitted: list[tuple[tuple[int, ...], int]], capacity: int, grid: int
) -> list[tuple[dict[int, int], int]]:
    """The fitted patterns as far as exact lengths fill them, and best fit for what is left."""
    plan: list[tuple[dict[int, int], int]] = []
    for cells, count in fitted:
        while count > 0:
            # The longest of each cell; the last place goes to what fills the rest, in any cell.
            pattern: Counter = Counter()
            for cell in sorted(cells, reverse=True)[: max(1, len(cells) - 1)]:
                inside = (b for b in range(cell * grid, (cell - 1) * grid, -1) if left[b] > pattern[b])
                pattern[next(inside, 0)] += 1
            room = capacity - sum(b * n for b, n in pattern.items())
            if room:
                pattern[room] += 1
            if any(left[b] < n for b, n in pattern.items()):  # used up, or it would leave room
                break
            times = min(count, *(left[b] // n for b, n in pattern.items()))
            plan.append((dict(pattern), times))
            count -= times
            for b, n in pattern.items():
                left[b] -= n * times
                if not left[b]:
                    del left[b]
    return plan + best_fit(left, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``."""
    spark = pieces.sparkSession
    keyed = keep(
        pieces.withColumn("bin", F.col("length").cast("int")).withColumn(
            "shuffled", F.xxhash64("doc_id", "piece", F.lit(7))
        ),
        "pieces",
    )
    histogram = {r["bin"]: r["count"] for r in keyed.groupBy("bin").count().collect()}
    total = sum(histogram.values())

    # Bin, the numbers of its pieces that go to a pattern, and the pattern's first sequence.
    cuts = []
    taken: Counter = Counter()
    first = 0
    for pattern, times in fit_patterns(histogram, capacity, grid):
        for b, n in pattern.items():
            cuts.append((b, taken[b], taken[b] + n * times, n, first))
            taken[b] += n * times
        first += times
    cut_rows = spark.createDataFrame(
        cuts, "cut_bin int, low long, high long, times int, first_sequence long"
    )

    buckets = spread(total)
    numbered = running_total(
        keyed.withColumn("bucket", F.pmod("shuffled", F.lit(buckets))).withColumn("one", F.lit(1)),
        ["bin"],
        "bucket",
        ["shuffled", "doc_id", "piece", "start", "ids_crc32"],
        "one",
        "number",
    )
    # At most about one pattern, of a few lengths, for each of ``capacity`` lengths.
    placed = numbered.join(
        F.broadcast(cut_rows),
        (F.col("bin") == F.col("cut_bin"))
        & (F.col("number") >= F.col("low"))
        & (F.col("number") < F.col("high")),
    ).withColumn(
        "sequence_id",
        F.col("first_sequence") + F.floor((F.col("number") - F.col("low")) / F.col("times")),
    )
    in_sequence = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("bin"), "number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return placed.withColumn(
        "offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))
    ).select(*pieces.columns, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, capacity, tokenizer), capacity)

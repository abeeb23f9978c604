"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed whole with either dictionary. The difference of the sizes,
by their sum, says which kind it resembles; a logistic curve over it, over how
well the text compresses at all (a text of a few repeated words fits either
dictionary) and over its length turns it into a probability.

Labels are learnt from a bounded sample: the ``SAMPLE`` labelled rows of each
class with the smallest hashes. Half of them (by hash) train the dictionaries:
their whole texts are cut into samples of ``SAMPLE_BYTES`` bytes where they lie,
and of those a share, by hash, comes to the driver, so that a class takes about
``TRAIN_BYTES``. The other half train the curve, with a few numbers a text. Every
text is scored whole.

Rows: null and empty texts get the score of size zero; a text that occurs often
gets the same score each time; rows whose label or id is null are not learnt
from; with one class only, or no labels, the score is the share of good ones
(one half without any); extra columns are ignored; an empty table gives no rows.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.llm.batches import column, record, slices
from tidetally.session import keep

#: Labelled rows learnt from, of each class, at most.
SAMPLE = 4000

#: Bytes of a sample that a dictionary is trained on, at most, and of the dictionary.
SAMPLE_BYTES = 2000
DICTIONARY_BYTES = 110_000

#: Bytes of samples that either dictionary is trained on, about.
TRAIN_BYTES = 8_000_000

LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold no label is learnt from: crc32 of the id as text, modulo 5, is zero."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def cut(text: str) -> list[bytes]:
    """The whole text in samples."""
    data = text.encode()
    return [data[at : at + SAMPLE_BYTES] for at in range(0, max(len(data), 1), SAMPLE_BYTES)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves, as they come, where training fails."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def sizer(content: bytes) -> Callable[[bytes], int]:
    if not content:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    else:
        compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False
        )
    return lambda data: len(compressor.compress(data))


def measures(text: str | None, good: Callable, bad: Callable) -> tuple[float, float, float]:
    """(difference by sum, log of the compression ratio, log of the length)."""
    data = (text or "").encode()
    a, b = good(data), bad(data)
    return (b - a) / (a + b), math.log((len(data) + 1) / min(a, b)), math.log(len(data) + 1)


def terms(x: np.ndarray) -> np.ndarray:
    d, r, n = x.T
    return np.column_stack([d, r, n, d * d, r * r, d * r, d * n, r * n, n * n])


class Curve:
    """Logistic regression over the measures and their products, lightly damped."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        x = terms(x)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(40):
            p = self._logistic(z @ self.weights)
            curvature = (z * (p * (1 - p))[:, None]).T @ z + np.eye(z.shape[1])
            self.weights += np.linalg.solve(curvature, z.T @ (good - p) - self.weights)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])

    @staticmethod
    def _logistic(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._logistic(self._design(terms(x)) @ self.weights)


def sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """The sampled rows: text, quality, first_half, place; of at most ``size`` ids of either class."""
    usable = labels.select("doc_id", "quality").where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()
    )
    order = F.xxhash64("doc_id", F.lit(3))
    picked = [
        usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(size) for q in (0, 1)
    ]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    return rows.select(
        F.coalesce("text", F.lit("")).alias("text"),
        "quality",
        (F.xxhash64("doc_id", F.lit(4)) % 2 == 0).alias("first_half"),
        order.alias("place"),
    )


def training_samples(rows: DataFrame, shares: dict[int, float]) -> DataFrame:
    """(quality, hash, part): samples of whole texts, the share of each class with the smallest hashes."""
    schema = pa.schema([("quality", pa.int32()), ("hash", pa.int64()), ("part", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, quality in zip(column(batch, "text"), column(batch, "quality"), strict=True):
                for part in cut(text):
                    digest = xxhash.xxh64_intdigest(part) >> 1
                    if digest < shares[quality] * 2**63:
                        out.append((quality, digest, part))
            yield record(schema, *(list(zip(*out, strict=True)) or [[]] * 3))

    return rows.select("text", "quality").mapInArrow(pick, "quality int, hash long, part binary")


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[bytes, bytes, Curve | float]:
    """(good dictionary, bad dictionary, curve); instead of a curve the share of good rows.

    Dictionaries come from one half's texts; for the curve the other half's are
    measured where they are and only the numbers come here. Ids that repeat in the
    documents lengthen neither.
    """
    both = sample(docs, labels, size)
    training = both.where("first_half")
    counts = {
        r["quality"]: r
        for r in training.groupBy("quality")
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        .collect()
    }
    shares = {q: min(1.0, TRAIN_BYTES / max(1, r["bytes"])) for q, r in counts.items()}
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for row in training_samples(training, shares).orderBy("hash", "part", "quality").collect():
        samples[row["quality"]].append(bytes(row["part"]))
    good, bad = dictionary(samples[1]), dictionary(samples[0])
    rows = measured(both.where("not first_half"), good, bad)
    numbers = [
        row
        for q in (0, 1)
        for row in rows.where(F.col("quality") == q)
        .orderBy("place", "x", "y", "z")
        .limit(size)
        .select("quality", "x", "y", "z")
        .collect()
    ]
    quality = np.array([r["quality"] for r in numbers], float)
    if len(set(quality)) < 2:
        shown = {q: r["n"] for q, r in counts.items()}
        n = len(quality) + sum(shown.values())
        return good, bad, float((quality.sum() + shown.get(1, 0)) / n) if n else 0.5
    order = np.lexsort([[r[n] for r in numbers] for n in "zyx"] + [quality])
    x = np.array([(r["x"], r["y"], r["z"]) for r in numbers])
    return good, bad, Curve(x[order], quality[order])


def measured(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """Quality and the three measures of each sampled text, with its place in the sample."""
    schema = pa.schema(
        [("quality", pa.int32()), ("place", pa.int64()), *((n, pa.float64()) for n in "xyz")]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizer(good), sizer(bad)
        for batch in slices(batches):
            x = [measures(t, *sizes) for t in column(batch, "text")]
            numbers = np.array(x).reshape(-1, 3).T
            yield record(schema, column(batch, "quality"), column(batch, "place"), *numbers)

    found = rows.select("text", "quality", "place").mapInArrow(
        measure, "quality int, place long, x double, y double, z double"
    )
    return keep(found, "measures")


def rate(batch: pa.RecordBatch, sizes: tuple, curve: Curve | float) -> np.ndarray:
    if isinstance(curve, float):
        return np.full(batch.num_rows, curve)
    x = [measures(text, *sizes) for text in column(batch, "text")]
    return curve(np.array(x).reshape(-1, 3))


def scores(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Per row: doc_id and score, 0 to 1; the higher, the likelier good."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    good, bad, curve = learn(docs, labels, size)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizer(good), sizer(bad)
        for batch in slices(batches):
            yield record(schema, column(batch, "doc_id"), rate(batch, sizes, curve))

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1: good)."""
    return scores(docs, labels).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    good, bad, curve = learn(docs, labels)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = sizer(good), sizer(bad)
        for batch in slices(batches):
            yield batch.filter(pa.array(rate(batch, sizes, curve) >= THRESHOLD))

    return docs.mapInArrow(drop, docs.schema)

"""Order-dependent steps on keys of any size.

A window holds one key in one task, so a key with a third of all rows would
stop the job. Here such a key is cut into consecutive pieces of at most
``hot_rows`` rows; each piece is worked on by itself and the pieces are then
linked through one row each. The answer is the one of the plain window.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetally.schema import POSITION
from tidetally.session import keep

# Rows of one key a single task is given.
HOT_ROWS = 1_000_000

# Most ids marked as hot, and with that the most rows ever broadcast (16 bytes
# each). Keys beyond it have fewer rows than all of these and stay unsplit.
MAX_HOT_KEYS = 100_000


def piece(hot_rows: int) -> Column:
    """Consecutive piece of the landed data a row belongs to."""
    block = F.floor(F.col("seq") / hot_rows)
    return F.struct(F.col("batch_no"), F.col("part"), block.alias("block"))


def hot_keys(rows: DataFrame, key: Sequence[str], hot_rows: int) -> DataFrame:
    """Hashes of the keys with more than ``hot_rows`` rows, the largest first.

    Counts are folded on the map side over an 8-byte hash. Two keys with one
    hash are at worst both split.
    """
    return (
        rows.groupBy(F.xxhash64(*key).alias("key_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot_rows)
        .orderBy(F.desc("n"), "key_id")
        .limit(MAX_HOT_KEYS)
        .select("key_id")
    )


def with_piece(
    rows: DataFrame, key: Sequence[str], hot_rows: int, apart: Column
) -> tuple[DataFrame, bool]:
    """Adds ``piece``, and whether there are hot keys: NULL for ordinary keys, consecutive pieces for hot ones.

    Counts the keys' rows in a job of its own, so the list of hot keys is known
    and small when it is broadcast. Rows that are ``apart`` are a piece each.
    """
    found = hot_keys(rows.where(~apart), key, hot_rows).collect()
    alone = F.when(apart, piece(1))
    if not found:
        return rows.withColumn("piece", alone), False
    hot = rows.sparkSession.createDataFrame(found, "key_id long").withColumn("hot", F.lit(True))
    marked = rows.withColumn("key_id", F.xxhash64(*key)).join(F.broadcast(hot), "key_id", "left")
    cut = marked.withColumn("piece", alone.when(F.col("hot") & ~apart, piece(hot_rows)))
    return cut.drop("key_id", "hot"), True


def with_previous(
    rows: DataFrame,
    key: Sequence[str],
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
    apart: Column | None = None,
) -> DataFrame:
    """Adds the value of the row before it under the same key (NULL for the first).

    One window over (key, piece). A piece of a hot key begins with a copy of the
    last row of the piece before, so the window needs no other rows; those last
    rows are an aggregate, folded on the map side. Rows that are ``apart`` have no
    row before them and are dealt out evenly. ``rows`` is read once more to count
    the keys, and once for the hot ones if there are any: pass a stored table.
    """
    apart = F.lit(False) if apart is None else apart
    cut, any_hot = with_piece(rows, key, hot_rows, apart)
    order = list(POSITION)
    if any_hot:
        tails = cut.where(F.col("piece").isNotNull() & ~apart)
        tails = tails.groupBy(*key, "piece").agg(
            F.max_by(value, F.struct(*POSITION)).alias(value)
        )
        next_piece = F.lead("piece").over(Window.partitionBy(*key).orderBy("piece"))
        links = tails.withColumn("piece", next_piece).where("piece IS NOT NULL")
        cut = cut.withColumn("link", F.lit(False)).unionByName(
            links.withColumn("link", F.lit(True)), allowMissingColumns=True
        )
        order = [F.desc("link"), *POSITION]
    in_piece = Window.partitionBy(*key, "piece").orderBy(*order)
    linked = cut.withColumn(name, F.lag(value).over(in_piece))
    if any_hot:
        linked = linked.where(~F.col("link")).drop("link")
    return linked.drop("piece")


def _numbered_by_place(rows: DataFrame, group: Sequence[str], parts: DataFrame, name: str) -> DataFrame:
    """Numbers rows whose ``seq`` counts up by one within a part: no row is moved."""
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        *group,
        "part",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low") + 1).alias("shift"),
    )
    return (
        rows.join(begins, [*group, "part"])
        .withColumn(name, F.col("seq") + F.col("shift"))
        .select(*rows.columns, name)
    )


def with_row_number(
    rows: DataFrame, group: Sequence[str], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Numbers the rows of each group from 1 in landing order.

    As they are read, rows count up within their part (a split of a file), so a
    row's number is its place in the part and the rows of the parts before: a
    table of one row a part, worked out first. Where numbers are missing, rows
    are numbered within pieces of at most ``hot_rows`` by a window and shifted
    by the rows of the pieces before.
    """
    parts = keep(
        rows.groupBy(*group, "part").agg(
            F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")
        ),
        "parts",
    )
    if parts.where("high - low + 1 <> n").isEmpty():
        return _numbered_by_place(rows, group, parts, name)
    keys = [*group, "piece"]
    cut = rows.withColumn("piece", piece(hot_rows))
    earlier = (
        Window.partitionBy(*group)
        .orderBy("piece")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    in_piece = Window.partitionBy(*keys).orderBy(*POSITION)
    return (
        cut.withColumn("place", F.row_number().over(in_piece))
        .join(offsets, keys)
        .withColumn(name, F.col("offset") + F.col("place"))
        .drop("piece", "place", "offset")
    )

"""A small filter of keys: which rows of a table can't match a set of others.

One bit a key, at the place its hash names: 32,768 bits to a row of the filter,
made by Spark's bitmap aggregate and broadcast. A key of the set always passes;
another one passes by chance about once in ``BITS_PER_KEY`` times. So rows that
do not pass need not be shuffled to find out that they match nothing.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidetally.session import keep

BITS_PER_KEY = 16

#: Bits of a row of the filter (fixed by the bitmap aggregate), and most bits of a filter:
#: 32 MB, whatever is broadcast with it included. A larger set has no filter.
ROW_BITS = 32_768
MOST_BITS = 1 << 28


def _place(key: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def key_filter(rows: DataFrame, key: Sequence[str], count: int) -> DataFrame | None:
    """The filter of the keys of ``count`` rows; None if they are too many for one."""
    bits = ROW_BITS
    while bits < BITS_PER_KEY * count:
        bits *= 2
    if bits > MOST_BITS:
        return None
    place = rows.select(_place(key, bits).alias("place"))
    made = place.groupBy(F.expr(f"place div {ROW_BITS}").alias("filter_row")).agg(
        F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bitmap")
    )
    return keep(made.withColumn("bits", F.lit(bits)), "key-filter")


def with_possible(table: DataFrame, key: Sequence[str], made: DataFrame, name: str) -> DataFrame:
    """Adds whether a row's key may be in the set; moves no row."""
    bits = made.first()
    place = _place(key, bits.bits if bits else ROW_BITS)
    marked = table.withColumn("place", place).withColumn("filter_row", F.expr(f"place div {ROW_BITS}"))
    joined = marked.join(F.broadcast(made.drop("bits")), "filter_row", "left")
    at = F.col("place") % ROW_BITS
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 AS int))")) != 0
    return joined.select(*table.columns, F.coalesce(bit, F.lit(False)).alias(name))

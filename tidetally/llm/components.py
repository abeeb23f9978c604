"""Connected components of links between numbers, by large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidetally.session import keep


def _stars(links: DataFrame, keep_larger: bool) -> DataFrame:
    """Ties each node's neighbours to the smallest number among them and itself.

    The smallest neighbour is a minimum that folds on the map side, so a node
    with very many links costs one row a task; the join back is by node and the
    planner splits nodes that are too large for one task.
    """
    both = links if not keep_larger else links.union(links.select("b", "a"))
    low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    low = low.select("node", F.least("node", "low").alias("low"))
    tied = both.join(low, both.a == low.node)
    if keep_larger:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    others = tied.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.union(low.select(F.col("node").alias("a"), F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root): each linked node with the smallest number it reaches.

    ``links`` has the columns a and b. Each round is stored as a table; it
    ends when a round changes nothing, after about as many rounds as the
    logarithm of the longest chain. Links of a node to itself are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = keep(pairs.distinct(), "links")
    before = None
    while True:
        large = _stars(current, keep_larger=True).where("a <> b").distinct()
        small = keep(_stars(large, keep_larger=False).where("a <> b").distinct(), "links")
        state = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, current = state, small

"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``BLOCK_WORDS`` words. The golden-ratio point
of each slot, mapped through the sources' cumulative targets, names its source,
so that every stretch of the mix is close to the targets. A source's documents
are shuffled and laid end to end, cut into blocks of equal size; its slots are
ranked and slot rank joins block, starting again after the last block. The last
slot of a source takes only what its target still needs, and where the schedule
came out a slot or two short of a target the missing ranks follow at the end, so
each source's words equal its target rounded to words.

Only DataFrame and SQL functions. Ranks and places are sums in two steps, so a
source may hold any share of the rows; the joins are by source and block.

Rows: a null text has size zero and takes nothing; a null source is a source of
its own and the last one; repeated rows and null ids are separate documents; an
empty table gives no rows; further columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidetally.llm.running import running_total, spread
from tidetally.session import keep

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 64
SEED = 11

#: Fixed value: 2 ** 32 over the golden ratio, made odd.
GOLDEN = 2_654_435_769

#: Cells of the unit interval; slots and sources meet by cell.
CELLS = 4096


def source_targets(sizes: DataFrame, share: float, weights: tuple, repeats: int) -> DataFrame:
    """Per source: number (by code point, null last), source_size, target.

    Targets are shares of the total by weight, but none above ``repeats`` times
    its source: the excess is shared again until none is above. That is the level
    at which the capped targets sum to the total, found from running sums over
    the sources in the order in which they reach their caps. One row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    by_level = everything.orderBy("cap_level", "number")
    done = by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.col("number") % len(weights)) + 1).cast("int"),
    )
    ranked = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("number", (F.row_number().over(by_name) - 1).cast("long"))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * float(repeats))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("capped", F.coalesce(F.sum("cap").over(done), F.lit(0.0)))
        .withColumn(
            "open_weight",
            F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(done), F.lit(0.0)),
        )
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    )
    # The first source, in this order, whose cap lies above the level that is left.
    level = F.min(
        F.when(F.col("cap_level") >= F.col("level"), F.struct("cap_level", "number", "level"))
    ).over(everything)["level"]
    target = F.least("cap", F.coalesce(level, F.col("cap_level")) * F.col("weight"))
    return ranked.withColumn("target", target).select(
        "source", "number", F.col("source_size").cast("long"), "target"
    )


def schedule(targets: DataFrame) -> DataFrame:
    """Slots (number, slot_rank, slot): what each source's slots are, in the order of the mix.

    ``targets`` has number, needs (how many slots) and low and high, the source's
    part of the 2 ** 32 points.
    """
    spark = targets.sparkSession
    wanted = targets.agg(F.sum("needs")).first()[0] or 0
    # i * GOLDEN modulo 2 ** 32, in halves so that no product leaves 64 bits.
    i = F.col("id").bitwiseAND(F.lit(0xFFFFFFFF))
    high = (F.shiftrightunsigned(i, 16) * F.lit(GOLDEN)).bitwiseAND(F.lit(0xFFFF))
    point = (F.shiftleft(high, 16) + i.bitwiseAND(F.lit(0xFFFF)) * F.lit(GOLDEN)).bitwiseAND(
        F.lit(0xFFFFFFFF)
    )
    cell_width = 2**32 // CELLS
    points = (
        spark.range(1, wanted + 1)
        .select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("cell", F.floor(F.col("point") / cell_width))
    )
    parts = targets.where("high > low").select(
        "number",
        "low",
        "high",
        F.explode(
            F.sequence(F.floor(F.col("low") / cell_width), F.floor((F.col("high") - 1) / cell_width))
        ).alias("cell"),
    )
    slots = keep(
        points.join(parts, "cell")
        .where("point >= low and point < high")
        .select(
            "number",
            "slot",
            F.floor(F.col("slot") / spread(wanted)).alias("chunk"),
            F.lit(1).alias("one"),
        ),
        "slots",
    )
    ranked = running_total(slots, ["number"], "chunk", ["slot"], "one", "slot_rank")
    counts = slots.groupBy("number").agg(F.count("*").alias("got"))
    short = targets.join(counts, "number", "left").withColumn(
        "got", F.coalesce("got", F.lit(0)).cast("long")
    )
    more = short.where("needs > got").select(
        "number", F.explode(F.sequence("got", F.col("needs") - 1)).alias("slot_rank")
    )
    return ranked.select("number", "slot_rank", "slot").unionByName(
        more.withColumn("slot", F.lit(wanted) + 1 + F.col("slot_rank"))
    )


def mix_sources(
    docs: DataFrame,
    share: float = SHARE,
    weights: tuple = WEIGHTS,
    repeats: int = MOST_REPEATS,
    block: int = BLOCK_WORDS,
    seed: int = SEED,
    row_id: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, takes). ``row_id`` is a column that tells all rows apart, if there is one.

    Documents: doc_id, row_id (tells equal rows apart), shuffled (id and text
    hashed), size, source_size, target, taken. Takes, the mix itself: row_id,
    round (how often its source was gone through before), slot (its place in the
    mix), from_word and words.
    """
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("shuffled"),
        (F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"),
    )
    sized = keep(sized, "sized")
    targets = source_targets(sized, share, weights, repeats)
    before = Window.partitionBy(F.lit(0)).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    upto = F.try_divide(F.sum("target").over(before), F.sum("target").over(everything))
    rounds = F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))
    rest = F.ceil((F.col("words") - F.col("rounds") * F.col("source_size")) / block)
    targets = keep(
        targets.withColumn("words", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("rounds", rounds)
        .withColumn("needs", F.col("rounds") * F.col("blocks") + rest)
        .withColumn("high", F.coalesce(F.round(upto * 2.0**32).cast("long"), F.lit(0).cast("long")))
        .withColumn("low", F.coalesce(F.lag("high").over(everything.orderBy("number")), F.lit(0))),
        "targets",
    )

    same = sized["source"].eqNullSafe(targets["source"])
    buckets = spread(sized.count())
    placed = running_total(
        keep(
            sized.join(targets.select("source", "number", "source_size", "target"), same)
            .drop("source")
            .withColumn("bucket", F.pmod("shuffled", F.lit(buckets))),
            "documents",
        ),
        ["number"],
        "bucket",
        ["shuffled", "doc_id", "row_id"],
        "size",
        "begins",
    )
    placed = keep(placed, "placed")
    pieces = placed.where("size > 0").select(
        "row_id",
        "number",
        "begins",
        "size",
        F.explode(
            F.sequence(
                F.floor(F.col("begins") / block),
                F.floor((F.col("begins") + F.col("size") - 1) / block),
            )
        ).alias("block"),
    )
    slots = (
        schedule(targets)
        .join(targets.select("number", "source_size", "words", "blocks"), "number")
        .withColumn("block", F.col("slot_rank") % F.col("blocks"))
        .withColumn("round", F.floor(F.col("slot_rank") / F.col("blocks")))
        # Where the slot ends in its source's words: at its block or at what is wanted.
        .withColumn("stop", F.col("words") - F.col("round") * F.col("source_size"))
        .where(F.col("stop") > F.col("block") * block)
    )
    start = F.greatest("begins", F.col("block") * block)
    end = F.least(F.col("begins") + F.col("size"), (F.col("block") + 1) * block, "stop")
    # A merge join by hint: the planner takes the pieces to be as few as the documents, a table to
    # send to the driver.
    takes = (
        pieces.hint("merge")
        .join(slots.select("number", "block", "round", "slot", "stop"), ["number", "block"])
        .withColumn("words", end - start)
        .where("words > 0")
        .select("row_id", "round", "slot", (start - F.col("begins")).alias("from_word"), "words")
    )
    takes = keep(takes, "takes")
    taken = takes.groupBy("row_id").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, "row_id", "left").select(
        "doc_id",
        "row_id",
        "shuffled",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )
    return documents, takes


def mixed_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    documents, _ = mix_sources(docs)
    return documents.drop("row_id", "shuffled")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents, all columns: a row for each round that takes words of one.

    A document that is taken whole keeps its text; of others the taken words are
    left, with a space between them.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row_id"), whole), "rows")
    needed = (F.col(f"doc.`{c}`").alias(c) for c in ("doc_id", "source", "text"))
    documents, takes = mix_sources(rows.select(*needed, "row_id"), row_id=F.col("row_id"))
    of_round = takes.groupBy("row_id", "round").agg(
        F.min("from_word").alias("from_word"), F.sum("words").alias("words")
    )
    parts = documents.select("row_id", "size").join(of_round, "row_id")
    some = F.array_join(
        F.slice(
            F.regexp_extract_all(F.col("doc.text"), F.lit(f"({WORD})")),
            (F.col("from_word") + 1).cast("int"),
            F.col("words").cast("int"),
        ),
        " ",
    )
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(some)
    return rows.join(parts, "row_id").select(
        *[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns]
    )

"""Landed CSV exports: one numbered batch per survey year.

A batch is a file or a folder of part files whose path carries its number as
``batch_no=3`` or ``sample_date=3``. Part files are read in name order.
"""

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidetally.schema import HEADERS
from tidetally.session import keep
from tidetally.sources import quoted_csv

_NUMBER = r"(?:batch_no|sample_date)=(\d+)"
# The path up to the batch's own file or folder.
_ROOT = rf"^(.*{_NUMBER}[^/]*)"

_FILE = "path string, length bigint"

# Files up to this size go to one task anyway; larger ones are split when that is safe.
SPLIT_OVER = 128 * 1024 * 1024

RAW = ", ".join(["batch_no int", "part string", "seq bigint"] + [f"`{h}` string" for h in HEADERS])


def manifest_of(files: DataFrame, by_file: bool = False) -> DataFrame:
    """Batch number, root path and bytes from file names and sizes.

    The root is the batch's file or folder; with ``by_file`` always the file.
    """
    root = F.col("path") if by_file else F.regexp_extract("path", _ROOT, 1)
    return (
        files.select(
            F.regexp_extract("path", _NUMBER, 1).try_cast("int").alias("batch_no"),
            root.alias("root"),
            "length",
        )
        .where("batch_no IS NOT NULL")
        .groupBy("batch_no", "root")
        .agg(F.sum("length").alias("bytes"), F.max("length").alias("largest"))
    )


def list_batches(spark: SparkSession, landing: str) -> DataFrame:
    """Manifest of the landing folder. Reads no content.

    The scan passes over files of zero bytes; they come from the file listing,
    because a batch that landed empty is not a missing one.
    """
    try:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(landing)
        )
        names = [(name, 0) for name in files.inputFiles()]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return manifest_of(spark.createDataFrame([], _FILE))
    sized = manifest_of(files.select("path", "length"))
    named = manifest_of(spark.createDataFrame(names, _FILE))
    return sized.unionByName(named.join(sized, "batch_no", "left_anti"))


def has_quoted_newlines(spark: SparkSession, root: str) -> bool:
    """Whether any line ends inside quotes. Distributed; stops at the first such line."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(root).where(quotes % 2 == 1).isEmpty()


def read_batch(spark: SparkSession, batch_no: int, root: str, split: bool) -> DataFrame | None:
    """One batch, all columns as text, with its place in landing order.

    Files are named by header: every part file has to repeat the first one's
    header, or the read fails instead of mixing columns up.
    """
    rows = (
        spark.read.options(**quoted_csv.OPTIONS).option("multiLine", str(not split).lower()).csv(root)
    )
    if not rows.columns:
        return None
    start = F.lpad(F.col("_metadata.file_block_start").cast("string"), 19, "0")
    return rows.select(
        F.lit(batch_no).alias("batch_no"),
        F.concat(F.col("_metadata.file_name"), F.lit("@"), start).alias("part"),
        F.monotonically_increasing_id().alias("seq"),
        "*",
    )


def read_quoted_batch(spark: SparkSession, batch_no: int, root: str) -> DataFrame | None:
    """One batch with line breaks inside quotes: in splits, or file by file where that fails."""
    whole = read_batch(spark, batch_no, root, split=False)
    if whole is None:
        return None
    columns = whole.columns[3:]
    rows = quoted_csv.read_in_splits(spark, root, columns)
    if rows is None:
        return whole
    return rows.select(F.lit(batch_no).alias("batch_no"), "part", "seq", *(f"`{c}`" for c in columns))


def _headers(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, root, header, names): the first line of each file, as text and as its fields."""
    path = F.col("_metadata.file_path")
    heads = (
        spark.read.text(roots)
        .select(
            path.alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
        .where("start = 0 AND length(trim(value)) > 0")
        .groupBy("path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    heads = keep(heads.withColumn("root", F.regexp_extract("path", _ROOT, 1)), "headers")
    width = heads.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(",")))))
    width = (width.first()[0] or 0) + 1
    fields = ", ".join(f"c{k} string" for k in range(width))
    row = F.from_csv("header", fields, {"escape": '"'})
    names = F.array(*(F.lower(row[f"c{k}"]) for k in range(width)))
    return heads.withColumn("names", names)


def read_files(spark: SparkSession, roots: list[str]) -> DataFrame | None:
    """Files of any number of batches and headers by one read, the record's columns as text.

    Fields are read by position; each file's own header, joined to its rows, says
    which position holds which column. A name that a header has twice is not bound.
    None if a header has a line break.
    """
    heads = _headers(spark, roots)
    quotes = F.length("header") - F.length(F.replace("header", F.lit('"')))
    if not heads.where(quotes % 2 == 1).isEmpty():
        return None
    if all(re.match(_ROOT, root)[1] == root for root in roots):
        other = heads.groupBy("root").agg(F.min("names").alias("a"), F.max("names").alias("b"))
        unlike = other.where("a <> b").first()
        if unlike:
            raise ValueError(f"the part files of {unlike.root} do not have the same header")
    places = [
        F.when(F.size(F.expr(f"filter(names, n -> n = '{name}')")) == 1, F.array_position("names", name) - 1)
        for name in map(str.lower, HEADERS)
    ]
    bound = heads.select("path", F.size("names").alias("width"), F.array(*places).alias("places"))
    width = bound.agg(F.max("width")).first()[0] or 1
    fields = [f"c{k}" for k in range(width)]
    rows = (
        spark.read.schema(", ".join(f"{name} string" for name in fields))
        .options(**quoted_csv.OPTIONS | {"enforceSchema": "true"})
        .option("multiLine", "true")
        .csv(roots)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_name").alias("file"),
            F.monotonically_increasing_id().alias("seq"),
            F.array(*fields).alias("fields"),
        )
    )
    return rows.join(bound, "path").select(
        F.regexp_extract("path", _NUMBER, 1).cast("int").alias("batch_no"),
        F.concat("file", F.lit("@" + "0" * 19)).alias("part"),
        "seq",
        *(F.get("fields", F.get("places", F.lit(k)).cast("int")).alias(h) for k, h in enumerate(HEADERS)),
    )


def scan_csv_batches(
    spark: SparkSession, manifest: DataFrame, split_over: int = SPLIT_OVER
) -> DataFrame:
    """All landed batches of the manifest as one frame of text columns.

    Columns are bound by each batch's own header. All batches without a file over
    ``split_over`` bytes are read at once; the others batch by batch and in splits,
    also files with line breaks inside quotes. ``part`` and ``seq`` give the file
    order either way.
    """
    batches = sorted(manifest.where("bytes > 0").collect(), key=lambda row: (row.batch_no, row.root))
    small = [batch.root for batch in batches if batch.largest <= split_over]
    frames = [read_files(spark, small)] if small else []
    at_once = bool(frames) and frames[0] is not None
    frames = frames if at_once else []
    for batch in batches:
        split = batch.largest > split_over
        if not split and at_once:
            continue
        if split and has_quoted_newlines(spark, batch.root):
            frame = read_quoted_batch(spark, batch.batch_no, batch.root)
        else:
            frame = read_batch(spark, batch.batch_no, batch.root, split)
        if frame is not None:
            frames.append(frame)
    empty = spark.createDataFrame([], RAW)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames, empty)


def batch_digests(spark: SparkSession, manifest: DataFrame) -> dict[int, str]:
    """Digest of the content of each landed batch, from one pass over the files as lines.

    A line counts by its hash and by its place in the file, so that lines moved
    about are noticed; how a file is split does not matter. Part files count in name
    order, not by name. The driver gets one row a batch.
    """
    roots = [row.root for row in manifest.where("bytes > 0").collect()]
    empty = {row.batch_no: "" for row in manifest.where("bytes = 0").collect()}
    if not roots:
        return empty
    path = F.col("_metadata.file_path")
    number = F.col("place").cast("decimal(11,0)")
    small = F.pmod("hash", F.lit(1 << 40)).cast("decimal(14,0)")
    lines = spark.read.text(roots).select(
        F.regexp_extract(path, _NUMBER, 1).cast("int").alias("batch_no"),
        path.alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"),
        F.xxhash64("value").alias("hash"),
    )
    splits = lines.groupBy("batch_no", "path", "start").agg(
        F.count("*").cast("decimal(11,0)").alias("n"),
        F.min(number).alias("low"),
        F.sum(small).alias("plain"),
        F.sum(small * number).alias("placed"),
    )
    # Places within a split become places within the file.
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("decimal(11,0)"))
    shifted = splits.withColumn("shift", (begin - F.col("low")).cast("decimal(11,0)"))
    wide = "decimal(38,0)"
    files = shifted.groupBy("batch_no", "path").agg(
        F.sum("n").alias("n"),
        F.sum("plain").cast(wide).alias("plain"),
        F.sum((F.col("placed") + F.col("plain") * F.col("shift")).cast(wide)).cast(wide).alias("placed"),
    )
    parts = F.sort_array(F.collect_list(F.struct("path", "n", "plain", "placed")))
    texts = F.transform(parts, lambda f: F.concat_ws(":", f["n"], f["plain"], f["placed"]))
    found = files.groupBy("batch_no").agg(F.sha2(F.array_join(texts, ","), 256).alias("digest"))
    return empty | {row.batch_no: row.digest for row in found.collect()}


def write_csv_batches(raw: DataFrame, landing: str) -> None:
    """Lands text rows as one folder of part files per batch, in landing order."""
    (
        raw.repartitionByRange("batch_no", "part", "seq")
        .sortWithinPartitions("batch_no", "part", "seq")
        .drop("part", "seq")
        .write.mode("overwrite")
        .partitionBy("batch_no")
        .option("header", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .option("escape", '"')
        .csv(landing)
    )

"""Training-data pipeline over ``documents``: five stages, each written before the next.

The quality classifier rejects documents, SimHash leaves one of each group of
near duplicates, repeated passages are cut from all documents but one, sources
are mixed to their target weights, and the mix is packed into sequences. All
stages but the last return the columns of ``documents``; ``n_chars`` follows the
text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.llm import compact_windows, compression_quality, mixing, packing, simhash
from tidetally.session import keep


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"n_chars": F.length("text").cast("long")}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    A null or empty text has the score of no bytes and stays or goes by it; of
    repeated rows all stay or all go. A null id is never learnt from.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return compression_quality.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Null, empty and wordless texts are alike, so one of them stays. Of repeated
    rows one stays, with the columns it has; a null id stays where there is no other.
    """
    return simhash.one_of_each(docs, simhash.SHINGLE, simhash.MAX_BITS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another one keeps.

    All rows stay, also those with null or empty texts, which have no passages
    (``n_chars`` of a null text is null). Repeated rows do not repeat each other.
    """
    return _measured(compact_windows.without_repeats(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time words of a document are taken.

    Null and empty texts have no words and are in no mix. A null source is a
    source of its own. Repeated rows are documents of their own, each with its source.
    """
    return _measured(mixing.mixed_texts(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A null or empty text is a piece of one token. Repeated rows and null ids are
    packed like any other.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

# Hashing, compression and tokenizing are beyond SQL; tests hold a plain version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage-{number + 1}")
    return docs

"""The contract's queries over the driver's tables; SQL where it can express them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetally.llm import (
    compact_windows,
    compression_quality,
    conversation_repair,
    exact_topk,
    hard_negatives,
    hnsw,
    mixing,
    packing,
    personal_data,
    prefix_free,
    simhash,
    simple8b,
    unigram_counts,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.remove_repeats(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_file(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digest(
        conversations, conversation_repair.damaged(conversations)
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_best_fit_packing,
        op3_hnsw,
        op4_suffix_array_dedup,
        op5_mix_sources,
        op6_token_counts,
        op7_quality_classifier,
        op8_exact_top_k,
        op9_simhash_near_dedup,
        op10_token_ids,
        op11_hard_negatives,
        op12_conversation_repair,
        op13_personal_data,
    )
}

SQL = {
    "op8_exact_top_k": """
        WITH whole AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_hard_negatives": """
        WITH usable AS (
            SELECT row_number() OVER () AS row, vec_id,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.row AS anchor_row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own,
                CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
            FROM usable a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
            WHERE a.vec_id % 100 = 0
        ), near AS (
            SELECT anchor_row, anchor_id, vec_id, score, row_number() OVER (
                PARTITION BY anchor_row ORDER BY score DESC, vec_id) AS place
            FROM scored WHERE own
        ), inside AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id,
                p.score AS positive_score, n.score AS negative_score,
                CAST(row_number() OVER (PARTITION BY p.anchor_row, p.place
                    ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
            FROM near p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.own
                AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
            WHERE p.place <= 5
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        FROM inside WHERE rank <= 10
    """,
}

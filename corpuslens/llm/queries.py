"""The operators as queries over the test tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import ann, bpe, centroids, chat, fim, licences, lines, minhash, mixing, multi_index, pii, pitman_yor, quality
from corpuslens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = pitman_yor.scores(table(spark, sf_dir, "documents"), learn=~held, settled=True)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("deleted_lines").cast("long").alias("n_deleted"),
                      F.sha2(F.array_join("deleted_lines", ","), 256).alias("deleted_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return mixing.mix(docs, labelled, "lang").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "p", "rate", "copies")


def op9_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return every.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "terms")).alias("spans"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    return chat.digests(turns.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)))


def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scan(table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("text"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(table(spark, sf_dir, "embeddings"), 64)
    mark = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", mark.alias("centroid_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_posting_list_search, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_quality_classifier, op5_pitman_yor_scores,
    op6_bpe_encoding, op7_line_dedup, op8_source_mixing, op9_pii_sanitisation, op10_chat_formatting,
    op11_licence_scan, op12_fill_in_middle, op13_centroid_clusters)}
ORACLES: dict[str, str] = {
    "op11_licence_scan": licences.sql(), "op12_fill_in_middle": fim.SQL, "op13_centroid_clusters": centroids.sql(64),
}

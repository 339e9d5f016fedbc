"""A corpus from raw documents to token ids: judged, cut, deduplicated, mixed and encoded, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, lines, minhash, mixing, quality
from corpuslens.llm.common import listed, ship, table
from corpuslens.session import cut, tune


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among them, does not reject.

    Without a clear label for any of them there is no classifier, and none is rejected. Rows with a null doc_id are kept; of
    repeated rows all go if one is rejected."""
    labels = table(spark, sf_dir, "labels")
    clear = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    if clear.join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        return docs
    bad = quality.score(docs, labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(listed(bad, "rejected"), "doc_id", "left_anti").select(docs.columns)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document of which nothing is left goes too."""
    ship(spark)
    left = lines.dedup_lines(docs)
    gone = (F.size("deleted_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = left.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    ship(spark)
    more = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(listed(more, "copies"), "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix asks for, each once at least; domains are languages, learned from labelled documents."""
    labelled = docs.select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    copies = mixing.mix(docs, labelled, "lang").groupBy("doc_id").agg(F.max("copies").alias("_copies")).where(F.col("_copies") != 1)
    out = docs.join(listed(copies, "repeated"), "doc_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_copies", F.lit(1)))))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' digests of every document."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", keep_good), ("line dedup", cut_lines), ("minhash near-dedup", drop_copies),
    ("mixing sources", mix_sources), ("bpe encoding", encode),
]
# Neither fitted scores nor alignments nor merges can be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

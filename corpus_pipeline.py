"""The corpus pipeline: language identification, exact deduplication, n-gram Jaccard join, best-fit packing.

Every stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns and reads it again as the next one's docs. All
but the last return the columns of documents. A stage decides about each row by its id and text; of rows that repeat both,
one stays from the second stage on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import best_fit, exact_dedup, jaccard_join, language_id
from weftline.session import written


def _rows(docs: DataFrame, kept: DataFrame, hash_column) -> DataFrame:
    """The rows of docs whose id and hash are in kept (__id, __hash), once each."""
    keys = ["__null", "__number", "__hash"]  # one exchange serves the join and the window
    number = [F.col("__id").isNull().alias("__null"), F.coalesce(F.col("__id").cast("long"), F.lit(0)).alias("__number"), "__hash"]
    own = docs.withColumn("__id", F.col("doc_id")).withColumn("__hash", hash_column).select(*docs.columns, *number)
    found = own.join(kept.select(*number).hint("merge"), keys, "left_semi")
    first = Window.partitionBy(*keys).orderBy(F.lit(1))
    return found.withColumn("__row", F.row_number().over(first)).filter(F.col("__row") == 1).select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, texts without a letter, and texts of which no language's filter holds more grams
    than its false positives explain (score 0), such as keyboard junk or a script never learned. Without labels, texts with letters stay."""
    names = ("__language", "__score")
    known = language_id.predict(docs, language_id.fit(docs), keep=tuple(docs.columns), named=names)
    return known.filter(F.col(names[0]).isNull() | (F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) > 0)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = exact_dedup.exact_copies(docs, digest_all=True)
    kept = copies.filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__hash"))
    return _rows(docs, kept, F.sha2(exact_dedup.normalised("text").cast("binary"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked at 0.8 over shingles of five words, the one with the smallest id (null last) and text_hash stays.
    A row without words is a group of its own."""
    linked = jaccard_join.linked_documents(docs, size=5, num=80, den=100, labelled=True)
    alone = [F.when(F.col("component").isNull(), F.col(c)).alias(f"__{c}") for c in ("doc_id", "text_hash")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    kept = linked.groupBy("component", *alone).agg(least).select(F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash"))
    return _rows(docs, kept, F.xxhash64(F.col("text").cast("string")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Tokenising and packing are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Held-out likelihood from scored tokens (batch_id, doc_id, label, nll)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import IGNORE_ID


def eval_nll(scored: DataFrame, batch_size: int, eval_samples: int = -1) -> DataFrame:
    """Loss as the mean of batch means with its perplexity, and nll per token and per document.

    A token-weighted perplexity is given beside the one of the batch means.
    """
    kept = scored.where(F.col("label") != IGNORE_ID)
    if eval_samples != -1:
        kept = kept.where(F.col("batch_id") < eval_samples // batch_size)
    batches = kept.groupBy("batch_id").agg(F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("n"))
    facts = batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("n").alias("tokens"),
        F.avg(F.col("nll") / F.col("n")).alias("loss"),
        F.sum("nll").alias("nll"),
    )
    per_token = F.col("nll") / F.col("tokens")
    return facts.select(
        "batches",
        "tokens",
        "loss",
        F.exp("loss").alias("perplexity"),
        per_token.alias("per_token_nll"),
        (F.col("nll") / (F.col("batches") * batch_size)).alias("per_doc_nll"),
        F.exp(per_token).alias("token_perplexity"),
    )


def document_nll(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("label") != IGNORE_ID).groupBy("doc_id").agg(F.sum("nll").alias("nll"), F.count(F.lit(1)).alias("tokens"))


def eval_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two models on the same documents: nll per document, which no tokeniser can move, not per token."""
    a = document_nll(left).select("doc_id", F.col("nll").alias("left_nll"), F.col("tokens").alias("left_tokens"))
    b = document_nll(right).select("doc_id", F.col("nll").alias("right_nll"), F.col("tokens").alias("right_tokens"))
    return a.join(b, "doc_id").withColumn("difference", F.col("left_nll") - F.col("right_nll"))

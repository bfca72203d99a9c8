"""Document offsets and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums

SHARD_DOCS = 1 << 18


def doc_offsets(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Dense document number and start offset in the token stream, in source order."""
    return running_sums(tokens, [key], {"doc_idx": F.lit(1).cast("long"), "start": F.col("len").cast("long")})


def offset_check(offsets: DataFrame) -> DataFrame:
    """Violations per rule; a sound index has none.

    Inside a shard each document must end where the next one starts; the first document of a shard
    must start where the shards before it end in total.
    """
    slim = offsets.select("doc_idx", "start", F.col("len").cast("long").alias("len"))
    sharded = slim.withColumn("_shard", F.floor(F.col("doc_idx") / SHARD_DOCS))  # dense numbers need no quantiles
    order = Window.partitionBy("_shard").orderBy("doc_idx")
    follow = F.lead("start").over(order)
    inside = sharded.withColumn("gap", (follow.isNotNull() & (follow != F.col("start") + F.col("len"))).cast("long"))
    per_shard = inside.groupBy("_shard").agg(
        F.min("start").alias("first"), F.sum("len").alias("total"), F.sum("gap").alias("gaps"), F.count(F.lit(1)).alias("docs")
    )
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    base = F.coalesce(F.sum("total").over(before), F.lit(0))
    borders = per_shard.withColumn("border", (F.col("first") != base).cast("long"))
    return borders.agg(
        F.sum("docs").alias("docs"),
        F.sum("total").alias("tokens"),
        F.min("first").alias("first_start"),
        F.sum("gaps").alias("gaps"),
        F.sum("border").alias("border_errors"),
    )

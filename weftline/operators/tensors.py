"""Statistics of tensors stored as shards (tensor, shard, values array<double>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 64

# Wrapper prefixes of module names, name parts by class.
WRAPPERS = ["_forward_module.", "_original_module.", "_checkpoint_wrapped_module.", "_fsdp_wrapped_module.", "_orig_mod."]
OUTPUT_HEAD = ["lm_head"]
EMBEDDING = ["wte", "embed_tokens"]
NORM = ["ln_f", "norm"]


def tensor_hist(shards: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal bins between the tensor's overall minimum and maximum, the last one closed; empty bins included.

    A constant tensor is spread one unit to each side. Ranges come from per-row minima and maxima;
    counts combine on the map side, so a dominant tensor is no hot key.
    """
    live = shards.where(F.size("values") > 0)
    ranges = live.groupBy("tensor").agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "tensor", F.when(flat, F.col("lo") - 1).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 1).otherwise(F.col("hi")).alias("hi")
    )
    placed = live.join(ranges, "tensor").select("tensor", "lo", "hi", F.explode("values").alias("v"))
    bin_no = F.least(F.floor(F.lit(bins) * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = placed.groupBy("tensor", bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["tensor", "bin"], "left").select(
        "tensor",
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("edge_low"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("edge_high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def tensor_norms(shards: DataFrame) -> DataFrame:
    """L1 and L2 norms: sums per row, merged over shards, root last."""
    zero = F.lit(0.0)
    per_row = shards.select(
        "tensor",
        F.size("values").alias("n"),
        F.aggregate("values", zero, lambda s, v: s + F.abs(v)).alias("l1"),
        F.aggregate("values", zero, lambda s, v: s + v * v).alias("sq"),
    )
    return per_row.groupBy("tensor").agg(
        F.sum("n").alias("elements"), F.sum("l1").alias("l1_norm"), F.sqrt(F.sum("sq")).alias("l2_norm")
    )


def clean_name(name: Column) -> Column:
    for wrapper in WRAPPERS:
        name = F.replace(name, F.lit(wrapper), F.lit(""))
    return name


def name_class(name: Column) -> Column:
    def any_of(parts: list[str]) -> Column:
        return name.rlike("|".join(parts))

    return F.when(any_of(OUTPUT_HEAD), "output_head").when(any_of(EMBEDDING), "embedding").when(any_of(NORM), "norm").otherwise("rest")


def tensor_groups(shards: DataFrame) -> DataFrame:
    """Elements by class of tensor name and trainable flag, with the share of all elements that is trainable."""
    named = shards.select(clean_name(F.col("name")).alias("name"), "trainable", F.size("values").cast("long").alias("n"))
    grouped = named.groupBy(name_class(F.col("name")).alias("class"), "trainable").agg(
        F.sum("n").alias("elements"), F.countDistinct("name").alias("tensors")
    )
    total = shards.agg(
        (100.0 * F.sum(F.when(F.col("trainable"), F.size("values")).otherwise(0)) / F.sum(F.size("values"))).alias("p")
    ).scalar()
    decays = F.col("trainable") & (F.col("class") == "rest")
    return grouped.withColumn("weight_decay", decays).withColumn("percent_trainable", total)

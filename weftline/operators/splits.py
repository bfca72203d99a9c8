"""Shuffles, slices, splits and training orders.

Selections compare each row with the key found at a rank (see ``rank_marks``), so the corpus
itself is never sorted or shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SHUFFLE_SEED
from ..functions.draws import hash_bucket, order_key
from .ordered import key_shard, rank_marks, ranked, within


def _keyed(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_order", order_key(seed, key))


def shuffle_global(df: DataFrame, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Add ``position`` in the seeded order of the whole set."""
    keyed = _keyed(df, key, seed)
    return ranked(keyed, ["_order", key], "position", shard=key_shard(keyed, "_order")).drop("_order")


def shuffle_buffered(df: DataFrame, buffer: int, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Shuffle inside consecutive buffers of the source order; a window group holds one buffer."""
    blocks = ranked(df, [key], "_rank").withColumn("_block", F.floor(F.col("_rank") / buffer))
    inside = Window.partitionBy("_block").orderBy("_order")
    place = F.col("_block") * buffer + F.row_number().over(inside) - 1
    return _keyed(blocks, key, seed).withColumn("position", place.cast("long")).drop("_rank", "_block", "_order")


def read_slice(df: DataFrame, share: float, key: str = "doc_id") -> DataFrame:
    """The leading share of the rows in source order."""
    marks = rank_marks(df, key, {"end": lambda n: F.floor(n * F.lit(share))})
    return _where_within(df, marks, "end", F.col(key))


def _where_within(df: DataFrame, marks: Column, name: str, key: Column) -> DataFrame:
    return df.withColumn("_marks", marks).where(within(F.col("_marks"), name, key)).drop("_marks")


def sample_limit(df: DataFrame, limit: int, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """``limit`` rows in seeded order; -1 keeps all."""
    if limit == -1:
        return df
    keyed = _keyed(df, key, seed)
    marks = rank_marks(keyed, "_order", {"end": lambda n: F.lit(limit)}, key_shard(keyed, "_order"))
    return _where_within(keyed, marks, "end", F.col("_order")).drop("_order")


def pre_discard(df: DataFrame, factor: float, max_train: int, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Keep int(factor * max_train) seeded rows when there are more than that, before any other work."""
    return sample_limit(df, int(factor * max_train), key, seed)


def split_head(df: DataFrame, dev: int, test: int, max_train: int = -1, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Stream layout: dev first, then test, then train up to its cap."""
    keyed = _keyed(df, key, seed)
    rules = {"dev": lambda n: F.lit(dev), "test": lambda n: F.lit(dev + test)}
    rules["train"] = lambda n: n if max_train == -1 else F.lit(dev + test + max_train)
    return _label(keyed, rank_marks(keyed, "_order", rules, key_shard(keyed, "_order")), list(rules))


def split_tail(df: DataFrame, dev: int, test: int, max_train: int = -1, key: str = "doc_id", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Batch layout: train first up to its cap, dev and test at the end."""
    keyed = _keyed(df, key, seed)

    def train_end(n: Column) -> Column:
        return F.greatest(n - dev - test, F.lit(0))

    rules = {
        "train": lambda n: train_end(n) if max_train == -1 else F.least(train_end(n), F.lit(max_train)),
        "skipped": train_end,
        "dev": lambda n: train_end(n) + dev,
        "test": lambda n: n,
    }
    marks = rank_marks(keyed, "_order", rules, key_shard(keyed, "_order"))
    return _label(keyed, marks, list(rules)).where(F.col("split") != "skipped")


def _label(keyed: DataFrame, marks: Column, names: list[str]) -> DataFrame:
    marked = keyed.withColumn("_marks", marks)
    # the first name whose rank the row lies within
    label = F.coalesce(*[F.when(within(F.col("_marks"), name, F.col("_order")), name) for name in names])
    return marked.withColumn("split", label).where(F.col("split").isNotNull()).drop("_marks", "_order")


def split_hash(df: DataFrame, dev_share: float, test_share: float, key: str = "doc_id", seed: int = SHUFFLE_SEED, buckets: int = 10000) -> DataFrame:
    """Stateless split by hash bucket: stable on an unbounded stream and under replay."""
    bucket = hash_bucket(order_key(seed, key), buckets)
    dev, test = round(dev_share * buckets), round(test_share * buckets)
    label = F.when(bucket < dev, "dev").when(bucket < dev + test, "test").otherwise("train")
    return df.withColumn("split", label)


def epoch_order(samples: DataFrame, epochs: int, key: str = "sample_id") -> DataFrame:
    """A fresh order per epoch, seeded by the epoch number."""
    copies = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = copies.withColumn("_order", order_key(F.col("epoch").cast("string"), key))
    return ranked(keyed, ["_order", key], "position", keys=["epoch"], shard=key_shard(keyed, "_order")).drop("_order")


def resume_order(order: DataFrame, step: int, batch: int) -> DataFrame:
    """Drop the samples an interrupted epoch has already seen; the count is taken modulo the epoch length."""
    length = order.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    seen = F.pmod(F.lit(step * batch), F.col("_n"))
    return order.join(F.broadcast(length), "epoch").where(F.col("position") >= seen).drop("_n")  # one row per epoch


def batch_assign(order: DataFrame, batch: int, drop_last: bool) -> DataFrame:
    """Fixed batches along the order; training drops a partial last batch, validation keeps it."""
    out = order.withColumn("batch_id", F.floor(F.col("position") / batch))
    if not drop_last:
        return out
    length = order.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    return out.join(F.broadcast(length), "epoch").where(F.col("batch_id") < F.floor(F.col("_n") / batch)).drop("_n")


def step_plan(order: DataFrame, micro: int, devices: int, accumulation: int) -> DataFrame:
    """Optimiser step, accumulation slot and device of each sample: a step is micro * devices * accumulation samples."""
    per_iter = micro * devices
    place = F.col("position")
    return (
        order.withColumn("step", F.floor(place / (per_iter * accumulation)))
        .withColumn("accumulation", F.floor(place / per_iter) % accumulation)
        .withColumn("device", F.floor((place % per_iter) / micro))
    )

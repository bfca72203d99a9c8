"""Embedding rows for a target vocabulary from those of a source vocabulary.

Vectors are (token, id, vec array<double>), targets are (token, id). Draws are keyed by
(seed, id, dimension), so they do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SHUFFLE_SEED, TRANSFER_SPECIALS
from ..functions.draws import standard_normals

RANDOM_SCALE = 0.02


def padded_targets(targets: DataFrame, first_id: int, multiple: int) -> DataFrame:
    """Targets with unnamed filler rows, so that the matrix height is a multiple of ``multiple``."""
    size = F.col("n") + first_id
    wanted = (F.ceil(size / multiple) * multiple).cast("long")
    filler = (
        targets.agg(F.count(F.lit(1)).alias("n"))
        .where(size < wanted)
        .select(F.explode(F.sequence(size, wanted - 1)).alias("id"))
        .select(F.lit(None).cast("string").alias("token"), F.col("id").cast("int").alias("id"))
    )
    return targets.select("token", F.col("id").cast("int").alias("id")).unionByName(filler)


def moments(vectors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per key, the mean and sample deviation of every dimension as arrays. A single row has deviation 0."""
    keys = keys or []
    flat = vectors.select(*keys, F.posexplode("vec").alias("dim", "value"))
    per_dim = flat.groupBy(*keys, "dim").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std")
    )
    # a group holds one row per dimension
    rows = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return (
        per_dim.groupBy(*keys)
        .agg(rows.alias("rows"))
        .select(*keys, F.transform("rows", lambda r: r["mean"]).alias("mean"), F.transform("rows", lambda r: r["std"]).alias("std"))
    )


def draw(mean: Column, std: Column, seed: int) -> Column:
    draws = standard_normals(seed, F.col("id"), F.size(mean))
    return F.zip_with(F.zip_with(std, draws, lambda s, z: s * z), mean, lambda v, m: m + v)


def init_mean(targets: DataFrame, source: DataFrame, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Every target row drawn from the source's per-dimension normal distribution."""
    facts = moments(source).select(F.struct("mean", "std").alias("m")).scalar()
    drawn = targets.select("token", "id", facts.alias("_m"))
    return drawn.select("token", "id", draw(F.col("_m.mean"), F.col("_m.std"), seed).alias("vec"))


def init_random(targets: DataFrame, dim: int | Column, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Standard normal draws times 0.02."""
    width = F.lit(dim) if isinstance(dim, int) else dim
    sized = targets.select("token", "id", width.alias("_dim"))
    return sized.select("token", "id", _small_draws(F.col("_dim"), seed).alias("vec"))


def _small_draws(width: Column, seed: int) -> Column:
    return F.transform(standard_normals(seed, F.col("id"), width), lambda z: z * RANDOM_SCALE)


def vector_width(source: DataFrame) -> Column:
    return source.agg(F.max(F.size("vec")).alias("dim")).scalar()


def init_rank_copy(targets: DataFrame, source: DataFrame, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Rows copied by id; ids beyond the source stay random."""
    copies = source.select("id", F.col("vec").alias("_copy"))
    joined = targets.join(copies, "id", "left").withColumn("_dim", vector_width(source))
    return joined.select("token", "id", F.coalesce(F.col("_copy"), _small_draws(F.col("_dim"), seed)).alias("vec"))


def init_identity(targets: DataFrame, source: DataFrame, specials: list[str] = TRANSFER_SPECIALS) -> DataFrame:
    """Rows of the tokens that both vocabularies share, special tokens left out."""
    return targets.where(~F.col("token").isin(specials)).join(source.select("token", "vec"), "token").select("token", "id", "vec")


def init_by_category(targets: DataFrame, source: DataFrame, omit: str = "special", seed: int = SHUFFLE_SEED) -> DataFrame:
    """Draws from the moments of the token's category, for categories present on both sides.

    Both sides are (token, id, category); source also has ``vec``.
    """
    facts = moments(source.where(F.col("category") != omit), ["category"])
    joined = targets.where(F.col("category") != omit).join(F.broadcast(facts), "category")  # two rows per script at most
    return joined.select("token", "id", draw(F.col("mean"), F.col("std"), seed).alias("vec"))


def init_heuristic(
    targets: DataFrame, source: DataFrame, omit: str = "special", specials: list[str] = TRANSFER_SPECIALS, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """Copy of the same token, else a draw by category, else a small random row.

    Both sides are (token, id, category), source also has ``vec``. The layers meet in one row, so only the one that counts is drawn.
    """
    facts = moments(source.where(F.col("category") != omit), ["category"])
    copies = source.where((F.col("category") != omit) & ~F.col("token").isin(specials)).select("token", F.col("vec").alias("_copy"))
    named = targets.where(F.col("category") != omit)
    joined = (
        named.join(F.broadcast(facts), "category", "left")  # two rows per script at most
        .join(copies, "token", "left")
        .withColumn("_dim", vector_width(source))
    )
    drawn = F.when(F.col("mean").isNotNull(), draw(F.col("mean"), F.col("std"), seed))
    return joined.select("token", "id", F.coalesce(F.col("_copy"), drawn, _small_draws(F.col("_dim"), seed)).alias("vec"))

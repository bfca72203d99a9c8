"""Similarity-weighted transfer: tokens of both vocabularies are copied, the others become
weighted means of them, with weights from an auxiliary vector space.

Similarities are computed block against block with one matrix product per task. A task sees at
most BLOCK x BLOCK tokens and reports only what can still matter, so no pair table ever exists.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import SHUFFLE_SEED, WORD_MARK
from ..session import written
from .transfer import draw, moments

BLOCK = 4096


def canonical(token, exact: bool, match_symbols: bool):
    """Match key of a token: itself, or without word mark and case; symbols may ignore the mark on their own."""
    bare = F.regexp_replace(token, "^" + WORD_MARK, "")
    loose = F.lower(F.when(bare == "", token).otherwise(bare))
    if not exact:
        return loose
    return F.when(~token.rlike(r"\p{L}"), loose).otherwise(token) if match_symbols else token


def match_overlap(targets: DataFrame, source: DataFrame, exact: bool = True, match_symbols: bool = False) -> DataFrame:
    """Source id of every target token with an equal match key: the same token first, else the lowest id."""
    same = source.select("token", F.col("id").alias("_same"))
    if exact and not match_symbols:
        return targets.join(same, "token").select("token", "id", F.col("_same").alias("source_id"))
    key = canonical(F.col("token"), exact, match_symbols)
    loose = source.groupBy(key.alias("_key")).agg(F.min("id").alias("_loose"))
    found = targets.withColumn("_key", key).join(same, "token", "left").join(loose, "_key", "left")
    return found.select("token", "id", F.coalesce("_same", "_loose").alias("source_id")).where(F.col("source_id").isNotNull())


def _blocked(queries: DataFrame, keys: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Run ``run(query block, key block, similarities)`` for all block pairs. Vocabulary ids are dense, so a block is an id range."""
    q = queries.withColumn("_qb", F.floor(F.col("id") / BLOCK))
    k = keys.withColumn("_kb", F.floor(F.col("id") / BLOCK))
    q_last = queries.agg(F.coalesce(F.max(F.floor(F.col("id") / BLOCK)), F.lit(0)).alias("b")).scalar()
    k_last = keys.agg(F.coalesce(F.max(F.floor(F.col("id") / BLOCK)), F.lit(0)).alias("b")).scalar()
    q = q.withColumn("_last", k_last).withColumn("_kb", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")
    k = k.withColumn("_last", q_last).withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")

    # fresh column identities: both sides may come from the same table
    k = k.select(*[F.col(c).alias(c) for c in k.columns])

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        left, right = left.sort_values("id"), right.sort_values("id")
        return run(left, right, _unit(left["aux"]) @ _unit(right["aux"]).T)

    return q.groupBy("_qb", "_kb").cogroup(k.groupBy("_qb", "_kb")).applyInPandas(pair, schema)


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_list()).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _support(left: pd.DataFrame, right: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
    """Similarities that can be in the sparsemax support: adding blocks only raises its threshold, so the rest is out for good."""
    z = -np.sort(-sims, axis=1)
    steps = np.arange(1, z.shape[1] + 1)
    size = (1 + steps * z > np.cumsum(z, axis=1)).sum(axis=1)
    keep = np.arange(z.shape[1]) < size[:, None]
    rows, cols = np.nonzero(keep)
    return pd.DataFrame({"id": left["id"].to_numpy()[rows], "sim": z[rows, cols]})


def sparsemax_thresholds(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Sparsemax threshold of every query (id, aux) over all keys (id, aux)."""
    near = _blocked(queries, keys, _support, "id int, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"))  # one token's support per block
    ranked = near.withColumn("k", F.row_number().over(order)).withColumn(
        "total", F.sum("sim").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = ranked.where(1 + F.col("k") * F.col("sim") > F.col("total"))
    return inside.groupBy("id").agg(F.max_by((F.col("total") - 1) / F.col("k"), "k").alias("tau"))


def _combine(partial: DataFrame) -> DataFrame:
    """Sum partial vectors of an id; there is one per key block."""
    flat = partial.select("id", F.posexplode("part").alias("dim", "v")).groupBy("id", "dim").agg(F.sum("v").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("dim", "v")))  # one row per dimension
    return flat.groupBy("id").agg(rows.alias("rows")).select("id", F.transform("rows", lambda r: r["v"]).alias("vec"))


def overlap_means(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Sparsemax-weighted mean of key vectors for every query: (id, vec) from (id, aux) and (id, aux, vec)."""
    taus = sparsemax_thresholds(queries, keys.select("id", "aux"))

    def weigh(left: pd.DataFrame, right: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        weights = np.maximum(sims - left["tau"].to_numpy()[:, None], 0.0)
        sums = weights @ np.stack(right["vec"].to_list())
        return pd.DataFrame({"id": left["id"].to_numpy(), "part": list(sums)})

    return _combine(_blocked(queries.join(taus, "id"), keys, weigh, "id int, part array<double>"))


def neighbour_means(queries: DataFrame, keys: DataFrame, neighbours: int, temperature: float) -> DataFrame:
    """Softmax-weighted mean over the most similar keys; equal similarities at the limit are all taken."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        top = -np.sort(-sims, axis=1)[:, :neighbours]
        return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), top.shape[1]), "sim": top.ravel()})

    near = _blocked(queries, keys.select("id", "aux"), nearest, "id int, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"))
    limits = (
        near.withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= neighbours)
        .groupBy("id")
        .agg(F.min("sim").alias("least"), F.max("sim").alias("best"))
    )

    def weigh(left: pd.DataFrame, right: pd.DataFrame, sims: np.ndarray) -> pd.DataFrame:
        near = sims >= left["least"].to_numpy()[:, None] - 1e-12
        weights = np.where(near, np.exp((sims - left["best"].to_numpy()[:, None]) / temperature), 0.0)
        vectors = np.stack(right["vec"].to_list())
        sums = weights @ np.hstack([vectors, np.ones((len(vectors), 1))])
        return pd.DataFrame({"id": left["id"].to_numpy(), "part": list(sums)})

    summed = _combine(_blocked(queries.join(limits, "id"), keys, weigh, "id int, part array<double>"))
    total = F.element_at("vec", -1)
    return summed.select("id", F.transform(F.slice("vec", F.lit(1), F.size("vec") - 1), lambda v: v / total).alias("vec"))


def init_overlap(
    targets: DataFrame,
    source: DataFrame,
    auxiliary: DataFrame,
    exact: bool = True,
    match_symbols: bool = False,
    seed: int = SHUFFLE_SEED,
) -> DataFrame:
    """Copies for the overlap, weighted means for other tokens with an auxiliary vector, draws from the source's moments for the rest.

    ``targets`` (token, id), ``source`` (token, id, vec), ``auxiliary`` (token, aux) over target tokens.
    """
    matched = match_overlap(targets, source, exact, match_symbols)
    copied = matched.join(source.select(F.col("id").alias("source_id"), "vec"), "source_id").select("token", "id", "vec")
    # both are at most a vocabulary long and read by every block pair of two passes: written once
    keys = written(copied.join(auxiliary, "token").select("id", "aux", "vec"), "overlap-keys")
    others = written(targets.join(copied.select("id"), "id", "left_anti").join(auxiliary, "token").select("id", "aux"), "overlap-queries")
    means = overlap_means(others, keys)
    facts = moments(source).select(F.struct("mean", "std").alias("m")).scalar()
    out = targets.select("token", "id", facts.alias("_m"))
    for name, layer in (("a", copied), ("b", means)):
        out = out.join(layer.select("id", F.col("vec").alias(f"_{name}")), "id", "left")
    kind = F.when(F.col("_a").isNotNull(), "copied").when(F.col("_b").isNotNull(), "weighted").otherwise("drawn")
    vec = F.coalesce(F.col("_a"), F.col("_b"), draw(F.col("_m.mean"), F.col("_m.std"), seed))
    return out.select("token", "id", kind.alias("kind"), vec.alias("vec"))

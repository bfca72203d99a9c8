"""Deterministic order keys and random draws that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *cols) -> Column:
    """Seeded order: md5 of seed and identifiers, a uniform 32-digit hexadecimal key."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket of a hexadecimal key, from its leading eight digits."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(buckets).cast("long"))


def standard_normals(seed: int, ident: Column, count: Column) -> Column:
    """Array of ``count`` Box-Muller draws keyed by (seed, ident, position).

    One md5 gives four uniforms and with them two pairs of draws, so a vector costs a quarter of a digest per value.
    """
    blocks = F.sequence(F.lit(0), F.floor((count - 1) / 4).cast("int"))
    digests = F.transform(blocks, lambda b: order_key(seed, ident, b))

    def uniform(key: Column, start: int) -> Column:
        return (F.conv(F.substring(key, start, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)

    def pairs(key: Column, start: int) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(key, start)))
        return F.struct(radius.alias("r"), (F.lit(2.0 * math.pi) * uniform(key, start + 8)).alias("a"))

    polar = F.flatten(F.transform(digests, lambda key: F.array(pairs(key, 1), pairs(key, 17))))
    draws = F.flatten(F.transform(polar, lambda p: F.array(p["r"] * F.cos(p["a"]), p["r"] * F.sin(p["a"]))))
    return F.slice(draws, F.lit(1), count)

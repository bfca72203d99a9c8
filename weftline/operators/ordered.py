"""Ordered scans that never put the data in one partition.

A shard is any column that grows with the order key. There are as many as the rows ask for: at least
``SHARDS`` (``KEY_SHARDS`` for seeded keys), then one per ``SHARD_ROWS`` rows, by a count that is read
inside the query. Totals per shard form a table of one row per shard and key; its running sum gives
every shard a base, and a local window inside (key, shard) does the rest. Hot keys are cut by the shard,
so no window group grows with a key. Shards come from the data alone, so a retried task gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 256  # power of two: shards by quantiles
KEY_SHARDS = 4096  # least shards of a seeded key
SHARD_ROWS = 1 << 16  # rows of a shard beyond which there are more shards
_SHARD = "_shard"


def key_shard(df: DataFrame, key: str) -> Column:
    """Shard of a seeded hexadecimal key. The key is uniform, so shards are even, about ``SHARD_ROWS`` rows each in a large table."""
    shards = df.agg(F.greatest(F.lit(KEY_SHARDS), F.ceil(F.count(F.lit(1)) / SHARD_ROWS)).cast("long").alias("n")).scalar()
    leading = F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long")
    return F.shiftright(leading * shards, 32)


def with_range_shard(df: DataFrame, order: str, shards: int = SHARDS, rows: int | None = None) -> DataFrame:
    """Add the shard of any numeric order column: its quantile range, cut evenly into parts of about ``rows`` rows.

    Quantiles, ends and count are one mergeable aggregate read through a scalar subquery; the binary search
    costs log2(shards) steps per row. Clustered values are cut by the quantiles, equal values share a shard.
    """
    marks = [i / shards for i in range(shards + 1)]
    parts = F.ceil(F.count(F.lit(1)) / (shards * (rows or SHARD_ROWS))).cast("long")
    facts = df.agg(F.struct(F.percentile_approx(order, marks, 10000).alias("bounds"), parts.alias("parts")).alias("facts")).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(shards.bit_length() - 1))])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: at + F.when(F.get(F.col("_facts.bounds"), at + step) <= F.col(order), step).otherwise(F.lit(0)),
    )
    low, high = (F.get(F.col("_facts.bounds"), F.col(_SHARD) + i).cast("double") for i in (0, 1))
    share = (F.col(order).cast("double") - low) / (high - low)
    part = F.greatest(F.lit(0), F.least(F.col("_facts.parts") - 1, F.floor(share * F.col("_facts.parts"))))
    fine = F.when(F.col("_facts.parts") > 1, F.col(_SHARD) * F.col("_facts.parts") + F.coalesce(F.when(high > low, part), F.lit(0)))
    # rows without an order key come first; a shard is never null, so no null check repeats the search
    coarse = df.withColumn("_facts", facts).withColumn(_SHARD, F.coalesce(found, F.lit(0)))
    return coarse.withColumn(_SHARD, F.coalesce(fine, F.col(_SHARD).cast("long"))).drop("_facts")


def running_sums(
    df: DataFrame,
    order: list[str],
    sums: dict[str, Column],
    keys: list[str] | None = None,
    shard: Column | None = None,
    totals_too: bool = False,
) -> DataFrame:
    """Add exclusive running sums of ``sums`` along ``order`` inside ``keys``, on request with ``<name>_total`` of the key.

    The totals read only the key, shard and summed columns. The shard shuffle of the main
    side serves both the base join and the window.
    """
    keys = keys or []
    tagged = with_range_shard(df, order[0]) if shard is None else df.withColumn(_SHARD, shard)
    names = list(sums)
    tagged = tagged.select("*", *[sums[n].alias(f"_v_{n}") for n in names])
    totals = tagged.groupBy(*keys, _SHARD).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy(_SHARD).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    # one row per shard and key here
    bases = totals.select(
        *keys,
        _SHARD,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in names if totals_too],
    )
    inside = Window.partitionBy(*keys, _SHARD).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in names])
    # Null keys are a group like any other.
    own = bases.withColumnsRenamed({n: f"_of_{n}" for n in [*keys, _SHARD]})
    # a shard is never null: a plain equality lets the join use the exchange of the window
    same = [local[n].eqNullSafe(own[f"_of_{n}"]) for n in keys] + [local[_SHARD] == own[f"_of_{_SHARD}"]]
    joined = local.join(own, same).drop(*[f"_of_{n}" for n in [*keys, _SHARD]])
    running = [(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in names]
    return joined.select(*df.columns, *running, *[f"{n}_total" for n in names if totals_too])


def ranked(df: DataFrame, order: list[str], name: str = "rank", keys: list[str] | None = None, shard: Column | None = None) -> DataFrame:
    """Zero-based rank along ``order``."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, keys, shard)


def windowed(
    df: DataFrame,
    keys: list[str],
    position: str,
    width: int,
    aggregates: Callable[[object], dict[str, Column]],
    block: int | None = None,
) -> DataFrame:
    """Aggregates over the last ``width`` rows of each key, where ``position`` is its dense zero-based rank.

    A key is cut into blocks of positions. The last ``width - 1`` rows of a block are copied to the
    next one, so every frame is whole inside its block and a hot key spreads over many tasks.
    """
    block = block or max(4096, 8 * width)
    at = F.floor(F.col(position) / block)
    tail = (F.col(position) % block) >= block - (width - 1)
    copies = F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))
    spread = df.withColumn("_block", F.explode(copies))
    frame = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-(width - 1), 0)
    named = aggregates(frame)
    out = spread.select("*", *[c.alias(n) for n, c in named.items()])
    return out.where(F.col("_block") == at).drop("_block")


def rank_marks(df: DataFrame, key: str, marks: dict[str, Callable[[Column], Column]], shard: Column | None = None) -> Column:
    """Keys found at given ranks, as one struct value.

    ``marks`` maps a name to its rank as a function of the row count. Only shard counts and the
    rows of the few shards that hold a mark are looked at, so that a split or slice of a corpus
    needs no shuffle of the corpus: rows are compared with the mark keys where they are.
    """
    slim = df.select(F.col(key).alias("_key"))
    slim = with_range_shard(slim, "_key") if shard is None else df.select(F.col(key).alias("_key"), shard.alias(_SHARD))
    counts = slim.groupBy(_SHARD).agg(F.count(F.lit(1)).alias("cnt"))
    before = Window.orderBy(_SHARD).rowsBetween(Window.unboundedPreceding, -1)
    # one row per shard here
    based = counts.select(
        _SHARD, "cnt", F.coalesce(F.sum("cnt").over(before), F.lit(0)).alias("base"), F.sum("cnt").over(Window.partitionBy()).alias("n")
    )
    ranks = F.array(*[F.struct(F.lit(name).alias("mark"), rule(F.col("n")).cast("long").alias("want")) for name, rule in marks.items()])
    wanted = counts.agg(F.sum("cnt").alias("n")).select(F.explode(ranks).alias("m")).select("m.mark", "m.want")
    here = F.filter(ranks, lambda r: (r["want"] > F.col("base")) & (r["want"] <= F.col("base") + F.col("cnt")))
    hit = based.select(_SHARD, "base", F.explode(here).alias("m")).select("m.mark", _SHARD, (F.col("m.want") - F.col("base")).alias("nth"))
    inside = Window.partitionBy("mark", _SHARD).orderBy("_key")
    found = (
        slim.join(F.broadcast(hit), _SHARD)  # one row per mark
        .withColumn("_n", F.row_number().over(inside))
        .where(F.col("_n") == F.col("nth"))
        .select("mark", "_key", F.lit(None).cast("long").alias("want"))
    )
    key_type = slim.schema["_key"].dataType
    both = found.unionByName(wanted.select("mark", F.lit(None).cast(key_type).alias("_key"), "want"))
    fields = []
    for name in marks:
        mine = F.col("mark") == name
        fields.append(F.max(F.when(mine, F.col("_key"))).alias(name))
        fields.append(F.max(F.when(mine, F.col("want"))).alias(f"{name}_rank"))
    return both.agg(F.struct(*fields).alias("marks")).scalar()


def within(marks: Column, name: str, key: Column) -> Column:
    """True for rows among the first ``rank`` rows: a rank past the end takes all, a rank of 0 none."""
    return F.coalesce(key <= marks[name], marks[f"{name}_rank"] > 0)

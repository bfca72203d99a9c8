"""Greedy packing of whole documents into samples, exact and in parallel.

Documents are walked in seeded order. One longer than the block becomes a sample of its own and
leaves the open chunk open; any other is appended, and the chunk closes once it holds
``block + 1`` tokens. The walk looks sequential, but all a shard needs from the ones before it is
the length of the chunk open at its border, a number from 0 to ``block``:

1. every shard reports, for each range of incoming lengths, its outgoing length and closed chunks
   (``block + 2`` rows at most, since incoming lengths that close at the same document agree);
2. these reports are functions from incoming to outgoing length that compose: a group of shards has a report of the same
   form and size. Groups of at most 256 reports are composed level by level, the reports of the last level are chained,
   and the true incoming lengths go back down to the groups and to the shards;
3. every shard walks its documents once from there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SHUFFLE_SEED
from ..functions.draws import order_key

SHARD_DOCS = 1 << 19
FAN_BITS = 8  # a group composes 256 reports

_REPORT = "shard long, low long, high long, out long, closed long, absolute boolean"
_START = "shard long, carry long, first_chunk long, chunks long"


def _walk_order(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["high_key", "low_key", "doc_id"], kind="stable")


def _close_points(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for every start the end of its chunk (past the end when it stays open)."""
    prefix = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
    return prefix, np.searchsorted(prefix, prefix + block + 1, side="left")


def _report_shard(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    prefix, ends = _close_points(_walk_order(pdf)["len"].to_numpy(), block)
    n = len(pdf)
    seen: dict[int, tuple[int, int]] = {}

    def follow(start: int) -> tuple[int, int]:
        path, at = [], start
        while at not in seen and ends[at] <= n:
            path.append(at)
            at = int(ends[at])
        out, closed = seen.get(at, (int(prefix[n] - prefix[at]), 0))
        seen.setdefault(at, (out, closed))
        for at in reversed(path):
            closed += 1
            seen[at] = (out, closed)
        return out, closed

    rows, low = [], 0
    shard = int(pdf["shard"].iloc[0])
    # lengths that leave the chunk open through the whole shard
    if prefix[n] <= block:
        rows.append((shard, 0, int(block - prefix[n]), int(prefix[n]), 0, False))
        low = int(block - prefix[n]) + 1
    while low <= block:
        end = int(np.searchsorted(prefix, block + 1 - low, side="left"))
        high = min(block, int(block - prefix[end - 1]))
        out, closed = follow(end)
        rows.append((shard, low, high, out, closed + 1, True))
        low = high + 1
    return pd.DataFrame(rows, columns=["shard", "low", "high", "out", "closed", "absolute"])


def _compose_reports(pdf: pd.DataFrame, block: int) -> pd.DataFrame:
    """The report of a group from those of its shards. Its pieces cut 0 to ``block``, so there are block + 1 at most."""
    low, high = np.array([0]), np.array([block])
    out, closed, absolute = np.array([0]), np.array([0]), np.array([False])
    for _, report in pdf.sort_values(["shard", "low"]).groupby("shard", sort=True):
        lows, highs, outs, more, fixed = (report[c].to_numpy() for c in ("low", "high", "out", "closed", "absolute"))
        for at in np.flatnonzero(~absolute):  # the one piece, if any, whose chunk is still open: cut where the next report changes
            shift = out[at]
            meets = (highs >= low[at] + shift) & (lows <= high[at] + shift)
            k = int(meets.sum())
            pieces = np.maximum(lows[meets] - shift, low[at]), np.minimum(highs[meets] - shift, high[at])
            low, high = (np.concatenate((x[:at], new, x[at + 1 :])) for x, new in zip((low, high), pieces))
            out, closed, absolute = (np.concatenate((x[:at], np.repeat(x[at], k), x[at + 1 :])) for x in (out, closed, absolute))
        hit = np.searchsorted(highs, np.where(absolute, out, low + out), side="left")
        out, closed, absolute = np.where(fixed[hit], outs[hit], out + outs[hit]), closed + more[hit], absolute | fixed[hit]
    return pd.DataFrame({"shard": int(pdf["group"].iloc[0]), "low": low, "high": high, "out": out, "closed": closed, "absolute": absolute})


def _chain_reports(pdf: pd.DataFrame, start: pd.DataFrame | None = None) -> pd.DataFrame:
    """Incoming lengths and first chunks in shard order, from those of the group; without them it is the whole walk."""
    carry, chunk = (0, 0) if start is None else (int(start["carry"].iloc[0]), int(start["first_chunk"].iloc[0]))
    rows = []
    for shard, report in pdf.sort_values(["shard", "low"]).groupby("shard", sort=True):
        rows.append((shard, carry, chunk))
        hit = report.iloc[int(np.searchsorted(report["high"].to_numpy(), carry, side="left"))]
        carry = int(hit["out"]) if hit["absolute"] else carry + int(hit["out"])
        chunk += int(hit["closed"])
    chunks = chunk if start is None else int(start["chunks"].iloc[0])
    return pd.DataFrame(rows, columns=["shard", "carry", "first_chunk"]).assign(chunks=chunks)


def _walk_shard(docs: pd.DataFrame, start: pd.DataFrame, block: int) -> pd.DataFrame:
    docs = _walk_order(docs)
    prefix, ends = _close_points(docs["len"].to_numpy(), block)
    n = len(docs)
    at = int(np.searchsorted(prefix, block + 1 - int(start["carry"].iloc[0]), side="left"))
    borders = []
    while at <= n:
        borders.append(at)
        at = int(ends[at])
    chunk = int(start["first_chunk"].iloc[0]) + np.searchsorted(np.array(borders, dtype=np.int64), np.arange(n), side="right")
    walked = pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "no_id": docs["no_id"].to_numpy(), "chunk": chunk})
    return walked[chunk < int(start["chunks"].iloc[0])]


def pack_greedy(
    docs: DataFrame, block: int, seed: int = SHUFFLE_SEED, skip_last: bool = False, shards: int | None = None, levels: int = 1
) -> DataFrame:
    """Members of every sample: (sample_id, doc_id, order) from documents (doc_id, len).

    Members of a sample follow ``order``. Packed samples have even ids in closing order, a document
    longer than the block has the odd id 2 * doc_id + 1. The chunk still open at the end is dropped.
    The result does not depend on ``shards``: unset, a shard holds about SHARD_DOCS documents. Nor does it depend on
    ``levels`` of groups: with one, no group has over 256 reports up to 2^35 documents; each more serves 256 times as many.
    """
    docs = docs.select("doc_id", F.col("len").cast("long").alias("len"))
    counted = docs.agg(F.greatest(F.lit(16), F.floor(F.count(F.lit(1)) / SHARD_DOCS)).cast("long").alias("n"))
    shards = counted.scalar() if shards is None else F.lit(shards).cast("long")
    if skip_last:
        last = docs.agg(F.max("doc_id").alias("last")).scalar()
        docs = docs.where(F.col("doc_id") != last)

    def digits(first: int, count: int) -> Column:
        return F.conv(F.substring("order", first, count), 16, 10).cast("long")

    # tasks sort by the leading 30 digits of the key as two numbers
    keyed = docs.withColumn("order", order_key(seed, "doc_id"))
    alone = keyed.where(F.col("len") > block).select((F.col("doc_id") * 2 + 1).alias("sample_id"), "doc_id", "order")
    # a null would turn the whole column into floats in a task, so a null id is a mark beside 0; it comes first
    short = keyed.where(F.col("len") <= block).select(
        F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        "len",
        F.coalesce(digits(1, 15), F.lit(-1)).alias("high_key"),
        F.coalesce(digits(16, 15), F.lit(-1)).alias("low_key"),
        F.coalesce(F.shiftright(digits(1, 8) * shards, 32), F.lit(0)).alias("shard"),
    )

    reports = short.groupBy("shard").applyInPandas(lambda pdf: _report_shard(pdf, block), _REPORT)
    below = []
    for _ in range(levels):
        below.append(reports.withColumn("group", F.expr(f"shiftright(shard, {FAN_BITS})")))
        reports = below[-1].groupBy("group").applyInPandas(lambda pdf: _compose_reports(pdf, block), _REPORT)
    # the root of the tree; a report has as many rows as documents fit in one chunk, block + 2 at most
    starts = reports.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: _chain_reports(pdf), _START)
    for reports in reversed(below):
        starts = reports.groupBy("group").cogroup(starts.groupBy("shard")).applyInPandas(lambda r, s: _chain_reports(r, s), _START)
    walked = (
        short.groupBy("shard")
        .cogroup(starts.groupBy("shard"))
        .applyInPandas(lambda d, s: _walk_shard(d, s, block), "doc_id long, no_id boolean, chunk long")
        .withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id")))
    )
    packed = walked.select((F.col("chunk") * 2).alias("sample_id"), "doc_id", order_key(seed, "doc_id").alias("order"))
    return packed.unionByName(alone)


def pack_report(members: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """Samples built, documents in, most documents in one sample, fill and tokens left out."""
    per_sample = (
        members.join(docs.select("doc_id", "len"), "doc_id")
        .groupBy("sample_id")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("len").alias("tokens"))
    )
    used = F.sum(F.least(F.col("tokens"), F.lit(block + 1).cast("long")))
    built = per_sample.agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("docs").alias("docs_used"),
        F.max("docs").alias("max_docs"),
        used.alias("tokens_used"),
    )
    given = docs.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("t"))
    facts = given.agg(F.max(F.struct("n", "t")).alias("given")).scalar()
    return (
        built.withColumn("given", facts)
        .select(
            "samples",
            F.col("given.n").alias("docs_in"),
            F.coalesce("docs_used", F.lit(0)).alias("docs_used"),
            F.coalesce("max_docs", F.lit(0)).alias("max_docs"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            (F.col("given.t") - F.coalesce("tokens_used", F.lit(0))).alias("tokens_dropped"),
            F.round(F.col("tokens_used") / (F.col("samples") * (block + 1)), 6).alias("fill"),
        )
    )

"""Fixed training samples from token rows: packed, single-document and contiguous access."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import ensure_marks, mask_labels, pad_right, segments
from ..functions.constants import IGNORE_ID, PAD_ID
from .ordered import running_sums

PACKED = "docs-iid-packed"
PACKED_PLAIN = "docs-iid-packed-no-attn-fix"
PADDED = "single-doc-padded"
TRUNCATED = "single-doc-truncated"
FULL = "single-doc-full"
CONTIGUOUS = "contiguous"


def access_for(study: bool, clipped_validation: bool) -> dict[str, str | bool]:
    """Access modes and document mark of a run: a study run packs with segments and bos, others plainly with eos."""
    return {
        "train": PACKED if study else PACKED_PLAIN,
        "validation": FULL if clipped_validation else PADDED,
        "bos": study,
        "eos": not study,
    }


def packed_samples(
    members: DataFrame, tokens: DataFrame, block: int, bos: bool, eos: bool, segment_mask: bool, mask_bos: bool = False, mask_eos: bool = False
) -> DataFrame:
    """Samples of ``block`` ids with shifted labels, and on request a document number per position.

    A sample only sees its first ``block + 1`` ids, so each document is cut to that before the shuffle
    (its own end mark counts only if the document ends before the cut).
    """
    ids = ensure_marks(F.col("ids"), bos, eos)
    slim = tokens.select("doc_id", F.slice(ids, 1, block + 1).alias("ids"))
    gathered = (
        members.join(slim, "doc_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("order", "doc_id", "ids"))).alias("docs"))
    )
    docs = gathered.select("sample_id", F.transform("docs", lambda d: d["ids"]).alias("docs"))
    columns = [F.slice(F.flatten("docs"), 1, block + 1).alias("data")]
    if segment_mask:
        columns.append(F.slice(segments(F.col("docs")), 1, block).alias("segments"))
    cut = docs.select("sample_id", *columns)
    x = pad_right(F.slice("data", 1, block), block, PAD_ID)
    y = pad_right(F.slice("data", 2, block), block, IGNORE_ID)
    shaped = cut.select("sample_id", x.alias("input_ids"), y.alias("labels"), *(["segments"] if segment_mask else []))
    labels = mask_labels(F.col("input_ids"), F.col("labels"), mask_bos, mask_eos)
    out = ["sample_id", "input_ids", labels.alias("labels")]
    if segment_mask:
        numbered = pad_right(F.col("segments"), block, 0)
        out.append(F.zip_with(numbered, "input_ids", lambda s, a: F.when(a == PAD_ID, 0).otherwise(s)).alias("segment_ids"))
    return shaped.select(*out)


def document_samples(
    tokens: DataFrame, block: int, access: str, bos: bool = False, eos: bool = False, mask_bos: bool = False, mask_eos: bool = False
) -> DataFrame:
    """One sample per document: padded to the block, cut to it, or whole. Plain expressions, no shuffle."""
    ids = ensure_marks(F.col("ids"), bos, eos)
    data = ids if access == FULL else F.slice(ids, 1, block + 1)
    cut = tokens.select(F.col("doc_id").alias("sample_id"), data.alias("data")).where(F.size("data") > 0)
    x, y = F.slice("data", F.lit(1), F.size("data") - 1), F.slice("data", F.lit(2), F.size("data"))
    if access == PADDED:
        x, y = pad_right(x, block, PAD_ID), pad_right(y, block, IGNORE_ID)
    shaped = cut.select("sample_id", x.alias("input_ids"), y.alias("labels"))
    return shaped.withColumn("labels", mask_labels(F.col("input_ids"), F.col("labels"), mask_bos, mask_eos))


def contiguous_samples(tokens: DataFrame, block: int) -> DataFrame:
    """Blocks of the token stream, document borders ignored, labels shifted by one and unmasked.

    Each document meets the blocks it touches by an explode over block numbers, so the overlap
    becomes an equi-grouping; a group holds at most ``block + 1`` ids. The token that opens a block
    is also the last label of the block before.
    """
    live = tokens.where(F.col("len") > 0).select("doc_id", "ids", F.col("len").cast("long").alias("len"))
    placed = running_sums(live, ["doc_id"], {"start": F.col("len")})
    first = F.floor((F.greatest(F.col("start"), F.lit(1)) - 1) / block)
    last = F.floor((F.col("start") + F.col("len") - 1) / block)
    touched = placed.withColumn("sample_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("sample_id") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("sample_id") + 1) * block + 1 - F.col("start"), F.col("len"))
    parts = touched.select(
        "sample_id", "start", F.slice("ids", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("part")
    )
    whole = tokens.agg(F.floor(F.sum("len") / block).alias("n")).scalar()
    grouped = parts.where(F.col("sample_id") < whole).groupBy("sample_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda p: p["part"])).alias("data")
    )
    y = pad_right(F.slice("data", 2, block), block, IGNORE_ID)
    return grouped.select("sample_id", F.slice("data", 1, block).alias("input_ids"), y.alias("labels"))


def training_samples(members: DataFrame, tokens: DataFrame, block: int, access: str, bos: bool, eos: bool) -> DataFrame:
    """Samples of any access mode. Contiguous access takes marks only at encode time."""
    if access in (PACKED, PACKED_PLAIN):
        return packed_samples(members, tokens, block, bos, eos, segment_mask=access == PACKED)
    if access == CONTIGUOUS:
        if bos or eos:
            raise ValueError("contiguous samples take no document marks")
        return contiguous_samples(tokens, block)
    if access in (PADDED, TRUNCATED, FULL):
        return document_samples(tokens, block, access, bos, eos)
    raise ValueError(f"unknown access: {access}")


def segment_lengths(samples: DataFrame, mask: str = "segment_ids", order: str = "sample_id", batch: str = "batch_id") -> DataFrame:
    """Length and start of every segment along the rows of its batch, as variable-length attention needs them.

    Lengths come from array expressions inside the row; a window holds one batch, without the masks.
    """
    top = F.coalesce(F.array_max(mask), F.lit(0))
    numbers = F.filter(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda s: s <= top)
    sizes = F.transform(numbers, lambda s: F.struct(s.alias("segment"), F.size(F.filter(mask, lambda m: m == s)).alias("len")))
    keys = list(dict.fromkeys([batch, order, "sample_id"]))
    rows = samples.select(*keys, F.filter(sizes, lambda s: s["len"] > 0).alias("parts"))
    total = F.aggregate(F.col("parts"), F.lit(0).cast("long"), lambda a, p: a + p["len"])
    before = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    based = rows.withColumn("total", total).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    inner = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["segment"].alias("segment"),
            p["len"].alias("seq_len"),
            F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, q: a + q["len"]).alias("before"),
        ),
    )
    flat = based.select(batch, "sample_id", "base", F.explode(inner).alias("p"))
    start = F.col("base") + F.col("p.before")
    return flat.select(batch, "sample_id", "p.segment", "p.seq_len", start.alias("cu_start"), (start + F.col("p.seq_len")).alias("cu_end"))


def filled_positions(samples: DataFrame, mask: str = "segment_ids") -> DataFrame:
    """Flat positions (row, column) that hold no padding."""
    return samples.select("sample_id", F.posexplode(mask).alias("column", "segment")).where(F.col("segment") != 0).drop("segment")


def segment_summary(lengths: DataFrame, batch: str = "batch_id") -> DataFrame:
    return lengths.groupBy(batch).agg(F.count(F.lit(1)).alias("segments"), F.max("seq_len").alias("max_seq_len"), F.max("cu_end").alias("tokens"))


def label_mask(pairs: DataFrame, mask_bos: bool = False, mask_eos: bool = False) -> DataFrame:
    return pairs.withColumn("labels", mask_labels(F.col("input_ids"), F.col("labels"), mask_bos, mask_eos))



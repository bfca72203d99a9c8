"""Exact copies by progressive refinement: length, then prefix hash, then full hash.

The first scan gives each row the length of its normalised text and a hash of its first characters. Lengths that occur
once end there, then pairs of length and prefix hash that occur once. Only rows of surviving pairs have their whole text
hashed, in a second scan that moves no text: the surviving pairs travel as a bit set of fixed size, and a row that passes
it by chance finds no partner in the last grouping.

Null and empty texts are equal to each other. Rows that repeat both an id and a text are copies like any others; one of
them stays. A null id counts as larger than every other. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import SPACE_RUN, only
from weftline.session import written

#: Characters that the prefix hash covers, and bits of the set of surviving pairs (128 KB in the plan).
PREFIX, BITS = 256, 1 << 20


def normalised(column: str):
    return F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), SPACE_RUN, " ")


def _bit_set(slots: DataFrame, bits: int):
    """The slots as a constant array of 64-bit words; at most ``bits`` / 64 rows reach the driver."""
    words = [0] * (bits >> 6)
    grouped = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    for row in grouped.toLocalIterator():
        words[row.word] = row.bits
    array = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda slot: F.call_function("shiftright", F.get(array, F.expr(f"cast({slot} div 64 as int)")), F.expr(f"cast({slot} % 64 as int)")).bitwiseAND(1) == 1


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS, digest_all: bool = False) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    text_sha256 is the full hash: of every row if ``digest_all``, else null where refinement ended before it was needed.
    """
    keyed = (
        only(docs, id_col, text_col)
        .select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
        .select("id", "norm", F.octet_length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head"))
    )
    keys = written(keyed.select("size", "head"), "copies-keys")
    pairs = keys.groupBy("size", "head").count()  # copies of one text are one row before anything is dealt by size
    sizes = pairs.groupBy("size").agg(F.sum("count").alias("of_size")).filter("of_size > 1").select("size")
    heads = pairs.join(sizes, "size").filter("count > 1")
    survives = _bit_set(heads.select(F.pmod(F.xxhash64("size", "head"), F.lit(bits)).alias("slot")), bits)
    keyed = keyed.withColumn("slot", F.pmod(F.xxhash64("size", "head"), F.lit(bits))).withColumn("survives", survives("slot"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    rows = written(keyed.select("id", "survives", (digest if digest_all else F.when(F.col("survives"), digest)).alias("digest")), "copies-digests")
    groups = (
        rows.filter("survives")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    single = rows.filter("not survives").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    joined = rows.filter("survives").join(groups, "digest", "left").select(
        "id", "digest", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    # Of rows that repeat the smallest id, one stays.
    same = Window.partitionBy("digest", "id").orderBy(F.lit(1))
    least = joined.filter("id <=> keep_id").withColumn("kept", F.row_number().over(same) == 1)
    rest = joined.filter("not (id <=> keep_id)").withColumn("kept", F.lit(False))
    out = single.unionByName(least).unionByName(rest)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))

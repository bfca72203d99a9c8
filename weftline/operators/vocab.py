"""Word counts, character coverage, vocabulary, comparison of vocabularies."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (
    CHARACTER_COVERAGE,
    DEFAULT_VOCAB_SIZE,
    FIRST_PIECE_ID,
    SPECIAL_TOKENS,
)
from ..functions.text import slices, word_pieces, words

#: Bytes of text whose words a task counts at a time; distinct pieces that it holds at least before it hands them on.
SLICE_BYTES, HELD = 1 << 22, 1 << 18


def training_text(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Texts within a trainer's length limit, all without one."""
    return df if max_bytes is None else df.where(F.octet_length("text") <= max_bytes)


def _count_words(names: list[str]):
    """Counts of pieces by the key columns ``names`` and a text column last: words are counted, distinct ones cut into pieces."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: dict[tuple, list[int]] = {}
            if names:
                for k, key in enumerate(zip(*[c.to_pylist() for c in part.columns[:-1]], strict=True)):
                    rows.setdefault(key, []).append(k)
            for own in [part.take(pa.array(k, pa.int64())) for k in rows.values()] or [part]:
                texts = own.column(len(names))
                for token, freq in _summed(count_pieces(words(texts.slice(start, length)).flatten()) for start, length in slices(texts, SLICE_BYTES)):
                    first = pa.array(np.zeros(len(token), np.int64))
                    yield pa.RecordBatch.from_arrays([*[c.take(first) for c in own.columns[:-1]], token, freq], [*names, "token", "freq"])

    return count


def _summed(counts: Iterable[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Pieces and counts of several slices, added up until there are HELD of them."""
    held: pa.Table | None = None
    for token, freq in counts:
        own = pa.table({"token": token, "freq": freq})
        held = (own if held is None else pa.concat_tables([held, own])).group_by("token", use_threads=False).aggregate([("freq", "sum")]).rename_columns(["token", "freq"])
        if len(held) >= HELD:
            yield tuple(c.combine_chunks() for c in held.columns)
            held = None
    if held is not None:
        yield tuple(c.combine_chunks() for c in held.columns)


def count_pieces(found: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Pieces of words and their counts; a piece that several distinct words hold comes as often as they do."""
    counts = pc.value_counts(found)
    lists = word_pieces(counts.field("values"))
    return lists.flatten(), counts.field("counts").take(pc.list_parent_indices(lists))


def word_freq(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pieces and their counts; counting combines in the tasks, so frequent pieces are not hot."""
    keys = keys or []
    # a JVM string may hold broken UTF-8, Python's may not
    ready = df.select(*keys, F.make_valid_utf8(F.col("text")).alias("text"))
    schema = T.StructType([*[ready.schema[k] for k in keys], T.StructField("token", T.StringType()), T.StructField("freq", T.LongType())])
    return ready.mapInArrow(_count_words(keys), schema).groupBy(*keys, "token").agg(F.sum("freq").alias("freq"))


def char_freq(df: DataFrame) -> DataFrame:
    """Counts of characters, from words and their counts."""
    return (
        df.select(F.explode(F.split("token", "")).alias("char"), "freq")
        .where(F.col("char") != "")
        .groupBy("char")
        .agg(F.sum("freq").alias("freq"))
    )


def char_coverage(chars: DataFrame, coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """The most frequent characters that together reach the coverage.

    The running sum is over distinct characters, at most 1,114,112 rows.
    """
    order = Window.orderBy(F.desc("freq"), "char").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("freq").over(order), F.lit(0))
    total = chars.agg(F.sum("freq").alias("n")).scalar()
    return chars.withColumn("before", before).where(F.col("before") < F.lit(coverage) * total)


def build_vocab(freq: DataFrame, size: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """The most frequent pieces, numbered after the special and byte tokens. ``size`` counts all of them."""
    top = freq.orderBy(F.desc("freq"), "token").limit(max(size - FIRST_PIECE_ID, 0))
    order = Window.orderBy(F.desc("freq"), "token")  # at most ``size`` rows
    return top.select("token", (F.row_number().over(order) + FIRST_PIECE_ID - 1).alias("id"), "freq")


def with_specials(vocab: DataFrame, specials: dict[str, int] = SPECIAL_TOKENS) -> DataFrame:
    """(token, id) of a vocabulary and its special tokens."""
    rows = F.explode(F.array(*[F.struct(F.lit(token).alias("token"), F.lit(ident).cast(vocab.schema["id"].dataType).alias("id")) for token, ident in specials.items()]))
    own = vocab.sparkSession.range(1).select(rows.alias("r")).select("r.token", "r.id")
    return vocab.select("token", "id").unionByName(own)


def vocab_diff(left: DataFrame, right: DataFrame, specials: list[str] = list(SPECIAL_TOKENS)) -> DataFrame:
    """Sizes, shared tokens, symmetric difference and id agreement of two vocabularies (token, id).

    ``special_equal``: every special token has the same id in both, or is in neither.
    """
    both = left.select("token", F.col("id").alias("a")).join(right.select("token", F.col("id").alias("b")), "token", "full")
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    same = in_a & in_b & (F.col("a") == F.col("b"))
    return both.agg(
        F.count("a").alias("left_size"),
        F.count("b").alias("right_size"),
        F.count_if(in_a & in_b).alias("shared"),
        F.count_if(in_a != in_b).alias("only_one"),
        F.count_if(same).alias("same_id"),
        (F.count_if(same) == F.count(F.lit(1))).alias("equal"),
        (F.count_if(F.col("token").isin(specials) & ~same) == 0).alias("special_equal"),
    )


def table_names(clip: int | None = None) -> dict[str, str]:
    """Names of the tables of a tokenised set: tokens and their index, of training, validation and clipped validation texts."""
    sets = {"train": "train", "dev": "val"} | ({"val_clipped": f"val-clipped-{clip}"} if clip is not None else {})
    kinds = {"data": "tokens", "index": "offsets"}
    return {f"{name}_{kind}_file": f"{stem}.{suffix}.parquet" for name, stem in sets.items() for kind, suffix in kinds.items()}


def manifest(vocab: DataFrame, tokenizer: str, prepend_bos: bool, append_eos: bool, bos_id: int, eos_id: int, clip: int | None = None) -> DataFrame:
    """One row of facts about a tokenised set; the vocabulary itself stays a table in id order. ``clip``: length of the clipped validation texts."""
    return vocab.agg(
        *[F.lit(file).alias(name) for name, file in table_names(clip).items()],
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(prepend_bos).alias("prepend_bos"),
        F.lit(append_eos).alias("append_eos"),
        F.lit(bos_id).alias("bos_token_id"),
        F.lit(eos_id).alias("eos_token_id"),
        (F.count(F.lit(1)) + FIRST_PIECE_ID).alias("vocab_size"),
        F.when(F.count(F.lit(1)) + FIRST_PIECE_ID <= 65536, "uint16").otherwise("uint32").alias("data_dtype"),
        F.lit("uint64").alias("doc_offset_dtype"),
    )

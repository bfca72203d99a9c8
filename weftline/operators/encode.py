"""Text to token ids without a shuffle.

A vocabulary is bounded by its size, so it travels to the tasks once. A batch is taken in slices
of about SLICE_BYTES, so that a task's memory does not follow the batch. Each slice is
dictionary-encoded: every distinct word of it is cut into pieces and looked up once, and the ids
are put back in place by index. The corpus is never exploded into one row per piece and never
joined on pieces, where a frequent piece would be a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import int_array
from ..functions.constants import BOS_ID, EOS_ID, FIRST_BYTE_ID
from ..functions.text import clip_words, pieces, slices, word_pieces, words

#: Bytes of text that a task encodes at a time; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21


def byte_ids(piece: str) -> list[int]:
    return [FIRST_BYTE_ID + b for b in piece.encode("utf-8")]


class _VocabEncoder:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, found: list[str]) -> list[list[int]]:
        return self.arrow(pa.array(found, pa.string())).to_pylist()

    def arrow(self, found: pa.Array) -> pa.ListArray:
        """One id for a known piece, those of its bytes for any other: both kinds as lists, put in place by index."""
        tokens, ids = self.shared.value
        at = pc.index_in(found, tokens)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        single = pa.ListArray.from_arrays(pa.array(np.arange(known.sum() + 1), pa.int32()), ids.take(at.drop_null()))
        rest = found.filter(pa.array(~known))
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(rest).to_numpy(zero_copy_only=False))))
        # a filtered array has buffers of its own, from their start
        spelt = np.frombuffer(rest.buffers()[2] or b"", np.uint8, ends[-1]).astype(np.int32) + FIRST_BYTE_ID
        several = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(spelt, pa.int32()))
        place = np.where(known, np.cumsum(known) - 1, known.sum() + np.cumsum(~known) - 1)
        return pa.concat_arrays([single, several]).take(pa.array(place, pa.int64()))


def vocab_encoder(vocab: DataFrame, most: int = 1 << 21) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of distinct pieces: the id of the piece, else the ids of its bytes.

    The vocabulary is sent to every task; one of more than ``most`` entries is refused.
    """
    rows = vocab.select("token", "id").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a vocabulary may have {most} entries at most")
    entries = dict(zip(rows["token"].tolist(), rows["id"].tolist()))
    return _VocabEncoder(vocab.sparkSession.sparkContext.broadcast((pa.array([*entries], pa.string()), pa.array([*entries.values()], pa.int32()))))


def merge_encoder(df: DataFrame, merges: list[tuple[str, str]], vocab: dict[str, int]) -> Callable[[list[str]], list[list[int]]]:
    """Encoder by ranked merges: the best-ranked adjacent pair is joined until none is left."""
    shared = df.sparkSession.sparkContext.broadcast(({pair: i for i, pair in enumerate(merges)}, vocab))

    def one(piece: str) -> list[int]:
        ranks, ids = shared.value
        parts = list(piece)
        while len(parts) > 1:
            known = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
            if not known:
                break
            best = min(known)[0]
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == best:
                    joined.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return [t for p in parts for t in ([ids[p]] if p in ids else byte_ids(p))]

    return lambda found: [one(p) for p in found]


def _encode_lists(column: pa.Array, encoder) -> pa.Array:
    coded = column.flatten().dictionary_encode()
    known = pa.array(encoder(coded.dictionary.to_pylist()), pa.list_(pa.int32()))
    flat = known.take(coded.indices)
    # lists of a sliced batch do not start at 0, flatten() does
    starts = pa.compute.subtract(column.offsets, column.offsets[0])
    return pa.ListArray.from_arrays(flat.offsets.take(starts).cast(pa.int32()), flat.values)


def _encode_texts(texts: pa.Array, encoder) -> pa.Array:
    found = words(texts)
    coded = found.flatten().dictionary_encode()
    own = word_pieces(coded.dictionary)
    ids = encoder.arrow(own.flatten()) if hasattr(encoder, "arrow") else pa.array(encoder(own.flatten().to_pylist()), pa.list_(pa.int32()))
    # a word's ids are those of its pieces
    known = pa.ListArray.from_arrays(ids.offsets.take(own.offsets).cast(pa.int32()), ids.values)
    flat = known.take(coded.indices)
    return pa.ListArray.from_arrays(flat.offsets.take(found.offsets).cast(pa.int32()), flat.values)


def encode_texts(df: DataFrame, column: str, encoder: Callable[[list[str]], list[list[int]]], output: str = "ids") -> DataFrame:
    """Replace a text column by the ids of its pieces, slice by slice inside each partition; a null text has none."""
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in slices(batch.column(len(kept)), SLICE_BYTES):
                part = batch.slice(start, length)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _encode_texts(part.column(len(kept)), encoder)], [*kept, output])

    # a JVM string may hold broken UTF-8, Python's may not
    return df.select(*kept, F.make_valid_utf8(F.col(column)).alias(column)).mapInArrow(run, schema)


def encode_pieces(df: DataFrame, column: str, encoder: Callable[[list[str]], list[list[int]]], output: str = "ids") -> DataFrame:
    """Replace an array<string> column by its ids, batch by batch inside each partition."""
    kept = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            if isinstance(lists, pa.LargeListArray):
                lists = lists.cast(pa.list_(pa.string()))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, _encode_lists(lists, encoder)], [*kept, output])

    return df.select(*kept, column).mapInArrow(run, schema)


def encode_corpus(
    df: DataFrame,
    encoder: Callable[[list[str]], list[list[int]]],
    prepend_bos: bool = False,
    append_eos: bool = False,
    clip: int | None = None,
) -> DataFrame:
    """Documents with ``text`` to ``ids`` and ``len``: no padding, no truncation, marks on request.

    A clipped set takes the first ``clip`` words and ignores the mark flags.
    """
    others = [c for c in df.columns if c != "text"]
    ready = df.select(*others, clip_words(F.col("text"), clip).alias("_text"))
    out = encode_texts(ready, "_text", encoder)
    if clip is None and (prepend_bos or append_eos):
        parts = [int_array(BOS_ID)] * prepend_bos + [F.col("ids")] + [int_array(EOS_ID)] * append_eos
        out = out.withColumn("ids", F.concat(*parts))
    return out.withColumn("len", F.size("ids"))


def encode_external(df: DataFrame, encode_batch: Callable[[list[str]], list[list[int]]], text: str = "text") -> DataFrame:
    """Adapter for any text encoder: takes a list of texts, gives a list of id lists."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(encode_batch(texts), pa.list_(pa.int32()))], [*kept, "ids"])

    return df.select(*kept, text).mapInArrow(run, schema).withColumn("len", F.size("ids"))


def token_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One line of space-joined token strings per document."""
    return df.withColumn("line", F.array_join(pieces(F.col(text)), " ")).drop(text)

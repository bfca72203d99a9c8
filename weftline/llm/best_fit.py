"""Vector best-fit packing: each document goes into the sequence that its size vector fits best, under every capacity.

A document's vector is (tokens, 1 document, tokens squared: its attention cost). A sequence keeps residual capacities in
the same three dimensions. Documents come in decreasing order of tokens; of all open sequences with room in every
dimension, ``rule`` picks one: ``norm`` leaves the smallest weighted residual, ``dot`` has the largest weighted product of
residual and vector. Shards of a bounded number of documents pack on their own; sequences that they leave with room are
taken apart and packed again in fewer shards, until one shard holds what is left. A shard hands on at most half of its
documents, those of its emptiest sequences, so that every round halves what is left.

A document of no tokens needs a place like any other. A document larger than a capacity raises an error. A null text is an
empty one. Rows that repeat are packed each; a null id stays null, and ids beside it stay exact (batches are Arrow, not floats).
An empty table gives no pieces. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import batches, only, partitions_for
from weftline.llm.tokens import encoder
from weftline.session import written

#: Documents that one shard packs, and the share of a sequence below which its documents are packed again.
SHARD, FULL = 20_000, 0.995

_PIECE = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "id long, piece int, start long, length long, ids_crc32 long"


def best_fit(tokens: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> np.ndarray:
    """The sequence number of each document."""
    caps = np.array(capacities, float)
    scale = np.array(weights, float) / caps**2
    sizes = np.stack([tokens, np.ones(len(tokens)), tokens.astype(float) ** 2])
    if len(tokens) and (sizes.max(axis=1) > caps).any():
        raise ValueError("a document exceeds a capacity of an empty sequence")
    order = np.argsort(-tokens, kind="stable")
    out = np.empty(len(tokens), np.int64)
    room = np.empty((3, 1024))
    name = np.empty(1024, np.int64)
    n = made = 0
    least = tokens.min() if len(tokens) else 0
    for step, i in enumerate(order.tolist()):
        v = sizes[:, i]
        r = room[:, :n]
        fits = np.flatnonzero((r[0] >= v[0]) & (r[1] >= 1) & (r[2] >= v[2]))
        if len(fits):
            f = r[:, fits]
            score = scale @ (f - v[:, None]) ** 2 if rule == "norm" else -((scale * v) @ f)
            k = fits[np.argmin(score)]
        else:
            if n == room.shape[1]:
                room = np.concatenate([room, np.empty_like(room)], axis=1)
                name = np.concatenate([name, np.empty_like(name)])
            k = n
            room[:, k], name[k] = caps, made
            n, made = n + 1, made + 1
        room[:, k] -= v
        out[i] = name[k]
        if room[0, k] < least or room[1, k] < 1:  # nothing more can go in
            n -= 1
            room[:, k], name[k] = room[:, n], name[n]
        elif step % 4096 == 4095 and n:
            open_ = room[0, :n] >= least
            m = int(open_.sum())
            room[:, :m], name[:m] = room[:, :n][:, open_], name[:n][open_]
            n = m
    return out


def _placer(tokens_col: str, columns: list[str], capacities, weights, rule: str, level: int, last: bool):
    def place(items: pa.Table) -> pa.Table:
        shard = items.column("__shard")[0].as_py()
        keys = [tokens_col, *[c for c in columns if c != tokens_col]]
        items = items.select(columns)
        items = items.take(pc.sort_indices(items, sort_keys=[(c, "descending") for c in keys], null_placement="at_end"))
        tokens = items.column(tokens_col).to_numpy().astype(np.int64)
        sequence = best_fit(tokens, capacities, weights, rule)
        together = np.argsort(sequence, kind="stable")
        before = np.cumsum(tokens[together]) - tokens[together]
        first = np.flatnonzero(np.diff(sequence[together], prepend=-1))
        offset = np.empty(len(tokens), np.int64)
        offset[together] = before - np.repeat(before[first], np.diff(first, append=len(tokens)))
        used, size = np.zeros(len(first), np.int64), np.bincount(sequence)
        np.add.at(used, sequence, tokens)
        open_ = np.flatnonzero(used < FULL * capacities[0])
        open_ = open_[np.argsort(used[open_], kind="stable")]
        again = open_[np.cumsum(size[open_]) <= len(tokens) // 2]
        number = (level << 56) + (shard << 24) + sequence
        full = np.full(len(tokens), True) if last else ~np.isin(sequence, again)
        return items.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("full", pa.array(full))

    return place


def pack(items: DataFrame, tokens_col: str, capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """The items with sequence_id (any numbers) and offset (tokens before it in its sequence)."""
    spark = items.sparkSession
    columns = items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("full", T.BooleanType())])
    done, rest, level = [], written(items, "pack-items"), 0
    while True:
        shards = partitions_for(rest.count(), shard)
        last = shards == 1

        keyed = rest.withColumn("__shard", F.pmod(F.xxhash64(*columns, F.lit(level)), F.lit(shards)))
        packed = written(keyed.groupBy("__shard").applyInArrow(_placer(tokens_col, columns, capacities, weights, rule, level, last), schema), "packed")
        done.append(packed.filter("full").drop("full"))
        if last:
            break
        rest, level = packed.filter("not full").select(*columns), level + 1
        if rest.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pieces(tokenizer: str, end_id: int, most: int):
    end = end_id.to_bytes(4, "little")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaces=False).encode
        for part in parts:
            out: dict[str, list] = {n: [] for n in _PIECE.names}
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode(text or "") + end
                for piece, start in enumerate(range(0, len(ids), 4 * most)):
                    own = ids[start : start + 4 * most]
                    for key, value in zip(_PIECE.names, (doc, piece, start // 4, len(own) // 4, zlib.crc32(own))):
                        out[key].append(value)
            yield from batches(out, _PIECE)

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: each text's ids and the end id, cut every ``most`` ids."""
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, most), _PIECE_DDL)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, max_docs: int | None = None, max_cost: float | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Cut, then pack: id, piece, start, length, ids_crc32, sequence_id, offset. Without other limits, only tokens bind."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col)
    packed = pack(pieces, "length", (capacity, max_docs or capacity, max_cost or float(capacity) ** 2), **how)
    return packed.withColumnRenamed("id", id_col)

"""Repeated lines: range-partitioned line hashes, sorted by document and position, give a keep bitmap for each document.

A line's key is the line with white space stripped at both ends and A-Z lower-cased, hashed to 128 bits. Lines go to range
partitions of (hash, document) and are sorted there with the largest document first, so that the first document of a run
is the one whose lines stay. One pass streams over each partition and holds the lines of less than ``min_docs`` documents
of the open run. A hash with many lines spans several partitions: the first and last run of each partition are left open,
and their counts (at most two rows per partition) settle them. What comes back is a compressed bitmap for each document
with dropped lines; texts do not take part in the sort.

A null text is one empty line. A null id counts as a document smaller than all others. Rows that share an id count as one
document, and each has a bitmap of its own by the hash of its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACE, batches, only
from weftline.session import written

_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])
_MARK = pa.schema([("kind", pa.int32()), *_LINE, ("docs", pa.int64())])
_LINE_DDL = "h1 long, h2 long, doc long, text_hash long, pos int"
#: Kinds of marks: a line to drop, a line of an open run, the summary of an open run.
DROP, OPEN, SUMMARY = 0, 1, 2
NO_ID = -(1 << 63)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def line_keys(min_chars: int):
    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in parts:
            out: dict[str, list] = {n: [] for n in _LINE.names}
            raw = bytearray()
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text or len(text) < min_chars:
                    continue
                before = len(out["pos"])
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(SPACE)) >= min_chars:
                        raw += digest(line.encode().lower())
                        out["pos"].append(pos)
                n = len(out["pos"]) - before
                if n:
                    out["doc"] += [NO_ID if doc is None else doc] * n
                    out["text_hash"] += [text_hash(text)] * n
            both = np.frombuffer(bytes(raw), "<i8").reshape(-1, 2)
            out["h1"], out["h2"] = both[:, 0], both[:, 1]
            if len(out["pos"]):
                yield from batches(out, _LINE)

    return keys


class _Run:
    """The run of lines of one hash that is still open."""

    def __init__(self, key: tuple[int, int], doc: int, first: bool):
        self.key, self.first_doc, self.last_doc, self.docs, self.first = key, doc, doc, 1, first
        self.waiting: list[np.ndarray] = []

    def add(self, rows: np.ndarray, min_docs: int) -> Iterator[tuple[int, np.ndarray]]:
        self.docs += int(np.count_nonzero(np.diff(rows["doc"], prepend=self.last_doc)))
        self.last_doc = int(rows["doc"][-1])
        if self.first:
            yield OPEN, rows
            return
        self.waiting.append(rows[rows["doc"] != self.first_doc])
        if self.docs >= min_docs:
            yield from ((DROP, r) for r in self.waiting)
            self.waiting = []


def _marks(min_docs: int):
    kinds = np.dtype([(f.name, f.type.to_pandas_dtype()) for f in _LINE])

    def batch(kind: int, rows: np.ndarray, docs: int = 0) -> pa.RecordBatch:
        n = len(rows)
        columns = [np.full(n, kind, np.int32), *(np.ascontiguousarray(rows[f]) for f in _LINE.names), np.full(n, docs, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_MARK)

    def summary(run: _Run) -> pa.RecordBatch:
        return batch(SUMMARY, np.array([(*run.key, run.first_doc, 0, 0)], kinds), run.docs)

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, many = None, False
        for part in parts:
            if not part.num_rows:
                continue
            rows = np.empty(part.num_rows, kinds)
            for f in _LINE.names:
                rows[f] = part.column(f).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(rows["h1"]) != 0) | (np.diff(rows["h2"]) != 0)) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(rows)]))
            key = lambda i: (int(rows["h1"][i]), int(rows["h2"][i]))
            if run is None:
                run = _Run(key(0), int(rows["doc"][0]), True)
            if key(0) == run.key:
                yield from (batch(k, r) for k, r in run.add(rows[: ends[0]], min_docs) if len(r))
                starts, ends = starts[1:], ends[1:]
            if not len(starts):
                continue
            if run.first:
                yield summary(run)
            many = True
            # All but the last run of this batch end in it.
            a, b = starts[0], starts[-1]
            if b > a:
                inner = rows[a:b]
                at = starts[:-1] - a
                changes = np.concatenate(([0], np.diff(inner["doc"]) != 0)).astype(np.int64)
                changes[at] = 1
                length = np.diff(np.append(at, b - a))
                docs = np.repeat(np.add.reduceat(changes, at), length)
                largest = np.repeat(inner["doc"][at], length)
                drop = inner[(docs >= min_docs) & (inner["doc"] != largest)]
                if len(drop):
                    yield batch(DROP, drop)
            run = _Run(key(b), int(rows["doc"][b]), False)
            yield from (batch(k, r) for k, r in run.add(rows[b:], min_docs) if len(r))
        if run is not None:
            yield from (batch(OPEN, r) for r in run.waiting if len(r))
            if many or run.first:
                yield summary(run)

    return stream


def _bitmaps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep flags up to the last dropped line, packed and compressed; lines beyond them stay."""
    for part in parts:
        packed = []
        for positions in part.column(2).to_pylist():
            flags = np.ones(max(positions) + 1, np.uint8)
            flags[positions] = 0
            packed.append(zlib.compress(np.packbits(flags).tobytes() + len(flags).to_bytes(4, "little"), 1))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc", "text_hash", "keep_bitmap"])


def keep_flags(bitmap: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    size = int.from_bytes(raw[-4:], "little")
    flags = np.ones(n, bool)
    flags[:size] = np.unpackbits(np.frombuffer(raw[:-4], np.uint8), count=size).astype(bool)
    return flags


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc, text_hash, keep_bitmap of the documents that lose lines: each key in at least ``min_docs`` documents stays in the largest only."""
    lines = only(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(line_keys(min_chars), _LINE_DDL)
    ranged = lines.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
    marks = written(ranged.mapInArrow(_marks(min_docs), f"kind int, {_LINE_DDL}, docs long"), "line-marks")
    # At most two summaries per partition.
    settled = marks.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("largest"))
    opened = marks.filter(F.col("kind") == OPEN).join(F.broadcast(settled.filter(F.col("all_docs") >= min_docs)), ["h1", "h2"]).filter("doc < largest")
    dropped = marks.filter(F.col("kind") == DROP).select("doc", "text_hash", "pos").unionByName(opened.select("doc", "text_hash", "pos"))
    return dropped.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("positions")).mapInArrow(_bitmaps, "doc long, text_hash long, keep_bitmap binary")


def _hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        hashes = [text_hash(t or "") for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.int64())], ["id", "text", "text_hash"])


def _apply(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n_lines, n_dropped, digests = [], [], []
        for text, bitmap in zip(part.column("text").to_pylist(), part.column("keep_bitmap").to_pylist()):
            text = text or ""
            n = text.count("\n") + 1
            dropped = 0
            if bitmap is not None:
                keep = keep_flags(bitmap, n)
                dropped = n - int(keep.sum())
                text = "\n".join([line for line, k in zip(text.split("\n"), keep.tolist()) if k])
            n_lines.append(n)
            n_dropped.append(dropped)
            digests.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests), part.column("keep_bitmap")],
            ["id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap"],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: the id, n_lines before, n_dropped, kept_sha256 of what stays, keep_bitmap (null: all stay)."""
    maps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_hashes, "id long, text string, text_hash long").withColumn("doc", F.coalesce("id", F.lit(NO_ID)))
    out = rows.join(maps, ["doc", "text_hash"], "left").select("id", "text", "keep_bitmap").mapInArrow(_apply, "id long, n_lines long, n_dropped long, kept_sha256 string, keep_bitmap binary")
    return out.withColumnRenamed("id", id_col)

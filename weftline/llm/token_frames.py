"""Token files of independent zstandard frames with a trailing seek table (the public seekable format).

Documents are range-partitioned and sorted by id; each task encodes its texts and streams one file. A frame holds whole
documents up to ``frame_ids`` ids, or one longer document, ends with zstandard's own checksum, and has its sizes and a
second checksum in the seek table behind the last frame. The index has one row per document: file, frame, place in the
frame. A reader takes index rows, in any selection, and decompresses only their frames.

A null text is empty: it has the end id alone. Null ids come first; rows that share an id follow each other by their text.
Files take the task attempt's name and only those named by the written index exist for a reader, so a task that runs again
leaves nothing wrong behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batches, file_system, only, write_file
from weftline.llm.tokens import encoder
from weftline.session import fresh_folder, written

#: Fixed values of the seekable format: magic numbers and the descriptor that announces checksums.
SKIPPABLE, FOOTER, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

_INDEX = pa.schema([("part", pa.int32()), ("file", pa.string()), ("id", pa.int64()), ("frame", pa.int32()), ("place", pa.int64()), ("start_in_file", pa.int64()), ("n_tokens", pa.int64())])
_INDEX_DDL = "part int, file string, id long, frame int, place long, start_in_file long, n_tokens long"


def checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), CHECKSUMS, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source) -> list[tuple[int, int, int, int]]:
    """Offset, compressed size, size and checksum of each frame, from the end of an open file."""
    size = source.size()
    count, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
    if magic != FOOTER or not descriptor & CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the file")
    raw = source.read_at(12 * count, size - 9 - 12 * count)
    out, offset = [], 0
    for packed, plain, check in struct.iter_unpack("<III", raw):
        out.append((offset, packed, plain, check))
        offset += packed
    return out


def _writer(folder: str, tokenizer: str, end_id: int, frame_ids: int, level: int):
    end = end_id.to_bytes(4, "little")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:05d}-{uuid.uuid4().hex}.zst"
        encode = encoder(tokenizer, spaces=True).encode
        pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        rows: dict[str, list] = {n: [] for n in _INDEX.names}

        def chunks() -> Iterator[bytes]:
            table: list[tuple[int, int, int]] = []
            frame: list[bytes] = []
            held = start = 0

            def close() -> bytes:
                plain = b"".join(frame)
                packed = pack.compress(plain)
                table.append((len(packed), len(plain), checksum(plain)))
                frame.clear()
                return packed

            for batch in parts:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    if held and held + n > frame_ids:
                        yield close()
                        held = 0
                    for key, value in zip(_INDEX.names, (part, name, doc, len(table), held, start, n)):
                        rows[key].append(value)
                    frame.append(ids)
                    held += n
                    start += n
            if frame:
                yield close()
            yield seek_table(table)

        first = next(parts, None)
        if first is None:
            return
        rest, parts = parts, None

        def again():
            yield first
            yield from rest

        parts = again()
        write_file(folder, name, chunks())
        yield from batches(rows, _INDEX)

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 18, level: int = 3) -> DataFrame:
    """Write the files and their index; the index, with ``start`` (ids of all documents before) in order of the files."""
    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    index = written(ordered.mapInArrow(_writer(folder, tokenizer, end_id, frame_ids, level), _INDEX_DDL), "token-index")
    # One row per file.
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = files.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_file")).drop("before")


def _reader(folder: str):
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        unpack = zstandard.ZstdDecompressor()
        name = source = table = plain = None
        at = -1
        for part in parts:
            crcs, out = [], []
            for file, frame, place, n in zip(*(part.column(c).to_pylist() for c in ("file", "frame", "place", "n_tokens"))):
                if file != name:
                    source = system.open_input_file(f"{root}/{file}")
                    name, table, at = file, read_seek_table(source), -1
                if frame != at:
                    offset, packed, size, check = table[frame]
                    plain, at = unpack.decompress(source.read_at(packed, offset)), frame
                    if len(plain) != size or checksum(plain) != check:
                        raise ValueError(f"frame {frame} of {file} is damaged")
                ids = plain[4 * place : 4 * (place + n)]
                crcs.append(zlib.crc32(ids))
                out.append(np.frombuffer(ids, "<u4").astype(np.int32))
            offsets = np.zeros(len(out) + 1, np.int32)
            np.cumsum([len(x) for x in out], out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("start"), pa.array([len(x) for x in out], pa.int64()), pa.array(crcs, pa.int64()), lists],
                ["id", "start", "n_tokens", "ids_crc32", "ids"],
            )

    return read


def read_tokens(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """The documents of these index rows from the files: id, start, n_tokens, ids_crc32, ids.

    Rows of a written index lie in file order, so a task opens a file and a frame once; other orders only read more.
    """
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    read = _reader(folder)
    if ids:
        return index.mapInArrow(read, schema)

    def slim(parts):
        for part in read(parts):
            yield part.select(["id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(slim, "id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark) -> str:
    return fresh_folder(spark, "token-files")

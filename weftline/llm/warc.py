"""Web archives with an index first: write records and their places, then read any selection in coalesced byte ranges.

Each task writes one archive of independently compressed records and one index row per record: file, offset, length, URL
and digest. Of records with equal payloads of at least ``min_payload`` bytes the one with the smallest id is a response,
the others are revisits without a payload. A reader sorts the wanted index rows by file and offset and merges neighbours
into single reads.

A null payload is empty, a null URL is ``about:blank``; control characters, spaces and non-ASCII in URLs are
percent-encoded. Rows that repeat the smallest id of their payload are all responses. A null id never is the smallest.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batches, file_system, only, partitions_for, write_file
from weftline.session import written

#: Fixed values of the archive format.
VERSION, SAME_PAYLOAD = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("id", pa.int64())])
_INDEX_DDL = "file string, offset long, length long, url string, digest string, record_type string, id long"
_RECORD = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_DDL = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def name_of(id_: int | None) -> str:
    return f"<urn:x-page:{'none' if id_ is None else id_}>"


def id_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed: headers, HTTP headers and, in a response, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": name_of(id_),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": name_of(refers_to)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "id": id_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": id_of(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


def _writer(folder: str, date: str):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        rows: dict[str, list] = {n: [] for n in _INDEX.names}

        def chunks() -> Iterator[bytes]:
            offset = 0
            for part in parts:
                for id_, url, text, digest, refers_to, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    packed = gzip.compress(record(id_, url, (text or "").encode(), digest, refers_to, revisit, date), 6, mtime=0)
                    for key, value in zip(_INDEX.names, (name, offset, len(packed), url, digest, "revisit" if revisit else "response", id_)):
                        rows[key].append(value)
                    offset += len(packed)
                    yield packed

        write_file(folder, name, chunks())
        yield from batches(rows, _INDEX)

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives into the folder and return their index."""
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    rows = (
        only(pages, id_col, url_col, payload_col)
        .toDF("id", "url", "payload")
        .select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("payload").cast("string").alias("payload"))
        .withColumn("digest", F.sha2(payload, 256))
    )
    slim = written(rows.filter(F.octet_length("payload") >= min_payload).select("id", "digest"), "page-digests")
    firsts = slim.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    again = slim.join(firsts, "digest").filter("not (id <=> refers_to)").select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct()
    joined = rows.join(again, rows.id.eqNullSafe(again.rid) & (rows.digest == again.rdigest), "left")
    marked = joined.select("id", "url", "payload", "digest", "refers_to", F.col("rdigest").isNotNull().alias("revisit"))
    return written(marked.mapInArrow(_writer(folder, date), _INDEX_DDL), "page-index")


def _reader(folder: str, gap: int, most: int, payloads: bool):
    def ranges(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        file, start, end, places = None, 0, 0, []
        for part in parts:
            for f, o, n in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if f != file or o > end + gap or o + n - start > most:
                    if places:
                        yield file, start, end, places
                    file, start, end, places = f, o, o, []
                places.append((o, n))
                end = max(end, o + n)
        if places:
            yield file, start, end, places

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name = source = None
        for file, start, end, places in ranges(parts):
            if file != name:
                name, source = file, system.open_input_file(f"{root}/{file}")
            data = memoryview(source.read_at(end - start, start))
            found = [parse(gzip.decompress(data[o - start : o - start + n])) for o, n in places]
            if not payloads:
                found = [f | {"payload": None} for f in found]
            yield from batches({n: [f[n] for f in found] for n in _RECORD.names}, _RECORD, 1024)

    return read


def read_records(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of these index rows, read in order of their places; neighbours at most ``gap`` bytes apart share a read.

    An index row is small and stands for a whole record, so tasks are counted by the bytes to read.
    """
    tasks = partitions_for(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], 2 * most)
    places = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(_reader(folder, gap, most, payloads), _RECORD_DDL)

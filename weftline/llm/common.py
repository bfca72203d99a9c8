"""Helpers that the operators share: raw text of Arrow batches, word hashes, shared-folder files, caches of a worker."""

from __future__ import annotations

import builtins
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The white space of the contracts, U+0009 to U+000D and U+0020.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: Text bytes that one vectorised step takes at a time; a longer document makes a step of its own.
STEP_BYTES = 1 << 18

_MASK = (1 << 64) - 1


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker; functions travel by value, so their modules cannot hold it."""
    return builtins.__dict__.setdefault("_weftline_worker", {}).setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK)) | np.uint64(1)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most so many bytes together, or of one document."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    cache = worker_cache("powers")
    if len(cache.get("up", ())) < n:
        base = 0x9E3779B97F4A7C15 | 1
        size = max(n, STEP_BYTES + 1024)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            cache[name] = np.multiply.accumulate(out)
    return cache["up"], cache["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) in order, and the number of words of each text."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    up, down = _powers(len(buffer) + 1)
    letters = lower[buffer]
    gap = space[letters]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(constants(1, 256)[letters] * up[: len(buffer)], out=sums[1:])
    before = np.concatenate(([True], gap[:-1]))
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(gap & ~before)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct word shingles; fewer words than ``size`` make one shingle, none make none."""
    weights = constants(2, size + 1)
    for a, b in steps(texts):
        words, counts = word_hashes(texts[a:b])
        full = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for j in range(size):
            full += words[j : j + len(full)] * weights[j]
        full = mix(full)
        at = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(full[at : at + n - size + 1])
            elif n:
                yield mix((words[at : at + n] * weights[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(weights[size]) * n & _MASK))
            else:
                yield np.empty(0, np.uint64)
            at += n


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = signed(np.concatenate(parts)) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def batches(columns: dict[str, list], types: pa.Schema, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][i : i + rows], f.type) for f in types], schema=types)


def file_system(folder: str):
    """The file system of a shared folder, by its URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write under another name, then move: a task that is lost half way leaves no file of that name."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/.{name}", compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(f"{root}/.{name}", f"{root}/{name}")


def partitions_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone: whatever else a table holds cannot clash with an operator's own names."""
    return df.select(*names)

"""Sampled segmentations: forward filtering and backward sampling over the lattice of vocabulary pieces.

A text's lattice has its characters' positions as nodes and every piece that matches between two positions as an edge, with
byte edges for characters that no piece covers. An edge weighs ``theta * log(rank + 2)`` by the piece's merge rank, less is
likelier; byte edges weigh like the last rank for each byte. Forward sums give each node the mass of all its
segmentations; from the end back, an edge is drawn in proportion to the mass through it. The draws come from a hash of the
row key, the place in the text and the step, so a row's segmentation depends on nothing else.

No piece goes on from a non-space character to a space, or from a word character to one of ``CUTS``; between them every
segmentation has a border, so the lattice falls into independent parts and each distinct part is filtered once per worker.
Decoding joins the pieces' bytes and drops the one space put before the text: it gives back every text, with the space mark
itself (U+2581) going through bytes. A null text is empty and has no pieces; rows with equal key and text agree.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import constants, mix, only, worker_cache

MARK, CUTS = "▁", ".,;:!?\n"
#: Edges and parts that a worker keeps; parts beyond them are filtered again each time.
KEPT_EDGES, KEPT_PARTS = 5_000_000, 300_000
#: Parts of texts sampled in one vectorised step.
STEP_PARTS = 1 << 18
_PARTS = re.compile(rf" *[^ {re.escape(CUTS)}]+| *[{re.escape(CUTS)}]+[^ {re.escape(CUTS)}]*| +")


class Lattice:
    """The vocabulary, and the filtered lattices of the parts seen so far, as arrays over edges.

    Node k's incoming edges lie from ``head[k]`` on and hold the values k + (cumulated share of the mass); the drawn one is
    the first above k + u.
    """

    def __init__(self, path: str, theta: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = {}
        self.weight: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.weight[text] = (i, -theta * math.log(rank + 2))
                self.bytes_of[i] = text.encode()
                rank += 1
        self.byte_weight = -theta * math.log(rank + 2)
        self.tables = self._tables()
        bad = [p for p in self.weight if " " in p.lstrip(" ") or any(a not in " " + CUTS and b in CUTS and a.isalnum() and a.isascii() for a, b in zip(p, p[1:]))]
        if bad:
            raise ValueError(f"pieces cross the borders of parts: {bad[:5]}")
        self.crossing = {p[k : k + 2] for p in self.weight for k in range(len(p) - 1) if p[k] not in " " + CUTS and p[k + 1] in CUTS}
        self.may_cross = re.compile(f"[{re.escape(''.join(sorted({a for a, _ in self.crossing})))}][{re.escape(CUTS)}]") if self.crossing else None
        self.ends: dict[str, int] = {}
        self.nodes = self.size = 0
        self.share, self.before = np.empty(1 << 16), np.empty(1 << 16, np.int64)
        self.unit, self.head = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.units: list[tuple[int, ...]] = [(i,) for i in range(n)]  # several ids for a character in bytes
        self.unit_of_char: dict[str, int] = {}
        self.flat = (np.empty(0, np.int64), np.empty(0, np.int64))

    def _extend(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hash of a run of characters from that of the run without its last one."""
        return mix(h * constants(9, 1)[0] + code.astype(np.uint64) + np.uint64(1))

    def _tables(self) -> list[tuple[np.ndarray, ...]]:
        """For each length: sorted hashes of the runs that pieces start with, the piece's id (-1: none), its weight, whether longer ones exist."""
        inside = {p[:k] for p in self.weight for k in range(1, len(p))}
        out = []
        for size in range(1, max(map(len, self.weight)) + 1):
            runs = sorted({p for p in self.weight if len(p) == size} | {p for p in inside if len(p) == size})
            codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).reshape(len(runs), size)
            h = np.zeros(len(runs), np.uint64)
            for j in range(size):
                h = self._extend(h, codes[:, j])
            order = np.argsort(h)
            ids = np.array([self.weight.get(r, (-1, 0.0))[0] for r in runs])[order]
            out.append((h[order], ids, np.array([self.weight.get(r, (-1, 0.0))[1] for r in runs])[order], np.array([r in inside for r in runs])[order]))
        return out

    def parts(self, text: str) -> list[str]:
        found = _PARTS.findall(" " + text)
        if self.may_cross and self.may_cross.search(text):  # a border that some piece does cross is none
            joined: list[str] = []
            for p in found:
                if joined and joined[-1][-1] + p[0] in self.crossing:
                    joined[-1] += p
                else:
                    joined.append(p)
            return joined
        return found

    def unit_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and where each unit's ids begin."""
        if len(self.flat[1]) != len(self.units) + 1:
            self.flat = np.array([i for u in self.units for i in u]), np.concatenate(([0], np.cumsum([len(u) for u in self.units])))
        return self.flat

    def _char(self, c: str) -> int:
        if c not in self.unit_of_char:
            self.unit_of_char[c] = len(self.units)
            self.units.append(tuple(self.byte_id[b] for b in c.encode()))
        return self.unit_of_char[c]

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last character, unit and log weight of every edge; ``left``: characters to the end of the part, itself included."""
        start, end, unit, weight = [], [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for size in range(1, len(self.tables) + 1):
            h = self._extend(h, codes[at + size - 1])
            known, ids, weights, more = self.tables[size - 1]
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            seen = known[k] == h
            whole = seen & (ids[k] >= 0)
            start.append(at[whole])
            end.append(at[whole] + size - 1)
            unit.append(ids[k[whole]])
            weight.append(weights[k[whole]])
            if size == 1:
                for i in np.flatnonzero(~whole).tolist():
                    c = chr(codes[i])
                    start.append([i])
                    end.append([i])
                    unit.append([self._char(c)])
                    weight.append([self.byte_weight * len(c.encode())])
            go = seen & more[k] & (left[at] > size)
            at, h = at[go], h[go]
        return tuple(np.concatenate(x) for x in (start, end, unit, weight))

    def filter(self, parts: list[str], first: int) -> tuple[np.ndarray, ...]:
        """Share, node before (-1: the start) and unit of the edges of all parts, and each node's first edge; a character's node is the one behind it.

        The sums run over all parts at once, character by character. A sum is kept as its logarithm, and each step works
        relative to the node before, so that long parts neither vanish nor overflow.
        """
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in parts])
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = np.arange(len(codes)) - begin
        start, end, unit, weight = self._edges(codes, np.repeat(lengths, lengths) - place)
        by = np.lexsort((start, end))
        start, end, unit, weight = start[by], end[by], unit[by], weight[by]
        mass, through = np.zeros(len(codes)), np.empty(len(end))
        order = np.argsort(place[end], kind="stable")
        slices = np.searchsorted(place[end][order], np.arange(int(lengths.max()) + 1))
        for j, (a, b) in enumerate(zip(slices[:-1], slices[1:])):
            own = order[a:b]
            node, from_ = end[own], start[own]
            base = mass[node - 1] if j else np.zeros(b - a)
            before = np.where(place[from_] > 0, mass[from_ - 1], 0.0)
            t = through[own] = np.exp(before + weight[own] - base)
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            mass[node[heads]] = base[heads] + np.log(np.add.reduceat(t, heads))
        heads = np.flatnonzero(np.diff(end, prepend=-1))
        sizes = np.diff(np.append(heads, len(end)))
        total = np.repeat(np.add.reduceat(through, heads), sizes)
        running = np.cumsum(through / total)
        within = running - np.repeat(running[heads] - (through / total)[heads], sizes)
        share = first + end + np.clip(within, 0.0, 1.0)
        share[heads + sizes - 1] = first + end[heads] + 1.0
        return np.maximum.accumulate(share), np.where(place[start] > 0, first + start - 1, -1), unit, heads

    def _append(self, columns: tuple[np.ndarray, ...], edge: int, node: int) -> None:
        for name, at, values in zip(("share", "before", "unit", "head"), (edge, edge, edge, node), columns):
            array = getattr(self, name)
            need = at + len(values)
            if need > len(array):
                array = np.concatenate([array, np.empty(max(len(array), need - len(array)), array.dtype)])
                setattr(self, name, array)
            array[at:need] = values

    def last_nodes(self, parts: list[str]) -> tuple[np.ndarray, int]:
        """The last node of each part, and the edges in use: kept ones, then those of parts that only this step holds."""
        known = self.ends
        found = [*map(known.get, parts)]
        edges = self.size
        if None in found:
            new = list(dict.fromkeys(p for p, f in zip(parts, found) if f is None))
            columns = self.filter(new, self.nodes)
            last = (self.nodes - 1 + np.cumsum([len(p) for p in new])).tolist()
            passing = dict(zip(new, last))
            found = [passing[p] if f is None else f for p, f in zip(parts, found)]
            self._append((*columns[:3], columns[3] + self.size), self.size, self.nodes)
            edges = self.size + len(columns[0])
            if len(known) < KEPT_PARTS and self.size < KEPT_EDGES:
                known.update(passing)
                self.nodes, self.size = last[-1] + 1, edges
        return np.array(found, np.int64), edges

    def sample(self, parts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of all parts in order, and the number of units of each part. ``seeds``: one 64-bit value per part."""
        at, edges = self.last_nodes(parts)
        share = self.share[:edges]
        live = np.arange(len(parts))
        step_of = int(constants(7, 1)[0])
        steps_: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            u = (mix(seeds[live] + np.uint64(len(steps_) * step_of % (1 << 64))) >> np.uint64(11)).astype(float) * 2.0**-53
            # The node's number takes bits from u; the largest u may round up to the next node's start.
            drawn = np.minimum(at + u, np.nextafter(at + 1.0, 0))
            edge = self.head[at]
            low = np.flatnonzero(share[edge] <= drawn)
            while len(low):
                edge[low] += 1
                low = low[share[edge[low]] <= drawn[low]]
            steps_.append((live, self.unit[edge]))
            at = self.before[edge]
            more = at >= 0
            live, at = live[more], at[more]
        counts = np.zeros(len(parts), np.int64)
        for own, _ in steps_:
            counts[own] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (own, units) in enumerate(steps_):
            out[ends[own] - 1 - k] = units
        return out, counts


def lattice(path: str, theta: float) -> Lattice:
    cache = worker_cache("lattices")
    if (path, theta) not in cache:
        cache[path, theta] = Lattice(path, theta)
    return cache[path, theta]


def row_seed(key: int | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{'' if key is None else key}")


def segment(model: Lattice, keys: list, texts: list[str | None], seed: int) -> Iterator[np.ndarray]:
    """The sampled ids of each text."""
    start = 0
    while start < len(texts):
        parts: list[str] = []
        sizes: list[int] = []
        end = start
        while end < len(texts) and len(parts) < STEP_PARTS:
            own = model.parts(texts[end]) if texts[end] else []
            parts += own
            sizes.append(len(own))
            end += 1
        seeds = np.array([row_seed(k, seed) for k in keys[start:end]], np.uint64)
        size = np.array(sizes)
        place = np.arange(len(parts)) - np.repeat(np.cumsum(size) - size, size)
        units, counts = model.sample(parts, mix(np.repeat(seeds, size) + place.astype(np.uint64) * constants(8, 1)[0]))
        flat, first = model.unit_ids()
        lengths = np.diff(first)[units]
        done = np.cumsum(lengths)
        units = flat[np.repeat(first[units] - done + lengths, lengths) + np.arange(done[-1] if len(done) else 0)]
        bounds = np.concatenate(([0], done))[np.concatenate(([0], np.cumsum(counts)))]
        borders = bounds[np.concatenate(([0], np.cumsum(size)))]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            yield units[a:b].astype("<u4")
        start = end


def decode(model: Lattice, ids: np.ndarray) -> str:
    return b"".join([*map(model.bytes_of.__getitem__, ids.tolist())]).decode()[1:]


def sample_pieces(docs: DataFrame, path: str, seed: int = 0, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """The id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), text_sha256 of the decoded ids, and the ids."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, theta)
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for a in range(0, len(texts), 512):
                found = [*segment(model, keys[a : a + 512], texts[a : a + 512], seed)]
                columns = [
                    pa.array(keys[a : a + 512], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(decode(model, x).encode()).hexdigest() for x in found], pa.string()),
                ]
                names = ["id", "n_pieces", "ids_crc32", "text_sha256"]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = only(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    ddl = "id long, n_pieces long, ids_crc32 long, text_sha256 string" + ", ids array<int>" * ids
    return rows.mapInArrow(run, ddl).withColumnRenamed("id", id_col)

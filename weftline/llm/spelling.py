"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

Words. Maximal runs of Latin letters are counted a task at a time and summed. A stated share of the runs, chosen by a hash of
document and word, loses one letter first.

Search. A word is a point: how often it holds each letter. Deleting or inserting a letter moves it by one, replacing a letter by two, with one
count up and one down. So the words near to one of length l lie in the trees of lengths l - 1, l and l + 1, within a distance of at
most two. A length's k-d tree is split on the driver from a bounded sample of its words, and every word is placed in a cell by these
splits. A word also goes, as a query, to the cells whose box it can reach: a side of a split costs what the count has to rise
or fall. Cells that are fuller than planned are divided into blocks, cells with many queries into shares of queries; both
numbers come from counts over all words, and each query meets each block once. In a block, a k-d tree down to small leaves is walked by all
queries at once, box by box; words that pass the leaf's letter signature are compared letter by letter. Pairs are never written: a block
gives each query's number of near words and its most frequent one, and these are added up.

Chains from a word to its form, the form's form and so on are followed by pointer doubling; counts grow along a chain, so it ends.

Null and empty texts have no words; a null id is written as an empty one in the hash. Rows that repeat count each time. Of equally
frequent near words the first in code-point order is the form. A very long word is one word; lengths from ``LONGEST`` on share a
tree. An empty table gives no words. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import written

#: Fixed values of the contract: runs of A-Z, a-z and U+00C0 to U+00FF; of A-Z, only these are lower-cased.
RUN = r"[A-Za-z\u00C0-\u00FF]"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Words that a task counts before it hands its counts on.
COUNTED = 400_000
#: Lengths from here on share one tree.
LONGEST = 64
#: Words a cell is planned for, cells of a tree at most (fuller cells have more blocks), and sampled words a cell.
CELL, CELLS, SAMPLED = 8192, 1024, 64
#: Queries that one share of a cell's queries holds.
QUERIES = 1 << 17
#: Words of a leaf of a block's tree; pairs that are compared at a time.
LEAF = 48
PAIRS = 1 << 18

LETTERS = 90  # a-z, then U+00C0 to U+00FF
_PLACE = np.full(256, LETTERS, np.int64)
_PLACE[ord("a") : ord("z") + 1] = np.arange(26)
_PLACE[0xC0:] = np.arange(26, LETTERS)


def word_counts(docs: DataFrame, min_letters: int, one_in: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): how often each run of at least ``min_letters`` letters occurs. Where ``one_in`` divides the hash h of id and run,
    the run loses its letter h % length first."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        runs = re.compile(RUN + "{%d,}" % min_letters).findall
        counts: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], names=["word", "n"])

        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1)
            for doc, text in zip(ids, texts.cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                found = runs(text.translate(_LOWER).decode())
                counts.update(found)
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                cut = [w for w in set(found) if not zlib.crc32(w.encode(), start) % one_in]
                if cut:
                    own = Counter(found)
                    for w in cut:
                        at = zlib.crc32(w.encode(), start) % len(w)
                        counts[w] -= own[w]
                        if len(w) > min_letters:
                            counts[w[:at] + w[at + 1 :]] += own[w]
                if len(counts) >= COUNTED:
                    yield told()
                    counts.clear()
        yield told()

    slim = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_counts(words: list[bytes]) -> np.ndarray:
    """How often each word (in Latin-1) holds each letter."""
    size = np.array([len(w) for w in words], np.int64)
    letters = _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    row = np.repeat(np.arange(len(words)), size)
    return np.bincount(row * (LETTERS + 1) + letters, minlength=len(words) * (LETTERS + 1)).reshape(len(words), LETTERS + 1)[:, :LETTERS].astype(np.int32)


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits a word, of which one moved letter count changes one at most: whether a-z occur once and twice, the others in 12 groups."""
    bits = np.zeros((len(counts), 64), np.uint8)
    bits[:, :26] = counts[:, :26] >= 1
    bits[:, 26:52] = counts[:, :26] >= 2
    for k in range(12):
        bits[:, 52 + k] = counts[:, 26 + k :: 12].any(1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


class Tree:
    """Splits of letter counts: at each node a letter and a count from which words go right; leaves have numbers."""

    def __init__(self, counts: np.ndarray, leaf: int):
        self.letter, self.count, self.left, self.right, self.leaf = [], [], [], [], []
        self.rows: list[np.ndarray] = []
        self.size = leaf
        self._grow(counts)

    def _node(self) -> int:
        for column in (self.letter, self.count, self.left, self.right, self.leaf):
            column.append(-1)
        return len(self.letter) - 1

    def _grow(self, counts: np.ndarray) -> None:
        waiting = [(self._node(), np.arange(len(counts)))]
        while waiting:
            node, rows = waiting.pop()
            split = self._split(counts[rows]) if len(rows) > self.size else None
            if split is None:
                self.leaf[node] = len(self.rows)
                self.rows.append(rows)
                continue
            letter, count = split
            right = counts[rows, letter] >= count
            self.letter[node], self.count[node] = letter, count
            self.left[node], self.right[node] = self._node(), self._node()
            waiting += [(self.left[node], rows[~right]), (self.right[node], rows[right])]

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that halve the words best; none if all words are one point."""
        best, found = 0, None
        for count in range(1, int(own.max(initial=0)) + 1):
            share = (own >= count).sum(0)
            even = np.minimum(share, len(own) - share)
            letter = int(even.argmax())
            if even[letter] > best:
                best, found = int(even[letter]), (letter, count)
            if best * 3 > len(own) or not share.any():
                break
        return found

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        out = np.empty(len(counts), np.int64)
        waiting = [(0, np.arange(len(counts)))]
        while waiting:
            node, rows = waiting.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            right = counts[rows, self.letter[node]] >= self.count[node]
            waiting += [(self.left[node], rows[~right]), (self.right[node], rows[right])]
        return out

    def reach(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the words from which their box can be reached by raising ``up`` and lowering ``down`` counts by one at most."""
        n = len(counts)
        waiting = [(0, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {})]
        while waiting:
            node, rows, rise, fall, box = waiting.pop()
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
                continue
            letter, count = self.letter[node], self.count[node]
            own = counts[rows, letter]
            low, high = box.get(letter, (0, None))
            # what the count had to move before, and has to on either side
            more = np.maximum(0, count - own) - np.maximum(0, low - own)
            less = np.maximum(0, own - (count - 1)) - (np.maximum(0, own - high) if high is not None else 0)
            for child, rises, falls, bounds in (
                (self.left[node], rise, fall + less, (low, count - 1)),
                (self.right[node], rise + more, fall, (count, high)),
            ):
                stay = (rises <= up) & (falls <= down)
                if stay.any():
                    waiting.append((child, rows[stay], rises[stay], falls[stay], {**box, letter: bounds}))


def near_rows(a: list[bytes], b: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (a[i], b[j]) differ by exactly one inserted, deleted or replaced letter, compared letter by letter."""
    size_a, size_b = np.array([len(w) for w in a], np.int64), np.array([len(w) for w in b], np.int64)
    width = int(max(size_a.max(initial=1), size_b.max(initial=1)))
    if width >= LONGEST:
        return np.array([one_edit(a[x], b[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    out = np.zeros(len(i), bool)
    heads = [np.array(w, f"S{width}").view(np.uint8).reshape(len(w), width) for w in (a, b)]
    tails = [np.array([w.rjust(width, b"\0") for w in words], f"S{width}") for words in (a, b)]
    tails = [np.frombuffer(t.tobytes(), np.uint8).reshape(len(t), width) for t in tails]
    for k in range(0, len(i), PAIRS):
        x, y = i[k : k + PAIRS], j[k : k + PAIRS]
        differ = heads[0][x] != heads[1][y]
        shorter, longer = np.minimum(size_a[x], size_b[y]), np.maximum(size_a[x], size_b[y])
        first = np.where(differ.any(1), differ.argmax(1), width)
        behind = tails[0][x][:, ::-1] != tails[1][y][:, ::-1]
        last = np.where(behind.any(1), behind.argmax(1), width)
        out[k : k + PAIRS] = np.where(shorter == longer, differ.sum(1) == 1, (longer - shorter == 1) & (first + last >= shorter))
    return out


def one_edit(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x != y[: len(x)])
    if not len(differ):
        return True  # the last letter is the one inserted
    k = int(differ[0])
    return len(differ) == 1 if len(a) == len(b) else a[k:] == b[k + 1 :]


def group_of(size: np.ndarray) -> np.ndarray:
    return np.minimum(size, LONGEST)


def searches(group: int) -> list[tuple[int, int, int]]:
    """Where words of a length look: the tree's length, and how many counts may rise and fall on the way."""
    if group == LONGEST:  # lengths from LONGEST on
        return [(group - 1, 0, 1), (group, 1, 1)]
    return [(group - 1, 0, 1), (group, 1, 1), (group + 1, 1, 0)]


class Cells:
    """The trees of all lengths, with how many blocks of words and shares of queries each of their leaves has."""

    def __init__(self, trees: dict[int, Tree], counts: dict[tuple[int, int], tuple[int, int]] | None = None):
        self.trees = trees
        self.parts = {cell: (max(1, -(-words // (2 * CELL))), max(1, -(-asked // QUERIES))) for cell, (words, asked) in (counts or {}).items()}

    def rows(self, words: list[bytes]) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        """(length, leaf, whether as queries, places in ``words``) for each cell that a word lies in or can reach."""
        groups = group_of(np.array([len(w) for w in words], np.int64))
        for group in np.unique(groups).tolist():
            at = np.flatnonzero(groups == group)
            counts = letter_counts([words[k] for k in at])
            if group in self.trees:
                leaves = self.trees[group].place(counts)
                for leaf in np.unique(leaves).tolist():
                    yield group, leaf, False, at[leaves == leaf]
            for length, up, down in searches(group):
                if length in self.trees:
                    for leaf, rows in self.trees[length].reach(counts, up, down):
                        yield length, leaf, True, at[rows]


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _tally(cells: Cells):
    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, int, bool]] = Counter()
        for part in parts:
            for length, leaf, query, rows in cells.rows(_latin(part.column("word"))):
                found[length, leaf, query] += len(rows)
        keys = [*found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[c] for k in keys], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.bool_()))] + [pa.array([found[k] for k in keys], pa.int64())],
            names=["length", "leaf", "query", "rows"],
        )

    return tally


_SENT = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("block", pa.int32()), ("share", pa.int32()), ("query", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
_SENT_DDL = "length int, leaf int, block int, share int, query boolean, word string, n long"


def _send(cells: Cells):
    """Words to their block, once a share of queries; queries to their share, once a block."""

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = _latin(part.column("word"))
            own = np.array([zlib.crc32(w) for w in words], np.int64)
            columns = [[] for _ in range(5)]
            taken = []
            for length, leaf, query, rows in cells.rows(words):
                blocks, shares = cells.parts[length, leaf]
                for k in range(blocks if query else shares):
                    taken.append(rows)
                    block = np.full(len(rows), k) if query else own[rows] % blocks
                    share = own[rows] // 7 % shares if query else np.full(len(rows), k)
                    for column, values in zip(columns, (np.full(len(rows), length), np.full(len(rows), leaf), block, share, np.full(len(rows), query)), strict=True):
                        column.append(values)
            if taken:
                rows = pa.array(np.concatenate(taken))
                arrays = [pa.array(np.concatenate(c), f.type) for c, f in zip(columns, _SENT, strict=False)]
                whole = pa.RecordBatch.from_arrays([*arrays, part.column("word").take(rows), part.column("n").take(rows)], schema=_SENT)
                for k in range(0, whole.num_rows, 1 << 17):
                    yield whole.slice(k, 1 << 17)

    return send


class Block:
    """The words of one block, in order of falling frequency, with their tree."""

    def __init__(self, words: list[str], counts: list[int], length: int):
        order = sorted(range(len(words)), key=lambda k: (-counts[k], words[k]))
        self.words, self.n = [words[k] for k in order], np.array([counts[k] for k in order], np.int64)
        self.latin = [w.encode("latin-1") for w in self.words]
        points = letter_counts(self.latin)
        self.tree, self.marks, self.length = Tree(points, LEAF), signatures(points), length

    def ask(self, queries: list[str]) -> Iterator[tuple[int, int, int]]:
        """(query's place, number of near words, place of the most frequent one) for queries with near words."""
        latin = [w.encode("latin-1") for w in queries]
        groups = group_of(np.array([len(w) for w in latin], np.int64))
        for group in np.unique(groups).tolist():
            at = np.flatnonzero(groups == group)
            own = [latin[k] for k in at]
            points = letter_counts(own)
            marks = signatures(points)
            up, down = next((u, d) for length, u, d in searches(group) if length == self.length)
            number, best = np.zeros(len(own), np.int64), np.full(len(own), len(self.words))
            left, right = [], []

            def settle(own=own, number=number, best=best, left=left, right=right) -> None:
                i, j = np.concatenate(left), np.concatenate(right)
                near = near_rows(own, self.latin, i, j)
                np.add.at(number, i[near], 1)
                np.minimum.at(best, i[near], j[near])
                left.clear()
                right.clear()

            for leaf, rows in self.tree.reach(points, up, down):
                members = self.tree.rows[leaf]
                some = max(1, PAIRS // len(members))
                for k in range(0, len(rows), some):
                    i, j = np.nonzero(np.bitwise_count(marks[rows[k : k + some]][:, None] ^ self.marks[members][None, :]) <= up + down)
                    left.append(rows[k : k + some][i])
                    right.append(members[j])
                    if sum(map(len, left)) > PAIRS:
                        settle()
            if left:
                settle()
            for k in np.flatnonzero(number).tolist():
                yield int(at[k]), int(number[k]), int(best[k])


def _match(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells, the words of a block before the queries that meet it: near words of each query in the block."""
    key, words, counts, block = None, [], [], None
    for part in parts:
        names = ("length", "leaf", "block", "share", "query")
        own = np.stack([np.asarray(part.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in names], axis=1)
        starts = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)]).tolist()
        out: list[tuple] = []
        for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
            *cell, query = own[a].tolist()
            if cell != key:
                key, words, counts, block = cell, [], [], None
            rows = part.slice(a, b - a)
            if not query:
                words += rows.column("word").to_pylist()
                counts += rows.column("n").to_pylist()
                continue
            if not words:
                continue
            block = block or Block(words, counts, cell[0])
            asked = rows.column("word").to_pylist()
            out += [(asked[q], number, int(block.n[best]), block.words[best]) for q, number, best in block.ask(asked)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n_near", "most", "near"])


def _plan(words: DataFrame) -> Cells:
    """Trees from a bounded sample, and how full their cells are."""
    group = F.least(F.length("word"), F.lit(LONGEST))
    sizes = {r.length: r.rows for r in words.groupBy(group.alias("length")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # LONGEST rows at most
    cells = {g: min(CELLS, -(-n // CELL)) for g, n in sizes.items()}
    # Expected: SAMPLED words a cell, so at most SAMPLED * CELLS a length; a word is in the sample or not by its hash.
    rates = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, cells[g] * SAMPLED / n if cells[g] > 1 else 0.0)]) if sizes else None
    sample = words.filter((F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / (1 << 20)) < rates[group]).select("word").collect() if sizes else []
    drawn: dict[int, list[bytes]] = {g: [] for g in sizes}
    for r in sample:
        drawn[min(len(r.word), LONGEST)].append(r.word.encode("latin-1"))
    trees = {g: Tree(letter_counts(own), SAMPLED if cells[g] > 1 else len(own) + 1) for g, own in drawn.items()}
    found = words.select("word").mapInArrow(_tally(Cells(trees)), "length int, leaf int, query boolean, rows long")
    told: dict[tuple[int, int], list[int]] = {}
    for r in found.groupBy("length", "leaf", "query").agg(F.sum("rows").alias("rows")).collect():  # two rows a cell at most
        told.setdefault((r.length, r.leaf), [0, 0])[r.query] = r.rows
    return Cells(trees, {cell: tuple(c) for cell, c in told.items()})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, most, near) for the words (word, n) that have near ones: how many, and the most frequent with its n."""
    sent = words.select("word", "n").mapInArrow(_send(_plan(words)), _SENT_DDL)
    cell = ["length", "leaf", "block", "share"]
    met = sent.repartition(*cell).sortWithinPartitions(*cell, "query").mapInArrow(_match, "word string, n_near long, most long, near string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "near")).alias("best")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("most"), "best.near")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): where the chain of forms from each word ends. Each round doubles the way covered."""
    now = written(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_letters: int, min_count: int, times: int, one_in: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words of at least ``min_letters`` letters that occur ``min_count`` times. The form is the most
    frequent near word if it occurs at least ``times`` as often as the word."""
    words = word_counts(docs, min_letters, one_in, id_column, text_column).filter(F.col("n") >= min_count)
    words = written(words, "spelling-words")
    near = near_words(words)
    known = words.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("most") >= times * F.col("n"), F.lit(False)))
    known = written(
        known.select("word", F.when(F.col("is_form"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("most")).alias("form_n")),
        "spelling-forms",
    )
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

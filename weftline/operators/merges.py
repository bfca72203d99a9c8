"""A whole vocabulary by merges: exact training in few rounds, and encoding by it.

One-by-one training merges the best pair, counts again, and so on. Its order is: most frequent first, then the shorter merged
piece, then the piece's and the left symbol's text. Here a round takes the best K pairs (candidates) and what they can do to
each other: the runs of symbols in which every two neighbours are a candidate, as distinct runs with summed counts. Training
one by one on these runs alone gives the same merges as on all words, as long as a picked pair does not come after the last
candidate:

- a merge of (a, b) takes occurrences from pairs beside it and makes pairs (x, ab) and (ab, y), each with at most the count of
  (x, a) or (b, y) and a longer piece. So what comes from a pair outside the candidates stays behind the last candidate.
- what comes from candidates lies inside a run and is counted there exactly.
- if a merge spells a symbol that is there already, pairs with that symbol can gain occurrences; the round ends with it.

Every round makes one merge at least. K only decides how many more: it is halved where a round's runs exceed a bound, which is
what the driver holds (runs of the most frequent pairs, never words), and doubled where they stay far below it.

With ties by symbols (``by_symbols``) a pair (b, y) behind the last candidate can become (ab, y) before it, if both are equally
frequent. So candidates are taken with all pairs that are as frequent as the last one; where these are too many for the driver,
the round ends before the first pair that such an (ab, y) could precede.

The words are a written table of blocks: symbols as numbers, a zero behind every word, and the words' counts. A round reads it
twice, and once to write the words after its merges; every pass works on whole blocks, word by word only on the driver's runs.
Words that have become one symbol leave the table. A lost executor repeats its part of one pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CHARACTER_COVERAGE, DEFAULT_VOCAB_SIZE, FIRST_PIECE_ID
from ..session import fresh_folder
from ..sources.tables import remove
from .encode import byte_ids
from .vocab import char_coverage, char_freq

#: Candidates of the first round and of any round at most; distinct runs that a round brings to the driver at most.
FIRST_CANDIDATES, CANDIDATES = 256, 8192
RUNS = 1 << 16

#: Equally frequent pairs that a round brings to the driver at most, to order them by their text.
TIES = 1 << 17

#: Pieces of a batch that are joined at a time.
TOGETHER = 1 << 14

#: Symbols of a block of words; the number of the first piece, behind those of all characters (code point + 1).
BLOCK, FIRST = 1 << 18, 0x110001

#: Characters of a word up to which joins are looked for in a plain list or a batch, and its ids are kept; pieces whose ids a worker keeps.
SHORT, KEPT = 64, 1 << 17

Pair = tuple[str, str]
Key = Callable[[str, str, int], tuple]
_WORDS = pa.schema([("symbols", pa.list_(pa.string())), ("freq", pa.int64())])
_NEVER = np.iinfo(np.int32).max


def order_key(left: str, right: str, freq: int) -> tuple:
    """The order in which pairs are merged, smallest first."""
    merged = left + right
    return -freq, len(merged), merged, left


def symbols_key(left: str, right: str, freq: int) -> tuple:
    """The order with ties by symbols, smallest first."""
    return -freq, left, right


def apply_merge(symbols: list, left, right, both=None) -> list:
    """The symbols with every (left, right) merged, from left to right, to ``both`` or the two together."""
    both = left + right if both is None else both
    out, k = [], 0
    while k < len(symbols):
        if k + 1 < len(symbols) and symbols[k] == left and symbols[k + 1] == right:
            out.append(both)
            k += 2
        else:
            out.append(symbols[k])
            k += 1
    return out


def merge_by_rank(symbols: list[str], ranks: dict[Pair, int]) -> list[str]:
    """The symbols of one word after all merges of a round, the earlier ones first: what ``_merged`` does for a block."""
    near = [*map(ranks.get, zip(symbols, symbols[1:]))]
    if near.count(None) == len(near):  # most words in most rounds
        return symbols
    while True:
        best = min((r for pair in zip(symbols, symbols[1:]) if (r := ranks.get(pair)) is not None), default=None)
        if best is None:
            return symbols
        left, right = next(p for p in zip(symbols, symbols[1:]) if ranks.get(p) == best)
        symbols = apply_merge(symbols, left, right)


def train_on_runs(runs: Iterable[tuple[list[int], int]], names: dict[int, str], ids: dict[str, int], key: Key, last: tuple | None, limit: float, most: float) -> list[tuple[int, int, int]]:
    """Merges one by one on runs (symbols, freq): pairs up to the key ``last``, and up to the first piece that is in ``ids``
    already. ``limit`` is the number of new pieces at most, ``most`` that of merges. New pieces are added to ``names`` and ``ids``."""
    words = [symbols for symbols, _ in runs]
    weight = [freq for _, freq in runs]
    counts: Counter[tuple[int, int]] = Counter()
    where: defaultdict[tuple[int, int], set[int]] = defaultdict(set)
    for k, symbols in enumerate(words):
        for pair in zip(symbols, symbols[1:]):
            counts[pair] += weight[k]
            where[pair].add(k)
    heap = [(*key(names[a], names[b], n), (a, b)) for (a, b), n in counts.items()]
    heapq.heapify(heap)
    done: list[tuple[int, int, int]] = []
    made, before_this = 0, None
    behind: set[int] = set()  # pieces made here that may stand before a symbol without being counted as a pair
    while heap and made < limit and len(done) < most:
        *place, pair = heapq.heappop(heap)
        if counts[pair] != -place[0] or not counts[pair]:
            continue  # counted anew since
        if last is not None and tuple(place) > last or before_this is not None and tuple(place) >= before_this:
            break
        done.append((*pair, counts[pair]))
        left, right = names[pair[0]], names[pair[1]]
        piece = left + right
        again = piece in ids
        both = ids.setdefault(piece, FIRST + len(ids))
        names[both] = piece
        if key is symbols_key and last is not None and len(last) > 1 and (right >= last[1] or pair[1] in behind):
            behind.add(both)
            before_this = min(before_this or (last[0], piece), (last[0], piece))
        changed: Counter[tuple[int, int]] = Counter()
        for k in where.pop(pair):
            before, after = words[k], apply_merge(words[k], *pair, both)
            if len(after) == len(before):
                continue
            for old in zip(before, before[1:]):
                changed[old] -= weight[k]
            for new in zip(after, after[1:]):
                changed[new] += weight[k]
                where[new].add(k)
            words[k] = after
        for other, n in changed.items():
            counts[other] += n
            if n and counts[other] and other != pair:
                heapq.heappush(heap, (*key(names[other[0]], names[other[1]], counts[other]), other))
        counts[pair] = 0
        if again:
            break
        made += 1
    return done


def _count_pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbours of words as text, a batch at a time: what ``_pairs`` gives for a block."""
    for part in parts:
        lists = part.column("symbols")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        empty = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) == 0)[codes]
        at = np.flatnonzero((word[:-1] == word[1:]) & ~empty[:-1] & ~empty[1:])
        both, place = np.unique(codes[at] << 32 | codes[at + 1], return_inverse=True)
        counts = np.zeros(len(both), np.int64)
        np.add.at(counts, place, part.column("freq").to_numpy(zero_copy_only=False)[word[at]])
        left, right = (coded.dictionary.take(pa.array(c)) for c in (both >> 32, both & 0xFFFFFFFF))
        yield pa.RecordBatch.from_arrays([left, right, pa.array(counts)], names=["left", "right", "freq"])


class _Names(dict):
    """Texts of symbols by number: those of pieces are kept, characters follow from their number."""

    def __missing__(self, number: int) -> str:
        return chr(number - 1)


class _Lookup:
    """Ranks of pairs of symbols, left << 32 | right: their places in the list, if not given."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray | None = None):
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.ranks = (order if ranks is None else ranks[order]).astype(np.int32)
        self.lefts, self.rights = (np.zeros(int(part.max(initial=0)) + 2, bool) for part in (pairs >> 32, pairs & 0xFFFFFFFF))  # the last place is free
        self.lefts[pairs >> 32] = True
        self.rights[pairs & 0xFFFFFFFF] = True

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NEVER if it is not in the list."""
        out = np.full(len(left), _NEVER, np.int32)
        near = np.flatnonzero(self.lefts[np.minimum(left, len(self.lefts) - 1)] & self.rights[np.minimum(right, len(self.rights) - 1)])
        wanted = left[near].astype(np.int64) << 32 | right[near]
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        hit = self.pairs[at] == wanted if len(self.pairs) else np.zeros(0, bool)
        out[near[hit]] = self.ranks[at[hit]]
        return out


def _weights(symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The count of its word for each symbol of a block."""
    return np.repeat(freq, np.diff(np.flatnonzero(symbols == 0), prepend=-1))


def _block(symbols: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block (symbols, freq) of the parts with two symbols or more between zeros."""
    some = symbols != 0
    kept = np.zeros(len(symbols), bool)
    near = some[:-1] & some[1:]
    kept[:-1] |= near
    kept[1:] |= near
    ends = ~some
    ends[1:] &= kept[:-1]
    ends[:1] = False
    return symbols[kept | ends], weights[ends]


def _characters(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words as numbers, a zero behind each word, and the words' numbers of characters; no word is null."""
    if not len(tokens):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sizes = pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    raw = tokens.buffers()[2]
    text = raw[int(offsets[0]) : int(offsets[-1])].to_pybytes().decode() if raw is not None else ""
    numbers = np.frombuffer(text.encode("utf-32-le"), np.int32) + 1
    symbols = np.zeros(len(numbers) + len(tokens), np.int32)
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(tokens)), sizes)] = numbers
    return symbols, sizes


def _numbered(tokens: pa.Array, freq: np.ndarray, covered: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A block of words; a character that is not covered becomes a zero, which no pair may hold."""
    symbols, sizes = _characters(tokens)
    return _block(symbols if covered is None else np.where(covered[symbols], symbols, 0), np.repeat(freq, sizes + 1))


def _pairs(symbols: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of neighbours of a block, left << 32 | right, and their counts."""
    at = np.flatnonzero((symbols[:-1] != 0) & (symbols[1:] != 0))
    coded = pa.array(symbols[at].astype(np.int64) << 32 | symbols[at + 1]).dictionary_encode()
    counts = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(counts, coded.indices.to_numpy(), _weights(symbols, freq)[at])
    return coded.dictionary.to_numpy(), counts


def _runs(symbols: np.ndarray, freq: np.ndarray, chosen: _Lookup) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of symbols whose neighbours are all chosen pairs, distinct ones as bytes, and their counts."""
    linked = np.concatenate(([False], chosen(symbols[:-1], symbols[1:]) != _NEVER, [False]))
    start, end = np.flatnonzero(linked[1:] & ~linked[:-1]), np.flatnonzero(linked[:-1] & ~linked[1:])
    sizes = end - start + 1
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    numbers = symbols[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)].astype(np.int32)
    buffers = [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())]
    coded = pa.Array.from_buffers(pa.binary(), len(start), buffers).dictionary_encode()
    counts = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(counts, coded.indices.to_numpy(), _weights(symbols, freq)[start])
    return coded.dictionary, counts


def _joined(symbols: np.ndarray, tags: np.ndarray, ranks: _Lookup, made: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Words, with a zero behind each and a tag each, after all joins of ranked pairs to the symbols ``made``, best rank first: at
    the leftmost of its places in a word if ``once``, else at all of them. Words without a ranked pair are set aside first."""
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    rank = np.append(ranks(symbols[:-1], symbols[1:]), np.int32(_NEVER))[: len(symbols)]
    while len(symbols):
        sizes = np.diff(np.flatnonzero(symbols == 0), prepend=-1)
        best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
        live = best != _NEVER
        if not live.all():
            kept = np.repeat(live, sizes)
            ready.append((symbols[~kept], tags[~live]))
            symbols, rank, tags, best, sizes = symbols[kept], rank[kept], tags[live], best[live], sizes[live]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        if once:
            at = at[np.searchsorted(at, np.cumsum(sizes) - sizes)]
        elif (near := np.diff(at, prepend=-2) == 1).any():  # a symbol twice: every second place of a row of them
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(near, 0, number))) % 2 == 0]
        kept = np.ones(len(symbols), bool)
        kept[at + 1] = False
        new = made[rank[at]]
        at -= np.arange(len(at))
        symbols, rank = symbols[kept], rank[kept]
        symbols[at] = new
        rank[at] = ranks(symbols[at], symbols[at + 1])
        at = at[at > 0] - 1
        rank[at] = ranks(symbols[at], symbols[at + 1])
    return tuple(map(np.concatenate, zip(*ready))) if ready else (symbols, tags)


def _merged(symbols: np.ndarray, freq: np.ndarray, merges: _Lookup, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block after the merges of a round."""
    symbols, freq = _joined(symbols, freq, merges, made, once=False)
    return _block(symbols, _weights(symbols, freq))


def _blocks(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in parts:
        for symbols, freq in zip(part.column("symbols"), part.column("freq")):
            yield np.frombuffer(symbols.as_buffer(), np.int32), np.frombuffer(freq.as_buffer(), np.int64)


def _rows(symbols: np.ndarray, freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(freq):
        yield pa.RecordBatch.from_arrays([pa.array([symbols.astype(np.int32).tobytes()], pa.binary()), pa.array([freq.astype(np.int64).tobytes()], pa.binary())], names=["symbols", "freq"])


def _spell(covered: frozenset[str] | None):
    """Words (token, freq) as blocks."""

    def spell(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        if covered is not None:
            known = np.zeros(FIRST, bool)
            known[[ord(c) + 1 for c in covered if len(c) == 1]] = True
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for part in parts:
            kept.append(_numbered(part.column("token"), part.column("freq").to_numpy(zero_copy_only=False), known))
            if sum(len(symbols) for symbols, _ in kept) >= BLOCK:
                yield from _rows(*map(np.concatenate, zip(*kept)))
                kept = []
        if kept:
            yield from _rows(*map(np.concatenate, zip(*kept)))

    return spell


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(parts):
        yield pa.RecordBatch.from_arrays([*map(pa.array, _pairs(*block))], names=["pair", "freq"])


def _cut(pairs: np.ndarray):
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _Lookup(pairs)
        for block in _blocks(parts):
            run, freq = _runs(*block, chosen)
            yield pa.RecordBatch.from_arrays([run, pa.array(freq)], names=["run", "freq"])

    return cut


def _merge(pairs: np.ndarray, made: np.ndarray):
    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _Lookup(pairs)
        for block in _blocks(parts):
            yield from _rows(*_merged(*block, merges, made))

    return merge


def _named(names: dict[int, str]):
    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            both = [(names.get(p >> 32) or chr((p >> 32) - 1), names.get(p & 0xFFFFFFFF) or chr((p & 0xFFFFFFFF) - 1)) for p in part.column("pair").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string())], names=["pair", "freq", "left", "right"])

    return named


def _leading(counts: DataFrame, names: _Names, many: int, key: Key) -> tuple[list[tuple[int, int, int]], bool, bool]:
    """The first ``many`` pairs in order, with all that are as frequent as the last of them; whether others follow; whether
    some of these are as frequent (then there are more than TIES, and only ``many`` are given)."""
    top = counts.orderBy(F.desc("freq")).limit(TIES + 1).toArrow()
    pair, freq = top["pair"].to_numpy(), top["freq"].to_numpy()
    least = freq[min(many, len(freq)) - 1] if len(freq) else 0
    cut = len(freq) > TIES and freq[-1] == least
    if cut and freq[0] == least:  # Python orders text by code points, as Spark does by bytes of UTF-8
        merged = F.concat("left", "right")
        order = ["left", "right"] if key is symbols_key else [F.length(merged), merged, "left"]
        equal = counts.where(F.col("freq") == int(least)).mapInArrow(_named(dict(names)), "pair long, freq long, left string, right string")
        top = equal.orderBy(*order).limit(many).toArrow()
        return [(p >> 32, p & 0xFFFFFFFF, n) for p, n in zip(top["pair"].to_pylist(), top["freq"].to_pylist())], True, True
    kept = freq > least if cut else freq >= least
    found = [(p >> 32, p & 0xFFFFFFFF, n) for p, n in zip(pair[kept].tolist(), freq[kept].tolist())]
    return sorted(found, key=lambda r: key(names[r[0]], names[r[1]], r[2])), len(found) < len(freq), False


def _cuts(leading: list[tuple[int, int, int]], many: int, key: Key) -> Iterator[int]:
    """How many of the leading pairs a round may take, most first. Ties by symbols are kept together as long as there are others."""
    size = len(leading) if key is symbols_key else min(many, len(leading))
    while size > 0:
        yield size
        half = size // 2
        if key is symbols_key:
            least = leading[half][2]
            half = next((k for k in range(half, 0, -1) if leading[k - 1][2] > least), half)
        size = half


def _packed(pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.array([a << 32 | b for a, b in pairs], np.int64)


def train(
    freq: DataFrame, covered: frozenset[str] | None, pieces: float, told: Callable[[str], None] = lambda _: None, most: float = math.inf, by_symbols: bool = False
) -> list[tuple[str, str, int]]:
    """Merges (left, right, freq) in order until ``pieces`` pieces are made, ``most`` merges, or no pair is left, over words (token, freq).

    ``covered`` are the characters that may be merged, all without it. ``by_symbols``: ties by the left symbol, then the right one.
    Bounded by ``pieces``, RUNS and TIES on the driver. Null words and words of one character take no part; an empty table gives none.
    """
    spark, ddl, key = freq.sparkSession, "symbols binary, freq binary", symbols_key if by_symbols else order_key
    bound = 4 * RUNS if by_symbols else RUNS
    paths: list[str] = []

    def stored(df: DataFrame) -> DataFrame:
        paths.append(fresh_folder(spark, "merge-words"))
        df.write.parquet(paths[-1])
        for old in paths[:-1]:
            remove(spark, old)
        del paths[:-1]
        return spark.read.schema(ddl).parquet(paths[-1])

    words = stored(freq.where(F.col("token").isNotNull()).select("token", "freq").mapInArrow(_spell(covered), ddl))
    done: list[tuple[str, str, int]] = []
    names, ids, many = _Names(), {}, FIRST_CANDIDATES
    while len(ids) < pieces and len(done) < most:
        counts = words.mapInArrow(_count, "pair long, freq long").groupBy("pair").agg(F.sum("freq").alias("freq"))
        leading, more, equal = _leading(counts, names, many, key)
        if not leading:
            break
        for size in _cuts(leading, many, key):
            chosen = leading[:size]
            distinct = words.mapInArrow(_cut(_packed([r[:2] for r in chosen])), "run binary, freq long").groupBy("run").agg(F.sum("freq").alias("freq"))
            # one candidate has one run, or one a length if it is a symbol twice
            runs = (distinct if size == 1 else distinct.limit(bound + 1)).toArrow()
            if len(runs) <= bound:
                break
        many = size if size < min(many, len(leading)) else many
        whole = leading[size][2] < chosen[-1][2] if size < len(leading) else not equal
        last = None if size == len(leading) and not more else (1 - chosen[-1][2],) if whole else key(names[chosen[-1][0]], names[chosen[-1][1]], chosen[-1][2])
        parsed = [(np.frombuffer(run, np.int32).tolist(), n) for run, n in zip(runs["run"].to_pylist(), runs["freq"].to_pylist())]
        found = train_on_runs(parsed, names, ids, key, last, pieces - len(ids), most - len(done))
        done += [(names[a], names[b], n) for a, b, n in found]
        told(f"{len(found)} merges of {size} candidates by {len(runs)} runs")
        if len(ids) < pieces and len(done) < most:
            words = stored(words.mapInArrow(_merge(_packed([r[:2] for r in found]), np.array([ids[names[a] + names[b]] for a, b, _ in found], np.int32)), ddl))
        many = min(CANDIDATES, 2 * many) if len(runs) * 4 <= bound else many
    for path in paths:
        remove(spark, path)
    return done


def merge_vocab(freq: DataFrame, size: int = DEFAULT_VOCAB_SIZE, coverage: float = CHARACTER_COVERAGE) -> DataFrame:
    """(token, id, left, right, freq): merged pieces in the order in which they were made, then the covered characters by falling count.

    Ids follow the special and byte tokens; ``size`` counts all of them. A piece that two pairs make has the id of the first.
    ``freq`` is the pair's count when it was merged, or the character's.
    """
    characters = char_coverage(char_freq(freq), coverage).orderBy(F.desc("freq"), "char").limit(max(0, size - FIRST_PIECE_ID)).collect()
    covered = frozenset(r.char for r in characters)
    merges = train(freq, covered, size - FIRST_PIECE_ID - len(covered))
    rows, seen = [], set(covered)
    for left, right, n in merges:
        if left + right not in seen:
            seen.add(left + right)
            rows.append((left + right, FIRST_PIECE_ID + len(rows), left, right, n))
    rows += [(r.char, FIRST_PIECE_ID + len(rows) + k, None, None, r.freq) for k, r in enumerate(characters)]
    return freq.sparkSession.createDataFrame(rows, "token string, id int, left string, right string, freq long")


def join_pieces(word: str, rank: dict[str, int]) -> list[str]:
    """The pieces of a word: of two neighbours that spell a ranked piece together, the best ranked and leftmost are joined until none is left.

    In a long word neighbours are a linked list and joins wait in a heap, so the cost is n log n for n characters.
    """
    if len(word) <= SHORT:
        return _join_short(word, rank)
    parts: list[str | None] = list(word)
    before, after = [k - 1 for k in range(len(parts))], [*range(1, len(parts)), -1]
    waiting: list[tuple[int, int, str]] = []

    def offer(k: int) -> None:
        if k >= 0 and after[k] >= 0:
            both = parts[k] + parts[after[k]]
            if both in rank:
                heapq.heappush(waiting, (rank[both], k, both))

    for k in range(len(parts)):
        offer(k)
    while waiting:
        _, k, both = heapq.heappop(waiting)
        if parts[k] is None or after[k] < 0 or parts[k] + parts[after[k]] != both:
            continue  # one side was joined elsewhere
        gone = after[k]
        parts[k], parts[gone], after[k] = both, None, after[gone]
        if after[k] >= 0:
            before[after[k]] = k
        offer(before[k])
        offer(k)
    return [p for p in parts if p is not None]


def _join_short(word: str, rank: dict[str, int]) -> list[str]:
    parts, never = list(word), 1 << 62
    near = [rank.get(a + b, never) for a, b in zip(parts, parts[1:])]
    while near and (best := min(near)) != never:
        k = near.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        del near[k]
        for i in (k - 1, k):
            if 0 <= i < len(near):
                near[i] = rank.get(parts[i] + parts[i + 1], never)
    return parts


def merge_vocab_encoder(vocab: DataFrame, most: int = 1 << 21) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of distinct pieces of text by a merge vocabulary (token, id, left): joins by rank, bytes for what it does not hold.

    The vocabulary is sent to every task; one of more than ``most`` entries is refused. The pieces of an Arrow batch are joined
    together. Of a list's pieces a worker keeps the ids of those it met last, KEPT to twice as many, so that frequent ones are joined once.
    """
    rows = vocab.select("token", "id", F.col("left").isNotNull().alias("made")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary may have {most} entries at most")
    rank = {r.token: r.id for r in rows if r.made}
    pieces = sorted((p for p in rank if len(p) > 1), key=rank.get)
    number = {p: FIRST + k for k, p in enumerate(pieces)}
    # every two symbols that spell a piece
    pairs = {(a, b): k for k, p in enumerate(pieces) for cut in range(1, len(p)) if (a := _number(p[:cut], number)) and (b := _number(p[cut:], number))}
    ranks = _Lookup(_packed([*pairs]), np.array([*pairs.values()], np.int32))
    return _MergeEncoder(vocab.sparkSession.sparkContext.broadcast(({r.token: r.id for r in rows}, rank, [{}, {}], pieces, ranks, {})))


class _MergeEncoder:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, found: list[str]) -> list[list[int]]:
        ids, rank, kept, _, _, _ = self.shared.value
        out = []
        for word in found:
            own = kept[0].get(word)
            if own is None:
                own = kept[1].get(word)
                if own is None:
                    own = [i for p in join_pieces(word, rank) for i in ([ids[p]] if p in ids else byte_ids(p))]
                if len(word) <= SHORT:
                    if len(kept[0]) >= KEPT:
                        kept[:] = [{}, kept[0]]
                    kept[0][word] = own
            out.append(own)
        return out

    def arrow(self, found: pa.Array) -> pa.ListArray:
        """The ids of all pieces of a batch: those of up to SHORT characters are joined together, step by step."""
        short = pc.less_equal(pc.utf8_length(found), SHORT)
        own = found.filter(short)
        lists = [self._short(own.slice(k, TOGETHER)) for k in range(0, len(own), TOGETHER)]
        if len(own) == len(found):
            return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))
        is_short = short.to_numpy(zero_copy_only=False)
        place = np.where(is_short, np.cumsum(is_short) - 1, len(own) + np.cumsum(~is_short) - 1)
        return pa.concat_arrays([*lists, pa.array(self(found.filter(pc.invert(short)).to_pylist()), pa.list_(pa.int32()))]).take(pa.array(place))

    def _short(self, found: pa.Array) -> pa.ListArray:
        _, _, _, pieces, ranks, _ = self.shared.value
        made = np.arange(FIRST, FIRST + len(pieces), dtype=np.int32)
        symbols, word = _joined(_characters(found)[0], np.arange(len(found)), ranks, made, once=True)
        ends = symbols == 0
        coded = pa.array(symbols[~ends]).dictionary_encode()
        each = pa.array([self._of_symbol(k) for k in coded.dictionary.to_pylist()], pa.list_(pa.int32())).take(coded.indices)
        bounds = np.append(0, np.flatnonzero(ends) - np.arange(len(found)))
        joined = pa.ListArray.from_arrays(each.offsets.take(pa.array(bounds)).cast(pa.int32()), each.values)
        return joined.take(pa.array(np.argsort(word)))

    def _of_symbol(self, number: int) -> list[int]:
        ids, _, _, pieces, _, known = self.shared.value
        own = known.get(number)
        if own is None:
            text = chr(number - 1) if number < FIRST else pieces[number - FIRST]
            own = known[number] = [ids[text]] if text in ids else byte_ids(text)
        return own


def _number(text: str, pieces: dict[str, int]) -> int | None:
    """The number of a symbol: that of a character, or of a piece among ``pieces``."""
    return ord(text) + 1 if len(text) == 1 else pieces.get(text)

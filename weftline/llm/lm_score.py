"""Cross-entropy difference: a target and a background bigram model with one vocabulary score each document.

Both models are counted over the whole corpus: the background over every document, the target over the documents that a
table of ids names. They share the vocabulary (all words that occur ``least`` times; the others are one unknown word) and
the smoothing, so a token's two losses differ by the counts alone. For model M

    unigram(w) = (c(w) + 1) / (N + |vocabulary| + 1)
    p(w | v) = (c(v, w) + mu * unigram(w)) / (c(v as context) + mu)

and a document's score is the mean over its tokens of target loss minus background loss in nats: lower is nearer to the
target. The counts grow with the corpus and are whole: no task and not the driver holds all of them.

Texts are read once, into blocks of about ``BLOCK_BYTES``: the block's distinct words (64-bit hashes) and each token's
place among them. A block asks for the counts of its distinct words, then, with rare words made one, for those of its
distinct bigrams (64-bit hashes of both words). Questions are dealt over parts of the hash range, as many as keep a part
near ``PART_KEYS`` keys; within a part they are sorted, so that the answer is the sums in the same order, without keys.
A block names a key once however often it holds it, so that no key is hot. Losses are then added up inside the block.

A text without words has no tokens and null losses. With no target documents all target counts are 0. Rows that repeat an
id are scored, and counted, each by itself; a null id is never a target. Other columns take no part. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import STEP_BYTES, constants, mix, only, partitions_for, raw_texts, steps, word_hashes
from weftline.session import written

#: The predecessor of a document's first word, and the word that stands for all rare ones; no word has these hashes.
START, UNKNOWN = 0, (1 << 64) - 1

#: Bytes of text and rows that make a block; a longer text makes a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 23, 1 << 17

#: Keys that one part of the hash range is meant to hold.
PART_KEYS = 1 << 20

_BLOCK = "block long, ids array<long>, counts array<int>, vocabulary binary, tokens binary"
_ASKED = "block long, part long, keys binary, values array<binary>"
_TOLD = "block long, part long, values array<binary>"
#: The part number of the row that holds a part's sums over its words, and of the row that holds a block's target rows.
_SUMS, _TARGETS = -1, -2


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes: small ones and small differences take little room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _row(values: list, types: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    fields = [f.split(" ") for f in types.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)], [n for n, _ in fields])


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block; its number is the task's and a running one, fixed once the blocks are written."""
    task, number, ids, hashes, counts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

    def block() -> pa.RecordBatch:
        words = np.concatenate(hashes)
        words[words == START] = 1
        words[words == UNKNOWN] = UNKNOWN - 1
        vocabulary, tokens = np.unique(words, return_inverse=True)
        return _row([task << 32 | number, ids, np.concatenate(counts), pack(np.diff(vocabulary, prepend=np.uint64(0))), pack(tokens)], _BLOCK)

    for part in parts:
        texts, own = raw_texts(part.column(1)), part.column(0).to_pylist()
        for a, b in steps(texts, min(STEP_BYTES, BLOCK_BYTES)):
            step = sum(map(len, texts[a:b]))
            if ids and (size + step > BLOCK_BYTES or len(ids) + b - a > BLOCK_ROWS):
                yield block()
                number, ids, hashes, counts, size = number + 1, [], [], [], 0
            words, n = word_hashes(texts[a:b])
            ids, size = ids + own[a:b], size + step
            hashes.append(words)
            counts.append(n)
    if ids:
        yield block()


class Block:
    """A block as arrays: local vocabulary, each token's place in it, that of its predecessor (-1: none), its row."""

    def __init__(self, row: dict):
        self.number, self.ids, self.counts = row["block"], row["ids"], np.array(row["counts"], np.int64)
        self.words = np.cumsum(unpack(row["vocabulary"]), dtype=np.uint64)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.before = np.concatenate(([-1], self.tokens[:-1])) if len(self.tokens) else self.tokens
        self.before[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = -1
        self.rows = np.repeat(np.arange(len(self.ids)), self.counts)
        self.told = {t["part"]: t["values"] for t in row.get("word_facts") or []}

    def targets(self) -> np.ndarray:
        """Which tokens belong to rows of the target."""
        flags = np.zeros(len(self.ids), bool)
        if _TARGETS in self.told:
            flags[unpack(self.told[_TARGETS][0]).astype(np.int64)] = True
        return flags[self.rows]

    def bigrams(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the bigrams, rare words made one, and each token's place among them."""
        known = np.concatenate(([True], self.facts(self.told)[0][1:] >= least))
        names = np.where(known, np.concatenate(([np.uint64(START)], self.words)), np.uint64(UNKNOWN))
        weights = constants(7, 2)
        return np.unique(mix(names[self.before + 1] * weights[0] + names[self.tokens + 1] * weights[1]), return_inverse=True)

    @staticmethod
    def facts(told: dict) -> list[np.ndarray]:
        """The answers of all parts in the order of the keys."""
        parts = [told[p] for p in sorted(told) if p >= 0]
        return [np.concatenate([unpack(p[i]) for p in parts]) for i in range(len(parts[0]))]


def _each(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def _asked(block: int, keys: np.ndarray, values: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """The sorted keys and their counts, by part of the hash range."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(starts, np.append(starts[1:], len(keys))):
        yield _row([block, int(part[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0))), [pack(v[a:b]) for v in values]], _ASKED)


def _ask_words(parts: int):
    """Of each word of a block, and of the start: tokens and contexts of the background, then of the target."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            if len(block.tokens):
                size, target = len(block.words) + 1, block.targets()
                values = [np.bincount(at[of] + 1, minlength=size) for of in (slice(None), target) for at in (block.tokens, block.before)]
                yield from _asked(block.number, np.concatenate(([np.uint64(START)], block.words)), values, parts)

    return ask


def _ask_bigrams(parts: int, least: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            if len(block.tokens):
                keys, at = block.bigrams(least)
                yield from _asked(block.number, keys, [np.bincount(at[of], minlength=len(keys)) for of in (slice(None), block.targets())], parts)

    return ask


def _tell(least: int | None):
    """Sums over all blocks for each block's keys, in their order; with ``least`` also the part's sums over its words."""

    def tell(table: pa.Table) -> pa.Table:
        rows = table.to_batches()
        part = table["part"][0].as_py()
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in table["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        values = table["values"].to_pylist()
        del rows, keys
        sums = [np.bincount(at, np.concatenate([unpack(v[i]) for v in values]), len(distinct)).astype(np.uint64) for i in range(len(values[0]))]
        out = [_row([block, part, [pack(s[at[a:b]]) for s in sums]], _TOLD) for block, a, b in zip(table["block"].to_pylist(), np.append(0, ends[:-1]), ends)]
        if least is not None:
            word, rare = distinct != START, (distinct != START) & (sums[0] < least)
            of_part = [np.count_nonzero(word & ~rare), sums[0].sum(), sums[2].sum(), *(s[rare].sum() for s in sums)]
            out.append(_row([part, _SUMS, [int(x).to_bytes(8, "big") for x in of_part]], _TOLD))
        return pa.Table.from_batches(out)

    return tell


def _target_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(parts):
        yield _row([row["block"], _TARGETS, [pack(np.array(row["at"], np.int64))]], _TOLD)


def _score(least: int, mu: float, whole: list[int]):
    """``whole``: words of the vocabulary, tokens of both models, then the rare words' tokens and contexts."""
    known, *tokens = whole[:3]
    rare = whole[3:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            n = len(block.ids)
            losses = np.zeros((2, n))
            if len(block.tokens):
                words = block.facts(block.told)
                unseen = words[0] < least
                unseen[0] = False
                _, at = block.bigrams(least)
                pairs = block.facts({t["part"]: t["values"] for t in row["bigram_facts"]})
                for m in range(2):
                    word, context = (np.where(unseen, rare[2 * m + i], words[2 * m + i]).astype(float) for i in (0, 1))
                    unigram = (word + 1) / (tokens[m] + known + 1)
                    p = (pairs[m][at] + mu * unigram[block.tokens + 1]) / (context[block.before + 1] + mu)
                    losses[m] = np.bincount(block.rows, -np.log(p), n)
            with np.errstate(invalid="ignore", divide="ignore"):
                background, target = losses / block.counts
            columns = [pa.array(x, pa.float64(), mask=block.counts == 0) for x in (target, background, target - background)]
            out = [pa.array(block.ids, pa.int64()), pa.array(block.counts), *columns]
            yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "target_loss", "background_loss", "score"])

    return score


def _by_block(facts: DataFrame, name: str) -> DataFrame:
    """All answers to a block in one row: no more than the block asked for."""
    return facts.groupBy("block").agg(F.collect_list(F.struct("part", "values")).alias(name))


def score_corpus(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, mu: float = 10.0) -> DataFrame:
    """Count both models over the rows of docs; their id, n_tokens, target_loss, background_loss (means over tokens) and score, the difference.

    ``target_ids`` has a column of the id's name.
    """
    texts = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = written(texts.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    total = blocks.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0]
    parts = partitions_for(total or 0, PART_KEYS)

    target = target_ids.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    places = blocks.select("block", F.posexplode("ids").alias("at", "id")).join(target.hint("merge"), "id", "left_semi")
    marked = places.groupBy("block").agg(F.collect_list("at").alias("at")).mapInArrow(_target_rows, _TOLD)  # at most BLOCK_ROWS a block
    marked = written(marked, "lm-targets")

    asked = blocks.join(_by_block(marked, "word_facts").hint("merge"), "block", "left").mapInArrow(_ask_words(parts), _ASKED)
    told = written(asked.groupBy("part").applyInArrow(_tell(least), _TOLD), "lm-words")
    number = [F.sum(F.conv(F.hex(F.col("values")[i]), 16, 10).cast("long")).alias(f"v{i}") for i in range(7)]
    whole = [x or 0 for x in told.filter(F.col("part") == _SUMS).agg(*number).first()]
    words = _by_block(told.filter(F.col("part") >= 0).unionByName(marked), "word_facts").hint("merge")

    asked = blocks.join(words, "block", "left").mapInArrow(_ask_bigrams(parts, least), _ASKED)
    bigrams = written(asked.groupBy("part").applyInArrow(_tell(None), _TOLD), "lm-bigrams")
    met = blocks.join(words, "block", "left").join(_by_block(bigrams, "bigram_facts").hint("merge"), "block", "left")
    scored = met.mapInArrow(_score(least, mu, whole), "id long, n_tokens long, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", id_col)

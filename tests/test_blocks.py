"""Round 4: words trained and joined by whole blocks, against the same word by word; merges of a whole vocabulary."""

import collections
import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.functions.constants import FIRST_PIECE_ID
from weftline.operators import bpe, encode, merges, vocab
from weftline.plans import registry

SF = "/root/testdata/sf0.001"
LETTERS = "aaabé▁𝒳"


def invented(seed, letters=LETTERS, n=300, longest=14):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))): rng.choice([1, 1, 2, 3, 50]) for _ in range(n)}


def batches(freq, size=40):
    rows = [*freq.items()]
    return [pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["token", "freq"]) for k in range(0, len(rows), size) if (part := rows[k : k + size])]


def words_of(symbols, freq, names):
    """Counts of the words of a block, as tuples of text."""
    found, at = collections.Counter(), 0
    for end, n in zip(np.flatnonzero(symbols == 0).tolist(), freq.tolist(), strict=True):
        found[tuple(names[k] for k in symbols[at:end].tolist())] += n
        at = end + 1
    return found


def parts(symbols, n, found):
    """Adds the parts of a word with two symbols or more that hold no empty one."""
    part = []
    for symbol in [*symbols, ""]:
        if symbol:
            part.append(symbol)
        else:
            if len(part) > 1:
                found[tuple(part)] += n
            part = []


@pytest.mark.parametrize("covered", [None, frozenset("abé▁")])
def test_blocks_hold_the_words(monkeypatch, covered):
    """spelling, pairs, runs and merges of blocks are those of single words."""
    monkeypatch.setattr(merges, "BLOCK", 500)
    freq, want = invented(1), collections.Counter()
    for word, n in freq.items():
        parts([c if covered is None or c in covered else "" for c in word], n, want)
    rows = [*merges._spell(covered)(iter(b.slice(k, 9) for b in batches(freq) for k in range(0, len(b), 9)))]
    blocks, names = [*merges._blocks(rows)], merges._Names()
    assert len(blocks) > 2 and sum((words_of(*b, names) for b in blocks), collections.Counter()) == want

    pairs = collections.Counter()
    for word, n in want.items():
        for pair in zip(word, word[1:]):
            pairs[pair] += n
    got = collections.Counter()
    for block in merges._count(iter(rows)):
        for r in block.to_pylist():
            got[names[r["pair"] >> 32], names[r["pair"] & 0xFFFFFFFF]] += r["freq"]
    assert got == pairs

    ranked = [("a", "a"), ("a", "b"), ("aa", "a"), ("b", "ab"), ("é", "aa"), ("aa", "aa")]
    names.update({merges.FIRST + k: a + b for k, (a, b) in enumerate(ranked)})
    ids = {p: k for k, p in names.items()}
    number = lambda p: ids.get(p) or ord(p) + 1
    packed, made = merges._packed([(number(a), number(b)) for a, b in ranked]), np.arange(merges.FIRST, merges.FIRST + len(ranked), dtype=np.int32)
    merged, runs = collections.Counter(), collections.Counter()
    for word, n in want.items():
        parts(merges.merge_by_rank([*word], {pair: k for k, pair in enumerate(ranked)}), n, merged)
        run = [word[0]]
        for pair in zip(word, word[1:]):
            if pair not in ranked:
                runs[tuple(run)] += n
                run = []
            run = [*(run or pair[:1]), pair[1]] if pair in ranked else [pair[1]]
        runs[tuple(run)] += n
    assert sum((words_of(*b, names) for b in merges._blocks(merges._merge(packed, made)(iter(rows)))), collections.Counter()) == merged
    got = collections.Counter()
    for block in merges._cut(packed)(iter(rows)):
        for r in block.to_pylist():
            got[tuple(names[k] for k in np.frombuffer(r["run"], np.int32).tolist())] += r["freq"]
    assert got == {run: n for run, n in runs.items() if len(run) > 1}


def test_pieces_of_a_batch_are_joined_together(spark, monkeypatch):
    """no piece of a batch is joined by itself, except long ones; the ids are those of single joins."""
    vocabulary = [("aa", 260, "a", "a"), ("ab", 261, "a", "b"), ("aab", 262, "aa", "b"), ("▁aa", 263, "▁", "aa"), ("aaa", 264, "a", "aa"), ("a", 265, None, None), ("▁", 266, None, None)]
    encoder = merges.merge_vocab_encoder(spark.createDataFrame(vocabulary, "token string, id int, left string, right string"))
    words = [*invented(2, n=2000, longest=merges.SHORT), "", "𝒳", "a" * merges.SHORT, "ab" * merges.SHORT]
    texts, pieces = ["ab aab  a1b22", None, "", "é"], [["▁ab", "▁aab", "▁a", "1", "b", "2", "2"], [], [], ["▁é"]]
    want, of_texts = encoder(words), [[i for ids in encoder(own) for i in ids] for own in pieces]
    joins, plain = [], merges.join_pieces
    monkeypatch.setattr(merges, "join_pieces", lambda word, rank: joins.append(word) or plain(word, rank))
    assert encode._encode_texts(pa.array(texts, pa.string()), encoder).to_pylist() == of_texts
    assert encoder.arrow(pa.array(["x", *words], pa.string()).slice(1)).to_pylist() == want and joins == words[-1:]
    assert encoder.arrow(pa.array([], pa.string())).to_pylist() == []


def one_by_one(freq, most):
    """Merges with ties by symbols, a pair at a time: only the words that hold the pair are counted again."""
    words, counts, where, done = [(list(w), n) for w, n in freq.items()], collections.Counter(), collections.defaultdict(set), []

    def count(k, sign):
        for pair in zip(words[k][0], words[k][0][1:]):
            counts[pair] += sign * words[k][1]
            where[pair].add(k)
            waiting.add(pair)

    heap, waiting = [], set()
    for k in range(len(words)):
        count(k, 1)
    while len(done) < most:
        for pair in waiting:
            heapq.heappush(heap, (-counts[pair], pair))
        waiting.clear()
        while heap and -heap[0][0] != counts[heap[0][1]]:
            heapq.heappop(heap)
        if not heap or not heap[0][0]:
            break
        left, right = heap[0][1]
        done.append((left, right, counts[left, right]))
        for k in where.pop((left, right)):
            count(k, -1)
            symbols, out = words[k][0], []
            for symbol in symbols:
                if out and symbol == right and out[-1] == (left, False):
                    out[-1] = (left + right, True)
                else:
                    out.append((symbol, False))
            words[k] = [s for s, _ in out], words[k][1]
            count(k, 1)
    return done


def test_merges_of_a_whole_vocabulary(spark):
    """as many merges as a vocabulary of the default size has room for, each the one that training one by one makes."""
    freq = {r.token: r.freq for r in registry.word_freq(spark, SF).collect()}
    room = vocab.DEFAULT_VOCAB_SIZE - FIRST_PIECE_ID - len(set("".join(freq)))
    got = [tuple(r) for r in registry.bpe_merges(spark, SF).orderBy("rank").collect()]
    assert len(got) == room > 30000
    assert got == [(k, *merge) for k, merge in enumerate(one_by_one(freq, room))]


@pytest.mark.parametrize(("candidates", "runs", "ties"), [(2, 3, 4), (8, 1, 1), (3, 1000, 2)])
def test_ties_by_symbols_that_are_too_many(spark, monkeypatch, candidates, runs, ties):
    """rounds that cannot hold all equally frequent pairs give the same merges."""
    for name, value in (("FIRST_CANDIDATES", candidates), ("CANDIDATES", 2 * candidates), ("RUNS", runs), ("TIES", ties)):
        monkeypatch.setattr(merges, name, value)
    freq = {w: n for w, n in invented(3, "zyxcba", 40, 5).items() if n < 3}
    df = spark.createDataFrame([*freq.items()], "token string, freq long").repartition(2)
    got = [tuple(r)[1:] for r in bpe.train_merges(df, 20).orderBy("rank").collect()]
    assert got == one_by_one(freq, 20)

"""Merge training in rounds against training one by one, and encoding against plain joins."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.constants import FIRST_PIECE_ID
from weftline.operators import encode, merges, vocab
from weftline.plans import derived, registry

SF = "/root/testdata/sf0.001"


def one_by_one(freq, covered, pieces):
    """Counts all pairs of all words again for every merge."""
    words = {w: ([c if c in covered else None for c in w], n) for w, n in freq.items()}
    done, made = [], set()
    while len(made) < pieces:
        counts = collections.Counter()
        for symbols, n in words.values():
            for a, b in zip(symbols, symbols[1:]):
                if a and b:
                    counts[a, b] += n
        if not counts:
            break
        left, right = min(counts, key=lambda p: (-counts[p], len(p[0] + p[1]), p[0] + p[1], p[0]))
        done.append((left, right, counts[left, right]))
        if left + right not in covered:
            made.add(left + right)
        for w, (symbols, n) in words.items():
            out, k = [], 0
            while k < len(symbols):
                if symbols[k] == left and symbols[k + 1 : k + 2] == [right]:
                    out.append(left + right)
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            words[w] = out, n
    return done


def table(spark, freq):
    return spark.createDataFrame([*freq.items()], "token string, freq long").repartition(2)


def invented(seed, letters="ab", n=60, longest=12):
    rng = random.Random(seed)
    return {"▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, longest))): rng.choice([1, 1, 2, 3, 50]) for _ in range(n)}


@pytest.mark.parametrize(("seed", "letters", "candidates", "runs"), [(1, "ab", 256, 1 << 19), (2, "aab", 4, 1 << 19), (3, "abc", 8, 1 << 19), (4, "abcdeé", 16, 12), (5, "a", 2, 1)])
def test_rounds_equal_one_by_one(spark, monkeypatch, seed, letters, candidates, runs):
    """Two or three letters give many ties, overlapping pairs and pieces that several pairs make."""
    for name, value in (("FIRST_CANDIDATES", candidates), ("CANDIDATES", 2 * candidates), ("RUNS", runs)):
        monkeypatch.setattr(merges, name, value)
    freq = invented(seed, letters)
    covered = frozenset("".join(freq)) - {"e"}
    assert merges.train(table(spark, freq), covered, 24) == one_by_one(freq, covered, 24)


def test_trains_to_the_end(spark):
    freq = invented(6, "abcd", 25, 6)
    covered = frozenset("".join(freq))
    got = merges.train(table(spark, freq), covered, 10**6)
    assert got == one_by_one(freq, covered, 10**6) and len(got) > 40


def test_whole_corpus_500_merges(spark):
    freq = {r.token: r.freq for r in vocab.word_freq(derived.documents(spark, SF)).orderBy(F.desc("freq"), "token").limit(1500).collect()}
    covered = frozenset("".join(freq))
    assert merges.train(table(spark, freq), covered, 500) == one_by_one(freq, covered, 500)


def test_no_words(spark):
    empty = spark.createDataFrame([], "token string, freq long")
    assert merges.train(empty, frozenset(), 10) == [] and merges.merge_vocab(empty, 300).count() == 0
    nulls = spark.createDataFrame([(None, 3), ("", 2), ("a", 5)], "token string, freq long")
    assert merges.train(nulls, frozenset("a"), 10) == []


def joined(word, ids, ranks):
    """Joins by rank, looking through the whole word each time."""
    parts = list(word)
    while True:
        known = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return [i for p in parts for i in ([ids[p]] if p in ids else encode.byte_ids(p))]
        _, k = min(known)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_encoder_equals_plain_joins(spark):
    freq = invented(8, "aabc", 80, 10)
    table_ = merges.merge_vocab(table(spark, freq), FIRST_PIECE_ID + 40).collect()
    ids, ranks = {r.token: r.id for r in table_}, {r.token: r.id for r in table_ if r.left is not None}
    assert len(ids) == 40 and sorted(ids.values()) == [*range(FIRST_PIECE_ID, FIRST_PIECE_ID + 40)]
    rng = random.Random(9)
    words = ["", "a", "ü", "▁", *["".join(rng.choice("aabc▁ü") for _ in range(rng.randint(1, 30))) for _ in range(400)], "ab" * 3000]
    encoder = merges.merge_vocab_encoder(spark.createDataFrame(table_, "token string, id int, left string, right string, freq long"))
    assert encoder(words) == [joined(w, ids, ranks) for w in words]
    with pytest.raises(ValueError, match="at most"):
        merges.merge_vocab_encoder(spark.createDataFrame(table_), most=3)


def test_queries(spark):
    """The registered vocabulary is whole, and every document's ids spell its pieces."""
    rows = registry.bpe_vocab(spark, SF).collect()
    ids, ranks = {r.token: r.id for r in rows}, {r.token: r.id for r in rows if r.left is not None}
    assert len(rows) == len(ids) == vocab.DEFAULT_VOCAB_SIZE - FIRST_PIECE_ID
    assert all(r.left + r.right == r.token for r in rows if r.left is not None)
    from weftline.functions.text import pieces

    docs = derived.documents(spark, SF).select("doc_id", pieces(F.col("text")).alias("p")).collect()
    got = {r.doc_id: r for r in registry.encode_bpe(spark, SF).collect()}
    assert len(got) == len(docs)
    known = {}
    for d in docs:
        want = [i for p in d.p for i in known.setdefault(p, joined(p, ids, ranks))]
        assert got[d.doc_id].len == len(want) and got[d.doc_id].ids == ",".join(map(str, want))

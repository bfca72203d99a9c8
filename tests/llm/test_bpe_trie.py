"""Encoding by trie states against the library, and decoding from the ids alone."""

import hashlib
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftline.llm import bpe_trie, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["<|endoftext|>", "the", " the", "ing", "aaaa", "    ", "\n\n", "----", "====", "՘", "😀", "ﬁ", "ⅷ", "'s", "'ll", " ", "  ", " \n", "\t", "\x1c", "\xa0", "²", "é", "1", "!"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe_trie.Trie(PATH)


def texts(own, n=3000):
    rng = random.Random(7)
    tokens = [s.decode("utf-8", "ignore") for s in own.ids]
    pick = [lambda: rng.choice(BITS), lambda: rng.choice(tokens), lambda: rng.choice("aabest .,")]
    out = ["".join(rng.choice(pick)() for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*out, "", " ", "  ", "a  ", "   a", "\n a", "a \n b", "a" * 20000, "x1" * 5000, "long words " * 9000]


def test_ids_and_texts(own, library):
    given = texts(own)
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [ids.tolist() for ids in own.encode_texts(given)] == want
    assert [own.decode(ids) for ids in want] == [library.decode(ids, skip_special_tokens=False) for ids in want] == given


def test_decode_any_ids(own, library):
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([]) == "" and own.decode([10**6]) == ""


def test_plain_code_points_are_cut_alike(library):
    for point in [*range(0x558), *range(0x2010, 0x2028), 0x20AC]:
        c = chr(point)
        text = f"a{c}b1{c}2{c}{c}x{c} {c}'s{c}"
        assert bpe_trie.PLAIN(text)
        assert bpe_trie.WORDS(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(point)


def test_shared_prefixes_are_computed_once(own):
    words = [b" trans" + end for end in (b"", b"port", b"ports", b"ported", b"late", b"lation")]
    before = own.states
    found = own.encode_words(words)
    assert own.states - before == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert set(found) == set(words)


def test_small_steps_and_bounds(own, monkeypatch):
    given = texts(own, 300)
    want = [ids.tolist() for ids in own.encode_texts(given)]
    fresh = bpe_trie.Trie(PATH)
    for name, value in (("STEP", 50), ("KEPT", 20), ("KEPT_PAIRS", 10)):
        monkeypatch.setattr(bpe_trie, name, value)
    assert [ids.tolist() for ids in fresh.encode_texts(given)] == want
    assert len(fresh.pieces) <= 20 and len(fresh.known) <= 20 and len(fresh.pairs) <= 10


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="only"):
        bpe_trie.Trie(public_tokenizers.path("word_bpe_49k.json"))


def test_frames(spark, own, library):
    given = [*texts(own, 200), None, None]
    rows = [(None if k % 50 == 3 else (1 << 60) + k // 2, t, "clash", 1) for k, t in enumerate(given)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(4)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = {t: library.encode(t, add_special_tokens=False).ids for t in {t or "" for t in given}}
    want = [(i, len(ids[t or ""]), sha(",".join(map(str, ids[t or ""]))), sha(t or "")) for i, t, *_ in rows]
    assert sorted(map(tuple, bpe_trie.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    encoded = bpe_trie.encode_texts(docs, PATH)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == sorted(((i, ids[t or ""]) for i, t, *_ in rows), key=str)
    decoded = bpe_trie.decode_ids(encoded, PATH)
    assert sorted(map(tuple, decoded.collect()), key=str) == sorted(((i, t or "") for i, t, *_ in rows), key=str)
    none = docs.limit(0)
    assert bpe_trie.round_trip(none, PATH).count() == bpe_trie.decode_ids(bpe_trie.encode_texts(none, PATH), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet")).collect()
    got = {r.doc_id: r for r in queries.op13_bpe_trie(spark, folder).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), text)]
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (len(ids), *hashes)

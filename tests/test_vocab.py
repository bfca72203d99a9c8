import random
from collections import Counter

from conftest import rows
from pyspark.sql import functions as F

from weftline.operators import bpe, encode, index, vocab
from weftline.plans import derived


def train_one_by_one(words, merges):
    words = {w: list(w) for w in words}, dict(words)
    symbols, freq = words
    out = []
    for _ in range(merges):
        counts = Counter()
        for w, s in symbols.items():
            for pair in zip(s, s[1:]):
                counts[pair] += freq[w]
        if not counts:
            break
        (left, right), n = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        out.append((left, right, n))
        for w, s in symbols.items():
            joined, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (left, right):
                    joined.append(left + right)
                    i += 2
                else:
                    joined.append(s[i])
                    i += 1
            symbols[w] = joined
    return out


def test_merges_equal_one_by_one_training(spark):
    rng = random.Random(11)
    words = {}
    while len(words) < 120:
        words["▁" + "".join(rng.choice("aabcde.$") for _ in range(rng.randrange(1, 8)))] = rng.choice([1, 1, 2, 3, 9, 40])
    df = spark.createDataFrame(list(words.items()), "token string, freq long")
    got = [(r["left"], r["right"], r["freq"]) for r in bpe.train_merges(df, 18).orderBy("rank").collect()]
    assert got == train_one_by_one(words, 18)


def test_repeated_symbols(spark):
    df = spark.createDataFrame([("aaaa", 3), ("aaa", 2)], "token string, freq long")
    got = [(r["left"], r["right"], r["freq"]) for r in bpe.train_merges(df, 10).orderBy("rank").collect()]
    assert got == train_one_by_one({"aaaa": 3, "aaa": 2}, 10)


def test_independent_pairs_stop_before_a_tie_with_the_conflict():
    ranked = [("a", "b", 9), ("c", "d", 7), ("b", "e", 7), ("f", "g", 6)]
    assert bpe._independent(ranked, 10) == [("a", "b", 9)]
    assert bpe._independent([("a", "b", 9), ("c", "d", 8), ("b", "e", 7)], 10) == [("a", "b", 9), ("c", "d", 8)]
    assert bpe._independent([("a", "a", 9), ("c", "d", 8)], 10) == [("a", "a", 9)]


def test_independent_pairs_may_share_a_side():
    assert bpe._independent([("a", "b", 9), ("a", "c", 8), ("d", "b", 7), ("b", "e", 6)], 10) == [("a", "b", 9), ("a", "c", 8), ("d", "b", 7)]
    # a second way to spell a symbol adds to the pairs of that symbol
    assert bpe._independent([("d", "e", 9), ("ab", "c", 8), ("f", "g", 7)], 10, {"abc"}) == [("d", "e", 9)]
    assert bpe._independent([("ab", "c", 8), ("f", "g", 7)], 10, {"abc"}) == [("ab", "c", 8)]
    assert bpe._independent([("a", "bc", 9), ("ab", "c", 8), ("f", "g", 7)], 10) == [("a", "bc", 9)]


def test_merges_until_every_word_is_one_symbol(spark):
    rng = random.Random(5)
    words = {"▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): rng.choice([1, 1, 2, 5]) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "token string, freq long")
    got = [(r["left"], r["right"], r["freq"]) for r in bpe.train_merges(df, 10**6).orderBy("rank").collect()]
    assert got == train_one_by_one(words, 10**6)


def test_char_coverage(spark):
    df = spark.createDataFrame([("aaab", 10), ("bc", 5), ("d", 1)], "token string, freq long")
    chars = vocab.char_freq(df)
    assert rows(chars) == [("a", 30), ("b", 15), ("c", 5), ("d", 1)]
    assert [r["char"] for r in vocab.char_coverage(chars, 0.9).orderBy("char").collect()] == ["a", "b", "c"]
    assert vocab.char_coverage(chars, 1.0).count() == 4


def test_training_text_limit(spark):
    df = spark.createDataFrame([("é" * 5,), ("e" * 5,)], "text string")
    assert vocab.training_text(df, 9).count() == 1 and vocab.training_text(df, 10).count() == 2 and vocab.training_text(df, None).count() == 2


def test_vocab_diff(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "token string, id int")
    b = spark.createDataFrame([("x", 1), ("y", 5)], "token string, id int")
    assert tuple(vocab.vocab_diff(a, b).first()) == (3, 2, 2, 1, 1, False, True)
    assert tuple(vocab.vocab_diff(a, a).first()) == (3, 3, 3, 0, 3, True, True)
    full, ids = vocab.with_specials(a), {"<unk>": 0, "<s>": 1, "</s>": 2, "<pad>": 3}
    assert tuple(vocab.vocab_diff(full, vocab.with_specials(b)).first()) == (7, 6, 6, 1, 5, False, True)
    for other in ({**ids, "<pad>": 0}, {"<unk>": 0, "<s>": 1, "</s>": 2}):  # another id, and none on one side
        assert not vocab.vocab_diff(full, vocab.with_specials(a, other)).first()["special_equal"]


def test_encoding_and_byte_tokens(spark):
    words = spark.createDataFrame([("▁the", 260), ("▁cat", 261)], "token string, id int")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat é", "", "cat cat"] * 50)], "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: (r["ids"], r["len"]) for r in encode.encode_corpus(docs, encode.vocab_encoder(words)).collect()}
    mark = [4 + b for b in "▁é".encode()]
    assert out[0] == ([260, 261, *mark], 7) and out[1] == ([], 0) and out[2] == ([261, 261], 2) and len(out) == 150
    marked = encode.encode_corpus(docs, encode.vocab_encoder(words), prepend_bos=True, append_eos=True)
    assert marked.where("doc_id = 1").first()["ids"] == [1, 2]
    clipped = encode.encode_corpus(docs, encode.vocab_encoder(words), prepend_bos=True, clip=1)
    assert clipped.where("doc_id = 0").first()["ids"] == [260]


def test_merge_encoder_and_external_encoder(spark):
    merges = [("a", "b"), ("ab", "c"), ("▁", "abc")]
    ids = {"▁abc": 300, "ab": 301, "▁": 302, "c": 303}
    docs = spark.createDataFrame([(0, "abc cab abx")], "doc_id long, text string")
    out = encode.encode_corpus(docs, encode.merge_encoder(docs, merges, ids)).first()
    assert out["ids"] == [300, 302, 303, 301, 302, 301, 4 + ord("x")]
    external = encode.encode_external(docs, lambda texts: [[len(t)] for t in texts]).first()
    assert (external["ids"], external["len"]) == ([11], 1)


def test_offsets_rebuild_the_stream(spark):
    rng = random.Random(2)
    data = [(i * 7, rng.randrange(0, 9)) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, len int")
    offsets = index.doc_offsets(df)
    at = 0
    for n, r in enumerate(offsets.orderBy("doc_id").collect()):
        assert (r["doc_idx"], r["start"]) == (n, at)
        at += r["len"]
    good = index.offset_check(offsets).first()
    assert (good["docs"], good["tokens"], good["first_start"], good["gaps"], good["border_errors"]) == (300, at, 0, 0, 0)
    bad = index.offset_check(offsets.withColumn("start", F.col("start") + (F.col("doc_idx") > 10).cast("int"))).first()
    assert bad["gaps"] == 1


def test_manifest_width(spark):
    small = spark.range(100).select(F.col("id").cast("string").alias("token"))
    big = spark.range(65536 - 260 + 1).select(F.col("id").cast("string").alias("token"))
    facts = [vocab.manifest(v, "t", True, False, 1, 2).first()["data_dtype"] for v in (small, big)]
    assert facts == ["uint16", "uint32"]
    assert "val_clipped_data_file" not in vocab.manifest(small, "t", True, False, 1, 2).columns
    names = vocab.manifest(small, "t", True, False, 1, 2, clip=9).first()
    assert (names["train_index_file"], names["val_clipped_data_file"]) == ("train.offsets.parquet", "val-clipped-9.tokens.parquet")


def test_small_vocabulary_keeps_whole_texts(spark):
    """Byte tokens and pieces together spell every text."""
    sf = "/root/testdata/sf0.001"
    names = {r["id"]: r["token"].encode() for r in derived.corpus_vocab(spark, sf, derived.SMALL_VOCAB).collect()}
    texts = {r["doc_id"]: r["text"] for r in derived.documents(spark, sf).collect()}
    for r in derived.tokens(spark, sf).collect():
        spelt = b"".join(names[i] if i >= 260 else bytes([i - 4]) for i in r["ids"]).decode()
        assert spelt.replace("▁", "") == "".join(texts[r["doc_id"]].split())

"""Work of a task that does not follow its batch: words counted and encoded in slices, ids of pieces kept, ranks before encoding."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions.constants import WHITESPACE
from weftline.functions.text import pieces, slices, word_pieces, words
from weftline.llm import language_id
from weftline.operators import encode, merges, vocab
from weftline.plans import derived

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \t\n", "one two  two", " a1b22\u00a0x\u3000y\u200bz ", "7", "\x1f\x85é\u2028ü 3", "▁ 9▁", "\u200b", WHITESPACE.join("abc")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def table(spark):
    return spark.createDataFrame([(k, k % 3 or None, t) for k, t in enumerate(TEXTS * 2)], "doc_id long, slot int, text string").repartition(3)


def test_words_and_pieces_are_those_of_the_expression(spark):
    want = [r.p for r in table(spark).orderBy("doc_id").select(pieces(F.col("text")).alias("p")).collect()]
    for text, own in zip(TEXTS * 2, want):
        found = words(pa.array(["x", text], pa.string()).slice(1)).flatten()
        assert word_pieces(found).flatten().to_pylist() == (own or [])


def test_words_are_counted_in_the_tasks(spark):
    """words reach Spark as counts, not one row per word."""
    df = table(spark)
    assert "Generate" not in plan(vocab.word_freq(df))
    for keys in ([], ["slot"]):
        want = df.select(*keys, F.explode(pieces(F.col("text"))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("freq"))
        got = vocab.word_freq(df, keys)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_encoding_takes_a_batch_in_slices(spark):
    """F2, F3, F4, F7, F8, F9: 36 texts of 30,000 distinct words in one batch are not looked up together."""
    words_ = F.transform(F.sequence(F.lit(1), F.lit(30000)), lambda i: F.translate(F.hex(i + F.col("id") * 30000), "0123456789", "ghijklmnop"))
    df = spark.range(36, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws("abcdefgh ", words_).alias("text"))
    got = encode.encode_corpus(df, lambda found: [[len(found)] for _ in found]).select("len", F.array_max("ids").alias("most")).collect()
    assert [r.len for r in got] == [30000] * 36 and max(r.most for r in got) < 36 * 30000 / 2


def test_ids_of_the_vocabulary(spark):
    df = table(spark)
    small = vocab.build_vocab(vocab.word_freq(df), encode.FIRST_BYTE_ID + 256 + 3)
    ids = {r.token: r.id for r in small.collect()}
    found = {r.doc_id: r.p for r in df.select("doc_id", pieces(F.col("text")).alias("p")).collect()}
    got = encode.encode_corpus(df, encode.vocab_encoder(small)).collect()
    assert len(ids) == 3 and len(got) == len(found)
    for r in got:
        assert r.ids == [i for p in found[r.doc_id] or [] for i in ([ids[p]] if p in ids else encode.byte_ids(p))] and r.len == len(r.ids)


def test_slices():
    texts = pa.array(["a" * 10, None, "b" * 95, "c", "d" * 50, "e" * 49, ""], pa.string())
    got = [*slices(texts, 100)]
    assert [k for a, n in got for k in range(a, a + n)] == [*range(7)] and len(got) == 3
    assert [*slices(texts.slice(0, 0), 100)] == []


def test_pieces_are_joined_once(spark, monkeypatch):
    """a worker keeps the ids of pieces it met."""
    joins = []
    plain = merges.join_pieces
    monkeypatch.setattr(merges, "join_pieces", lambda word, rank: joins.append(word) or plain(word, rank))
    monkeypatch.setattr(merges, "KEPT", 2)
    rows = [("ab", 260, "a", "b"), ("abab", 261, "ab", "ab"), ("a", 262, None, None), ("b", 263, None, None)]
    encoder = merges.merge_vocab_encoder(spark.createDataFrame(rows, "token string, id int, left string, right string"))
    assert encoder(["ababa", "b"]) == encoder(["ababa", "b"]) == [[261, 262], [263]] and joins == ["ababa", "b"]
    assert encoder(["ba", "bb", "aa", "ababa"])[0] == [263, 262]
    long = "ab" * merges.SHORT
    assert plain(long, {"ab": 260, "abab": 261}) == ["abab"] * (merges.SHORT // 2) == plain(long[: merges.SHORT], {"ab": 260, "abab": 261}) * 2


def test_pairs_of_a_batch():
    """pairs are counted as numbers."""
    part = pa.RecordBatch.from_arrays([pa.array([["x"], ["a", "b", "", "a", "b"], ["b"], ["a", "a", "a"], []], merges._WORDS[0].type), pa.array([9, 2, 7, 3, 1], pa.int64())], schema=merges._WORDS)
    for own in (part, part.slice(1)):
        (got,) = merges._count_pairs(iter([own]))
        assert {(r["left"], r["right"]): r["freq"] for r in got.to_pylist()} == {("a", "b"): 4, ("a", "a"): 6}
    looked = []

    class Ranks(dict):
        def get(self, pair):
            looked.append(pair)
            return super().get(pair)

    assert merges.merge_by_rank(["a", "b", "c"], Ranks()) == ["a", "b", "c"] and len(looked) == 2


def test_clipped_texts_are_ranked_before_they_are_encoded(spark):
    """a rank reads its rows several times, an encoder must not."""
    assert plan(derived.scored(spark, SF, clip=64)).count("MapInArrow") == 1


def test_a_kept_text_is_sent_once(spark):
    """pipeline: the text among the kept columns is the one that is read."""
    df = table(spark).select("doc_id", "text", F.lit("en").alias("lang"))
    model = language_id.Model(["en"], np.full((1, 1), 1, np.uint64), 1, np.zeros(1))
    kept, alone = language_id.predict(df, model, keep=("text", "lang")), language_id.predict(df, model)
    assert "__text" not in plan(kept) and kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted(map(str, kept.select(alone.columns).collect())) == sorted(map(str, alone.collect()))
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, df.select("doc_id", "text").collect()))

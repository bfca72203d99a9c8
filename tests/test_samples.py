import random

from conftest import rows
from pyspark.sql import functions as F

from weftline.functions.arrays import ensure_bos, ensure_eos
from weftline.operators import packing
from weftline.operators import samples as S


def masked(x, y, mask_bos=False, mask_eos=False):
    skip = {3} | ({1} if mask_bos else set()) | ({2} if mask_eos else set())
    return [-1 if b in (1, 2, 3) or a in skip else b for a, b in zip(x, y)]


def ensured(ids, bos, eos):
    ids = list(ids)
    if bos and ids[:1] != [1]:
        ids = [1, *ids]
    if eos and ids[-1:] != [2]:
        ids = [*ids, 2]
    return ids


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    special = [1, 2, 3]
    return [(i, [rng.choice(special) if rng.random() < 0.1 else rng.randrange(4, 50) for _ in range(rng.choice([1, 2, 5, 9, 30]))]) for i in range(n)]


def tokens(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, ids array<int>").withColumn("len", F.size("ids"))


def test_marks_on_empty_arrays(spark):
    df = spark.createDataFrame([([],), ([1],), ([5, 2],), ([2, 5],)], "ids array<int>")
    assert [r[0] for r in df.select(ensure_bos(F.col("ids"))).collect()] == [[1], [1], [1, 5, 2], [1, 2, 5]]
    assert [r[0] for r in df.select(ensure_eos(F.col("ids"))).collect()] == [[2], [1, 2], [5, 2], [2, 5, 2]]


def test_packed_samples(spark):
    docs, block = corpus(), 12
    df = tokens(spark, docs)
    members = packing.pack_greedy(df, block)
    by_sample = {}
    for r in members.orderBy("order").collect():
        by_sample.setdefault(r["sample_id"], []).append(dict(docs)[r["doc_id"]])
    for bos, eos in ((True, False), (False, True)):
        out = S.packed_samples(members, df, block, bos, eos, segment_mask=True).collect()
        assert len(out) == len(by_sample)
        for r in out:
            parts = [ensured(d, bos, eos) for d in by_sample[r["sample_id"]]]
            data = [t for p in parts for t in p]
            number = [i + 1 for i, p in enumerate(parts) for _ in p]
            x = (data[:block] + [3] * block)[:block]
            y = (data[1 : block + 1] + [-1] * block)[:block]
            assert r["input_ids"] == x
            assert r["labels"] == masked(x, y)
            assert r["segment_ids"] == [0 if a == 3 else s for a, s in zip(x, (number + [0] * block)[:block])]


def test_document_samples(spark):
    docs, block = corpus(), 12
    df = tokens(spark, docs)
    for access in (S.PADDED, S.TRUNCATED, S.FULL):
        out = {r["sample_id"]: r for r in S.document_samples(df, block, access, eos=True).collect()}
        assert len(out) == len(docs)  # the last document is read like any other
        for doc, ids in docs:
            data = ensured(ids, False, True)
            data = data if access == S.FULL else data[: block + 1]
            x, y = data[:-1], data[1:]
            if access == S.PADDED:
                x, y = x + [3] * (block - len(x)), y + [-1] * (block - len(y))
            assert out[doc]["input_ids"] == x and out[doc]["labels"] == masked(x, y)


def test_contiguous_samples(spark):
    for docs, block in ((corpus(40, 1), 16), ([(0, list(range(4, 36)))], 8), ([(0, [5, 6])], 8), ([(0, [4] * 4), (1, []), (2, [5] * 4)], 8)):
        stream = [t for _, ids in docs for t in ids]
        out = rows(S.contiguous_samples(tokens(spark, docs), block), "sample_id")
        want = []
        for i in range(len(stream) // block):
            y = stream[i * block + 1 : (i + 1) * block + 1]
            want.append((i, stream[i * block : (i + 1) * block], y + [-1] * (block - len(y))))
        assert out == want


def test_label_flags(spark):
    x, y = [1, 5, 2, 6, 3, 7], [5, 2, 6, 3, 7, 1]
    df = spark.createDataFrame([(x, y)], "input_ids array<int>, labels array<int>")
    for bos in (False, True):
        for eos in (False, True):
            assert S.label_mask(df, bos, eos).first()["labels"] == masked(x, y, bos, eos)


def test_segment_lengths(spark):
    masks = [(5, [1, 1, 2, 2, 2, 0]), (2, [1, 1, 1, 1, 1, 1]), (9, [0] * 6), (11, [1, 2, 4, 4, 0, 0])]
    df = spark.createDataFrame(masks, "sample_id long, segment_ids array<int>").withColumn("batch_id", F.lit(0))
    got = rows(S.segment_lengths(df).drop("batch_id"), "sample_id", "segment")
    assert got == [(2, 1, 6, 0, 6), (5, 1, 2, 6, 8), (5, 2, 3, 8, 11), (11, 1, 1, 11, 12), (11, 2, 1, 12, 13), (11, 4, 2, 13, 15)]
    assert tuple(S.segment_summary(S.segment_lengths(df)).first()) == (0, 6, 6, 15)
    two = df.withColumn("batch_id", F.when(F.col("sample_id") < 6, 0)).withColumn("place", -F.col("sample_id"))
    got = rows(S.segment_lengths(two, order="place"), "sample_id", "segment")
    assert got == [(0, 2, 1, 6, 5, 11), (0, 5, 1, 2, 0, 2), (0, 5, 2, 3, 2, 5), (None, 11, 1, 1, 0, 1), (None, 11, 2, 1, 1, 2), (None, 11, 4, 2, 2, 4)]
    assert S.filled_positions(df).count() == 15


def test_access_choice(spark):
    assert S.access_for(True, False) == {"train": S.PACKED, "validation": S.PADDED, "bos": True, "eos": False}
    assert S.access_for(False, True) == {"train": S.PACKED_PLAIN, "validation": S.FULL, "bos": False, "eos": True}


def test_report(spark):
    docs = spark.createDataFrame([(i, 5) for i in range(7)] + [(9, 40)], "doc_id long, len int")
    members = packing.pack_greedy(docs, 8)
    r = packing.pack_report(members, docs, 8).first()
    # three chunks of two documents and the long one; one document stays open
    assert (r["samples"], r["docs_in"], r["docs_used"], r["max_docs"], r["tokens_used"], r["tokens_dropped"]) == (4, 8, 7, 2, 36, 39)

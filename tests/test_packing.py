import hashlib
import random

import pytest

from weftline.operators import packing


def fold(docs, block, seed=42, skip_last=False):
    """One walk over all documents, as defined."""
    if skip_last:
        docs = [d for d in docs if d[0] != max(i for i, _ in docs)]
    order = sorted(docs, key=lambda d: hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest())
    out, chunk, size, number = {}, [], 0, 0
    for doc, length in order:
        if length > block:
            out[2 * doc + 1] = [doc]
            continue
        chunk.append(doc)
        size += length
        if size >= block + 1:
            out[2 * number] = chunk
            number, chunk, size = number + 1, [], 0
    return out


def packed(spark, docs, block, **options):
    df = spark.createDataFrame(docs, "doc_id long, len int")
    out = {}
    for r in packing.pack_greedy(df, block, **options).orderBy("order").collect():
        out.setdefault(r["sample_id"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("shards", [None, 1, 90])
@pytest.mark.parametrize("kind", ["mixed", "short", "zero", "long"])
def test_equals_the_sequential_walk(spark, kind, shards):
    rng = random.Random(kind)
    top = {"mixed": 40, "short": 3, "zero": 2, "long": 100}[kind]
    docs = [(i * 3, rng.randrange(0 if kind == "zero" else 1, top)) for i in range(400)]
    assert packed(spark, docs, 24, shards=shards) == fold(docs, 24)


def test_edges(spark):
    for lengths in ([8], [9], [8, 1], [4, 20, 5], [1, 1], [0, 0]):
        docs = list(enumerate(lengths))
        assert packed(spark, docs, 8) == fold(docs, 8)
    docs = [(i, 5) for i in range(30)]
    assert packed(spark, docs, 8, skip_last=True) == fold(docs, 8, skip_last=True)


def test_reports_are_bounded_and_cover_every_incoming_length():
    import pandas as pd

    rng = random.Random(5)
    for n in (1, 3, 200):
        pdf = pd.DataFrame({"shard": 0, "high_key": range(n), "low_key": 0, "doc_id": range(n), "len": [rng.randrange(0, 12) for _ in range(n)]})
        report = packing._report_shard(pdf, 10)
        assert len(report) <= 12
        assert list(report["low"]) == [0, *(report["high"][:-1] + 1)] and report["high"].iloc[-1] == 10


@pytest.mark.parametrize("top", [3, 12, 60])
def test_groups_compose_to_the_report_of_their_documents(top):
    import pandas as pd

    rng = random.Random(top)
    for sizes in ([1, 1, 1], [5, 0, 9, 2], [40, 1, 30], [2] * 12):
        docs = [rng.randrange(0, top) for _ in range(sum(sizes))]
        docs = [d for d in docs if d <= 20] or [1]
        pdf = pd.DataFrame({"shard": 0, "high_key": range(len(docs)), "low_key": 0, "doc_id": range(len(docs)), "len": docs})
        pdf["shard"] = [min(int(i * len(sizes) / len(docs)), len(sizes) - 1) for i in range(len(docs))]
        parts = pd.concat([packing._report_shard(p, 20) for _, p in pdf.groupby("shard")]).assign(group=0)
        got, want = packing._compose_reports(parts, 20), packing._report_shard(pdf.assign(shard=0), 20)

        def at(report, carry):
            r = report[(report["low"] <= carry) & (carry <= report["high"])]
            assert len(r) == 1
            r = r.iloc[0]
            return r["out"] + (0 if r["absolute"] else carry), r["closed"]

        assert len(got) <= 22
        assert [at(got, c) for c in range(21)] == [at(want, c) for c in range(21)]


@pytest.mark.parametrize("shards, levels", [(500, 0), (500, 1), (500, 2), (16, 2)])
def test_equals_the_sequential_walk_at_every_depth(spark, monkeypatch, shards, levels):
    monkeypatch.setattr(packing, "FAN_BITS", 3)
    rng = random.Random(levels)
    docs = [(i * 3, rng.choice((0, 1, 5, 30))) for i in range(300)]
    assert packed(spark, docs, 24, shards=shards, levels=levels) == fold(docs, 24)


@pytest.mark.parametrize("shards", [1, 7])
def test_large_ids_beside_a_null_id(spark, shards):
    ids = [(1 << 60) + k for k in range(40)]
    df = spark.createDataFrame([*[(i, 5) for i in ids], (None, 5), (None, 3)], "doc_id long, len int")
    got = packing.pack_greedy(df, 9, shards=shards).collect()
    plain = packing.pack_greedy(df.where("doc_id is not null"), 9, shards=shards).collect()
    assert {r.doc_id for r in plain} <= set(ids) and {r.doc_id for r in got} <= {*ids, None}
    assert len([r for r in got if r.doc_id is not None]) == len({r.doc_id for r in got} - {None})
    assert sum(r.doc_id is None for r in got) == 2  # they come first, so their sample is closed

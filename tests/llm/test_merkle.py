"""The manifest and its proofs against a plain tree in memory, with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, source string, lang string, n_chars long, text string, id long, leaf string, part int, tree int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def way_of(tree, pos):
    out = []
    for level in tree[:-1]:
        first = pos - pos % 3
        out.append((level[first:pos], level[pos + 1 : first + 3]))
        pos //= 3
    return out


def brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: tree_of([leaf_of(r) for r in groups[s]]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    root, out = top[-1][0], []
    for k, s in enumerate(order):
        for pos, r in enumerate(groups[s]):
            way = way_of(trees[s], pos) + way_of(top, k)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            digest = leaf_of((*r[:4], r[4].replace("\n", "")) if tampered else r)
            for before, after in way:
                digest = sha(*before, digest, *after)
            proof = "".join("".join(before + after) for before, after in way)
            out.append((r[0], leaf_of(r), trees[s][-1][0], root, sha(proof), digest, digest == root, proof))
    return sorted(out, key=str)


def tampered(docs):
    even = F.crc32(docs.doc_id.cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(even, F.translate("text", "\n", "")).otherwise(docs.text)}


def proven(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "clash", 2, 3) for r in rows], DDL).repartition(5)
    got = merkle.prove_rows(docs, COLUMNS, "source", "doc_id", tampered(docs), proofs=True)
    return sorted(map(tuple, got.collect()), key=str)


def sample(n, seed=1):
    rng = random.Random(seed)
    sources = ["hot"] * 9 + [None, "", "é", "z", "Z", "a b"]
    texts = [None, "", "one\nline", "plain", "\n", "🙂\n\n é", "long\n" * 20000]
    rows = [(k, rng.choice(sources), rng.choice([None, "en", ""]), rng.choice([None, 5, -3]), rng.choice(texts)) for k in range(n)]
    rows += [(n + k, f"own {k}", "en", k, "alone\n") for k in range(5)]  # groups of one
    rows += [(None, "hot", None, None, "no id\n"), (None, "hot", None, None, None), (None, None, None, None, None), (1 << 60, "hot", "x", 1, "far\n")]
    return rows + rows[:7] + [rows[3]] * 6  # rows that repeat


@pytest.mark.parametrize(("partition", "steps"), [(4096, 7), (5, 1), (7, 2)])
def test_proofs(spark, monkeypatch, partition, steps):
    monkeypatch.setattr(merkle, "PARTITION", partition)
    monkeypatch.setattr(merkle, "STEPS", steps)
    monkeypatch.setattr(merkle, "BLOCK", 3**steps)
    rows = sample(150)
    assert proven(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[(5, "one", "en", 1, "a\nb")], [(5, None, None, None, None)] * 4, [(k, "one", None, None, "x") for k in range(9)]])
def test_small_tables(spark, rows):
    assert proven(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert proven(spark, []) == []


def test_tampering_is_seen(spark):
    got = proven(spark, [(k, "s", None, None, "a\nb" if k % 3 else "ab") for k in range(40)])
    for doc_id, *_, verified, _ in got:
        assert verified == (doc_id % 3 == 0 or zlib.crc32(str(doc_id).encode()) % 2 == 1)


def test_missing_nodes_are_few():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        for _ in range(20):
            known = set(rng.sample(range(n), rng.randint(1, n)))
            asked = merkle.missing(known, n)
            leaves = [hashlib.sha256(str(k).encode()).hexdigest().encode() for k in range(n)]
            tree = [leaves]
            while len(tree[-1]) > 1:
                tree.append([merkle.joined(tree[-1][k : k + 3]) for k in range(0, len(tree[-1]), 3)])
            given = {(level, pos): tree[level][pos] for level, pos in asked}
            assert merkle.Paths(n, {k: leaves[k] for k in known}, given).last == tree[-1][0]
            under = lambda level, pos: {k for k in range(n) if k // 3**level == pos}
            assert all(not (under(level, pos) & known) for level, pos in asked)  # nothing that could be derived
            cover = [k for level, pos in asked for k in under(level, pos)]
            assert len(cover) == len(set(cover)) == n - len(known)  # nothing twice
    assert merkle.missing(range(100), 100) == []


def test_fewer_nodes_than_single_proofs():
    single = sum(len(merkle.missing([k], 10000)) for k in range(4096))
    assert len(merkle.missing(range(4096), 10000)) < single / 1000


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    assert sorted(map(tuple, queries.op12_merkle(spark, "/root/testdata/sf0.001").collect()), key=str) == [r[:-1] for r in brute(rows)]

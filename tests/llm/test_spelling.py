"""Words, near words, forms and roots against plain sets, with nulls, ties, repeated rows, long words and crowded cells."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, word string, n int, id string"


def brute(rows, one_in=199, least=6, count=5, times=5):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= count}
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
    for (a, b), group in holes.items():
        for w in group | ({a + b} & set(words)):
            near[w] |= (group | ({a + b} & set(words))) - {w} if w == a + b else (group - {w}) | ({a + b} & set(words))
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= times * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abeinrstéü") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["x" * 63, "x" * 64, "x" * 65, "yx" * 500]
    forms = list(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            forms.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abeé") + w[k:], w[:k] + rng.choice("abe÷") + w[k + 1 :]]))
    weights = [40] * len(base) + [rng.choice([1, 3, 30]) for _ in forms[len(base) :]]
    rows = []
    for i in range(n):
        words = rng.choices(forms, weights, k=60)
        rows.append((i, "".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice([" ", ", ", "\n", "1", "—", "Ā"]) for w in words)))
    return [*rows, (None, rows[0][1]), (n, None), (n + 1, ""), (1 << 60, rows[1][1]), *rows[:3], (n + 2, "abcdef " * 20000)]


def found(spark, rows, one_in=199):
    docs = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], DDL).repartition(6)
    return sorted(map(tuple, spelling.variants(docs, 6, 5, 5, one_in).collect()), key=str)


@pytest.mark.parametrize("one_in", [199, 3])
def test_variants(spark, one_in):
    rows = corpus()
    assert found(spark, rows, one_in) == brute(rows, one_in)


def test_many_cells_blocks_and_shares(spark, monkeypatch):
    for name, value in (("CELL", 4), ("CELLS", 3), ("SAMPLED", 2), ("QUERIES", 7), ("LEAF", 2), ("PAIRS", 16), ("COUNTED", 30), ("LONGEST", 9)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(5)
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "short words only"[:5])]) == []


def test_chains_and_ties(spark):
    text = "aaaaaa " * 5 + "aaaaab " * 25 + "aaaabb " * 125 + "aaaaba " * 25 + "bbbbbbb " * 9 + "cbbbbbb " * 9
    rows = [(1 << 40, text)]
    got = {r[0]: r[1:] for r in found(spark, rows, 10**9)}
    assert got["aaaaaa"] == ("aaaaab", "aaaabb", 5, 2, 25)  # the first in order of equally frequent ones, then its form
    assert got["aaaabb"] == (None, "aaaabb", 125, 1, None)
    assert got["bbbbbbb"][:2] == (None, "bbbbbbb")


def test_no_near_point_is_pruned():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(4, 7))).encode("latin-1") for _ in range(600)})
    counts = spelling.letter_counts(words)
    tree, marks = spelling.Tree(counts, 4), spelling.signatures(counts)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(len(words)))
    assert all((tree.place(counts)[rows] == leaf).all() for leaf, rows in enumerate(tree.rows))
    reached = {(q, int(w)) for leaf, rows in tree.reach(counts, 1, 1) for q in rows.tolist() for w in tree.rows[leaf]}
    assert len(reached) < len(words) ** 2 / 2
    for a, x in enumerate(words):
        for b, y in enumerate(words):
            if spelling.one_edit(x, y):
                assert np.abs(counts[a] - counts[b]).sum() <= 2
                assert (a, b) in reached and int(marks[a] ^ marks[b]).bit_count() <= 2


def test_letter_order():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(120), np.arange(120)))

    def plain(a, b):
        edits = {a[:k] + a[k + 1 :] for k in range(len(a))} | {a[:k] + c + a[k:] for k in range(len(a) + 1) for c in (b"a", b"b")}
        return b in edits | {a[:k] + c + a[k + 1 :] for k in range(len(a)) for c in (b"a", b"b")} - {a}

    want = [plain(words[a], words[b]) for a, b in zip(i, j, strict=True)]
    assert spelling.near_rows(words, words, i, j).tolist() == want
    assert [spelling.one_edit(words[a], words[b]) for a, b in zip(i, j, strict=True)] == want


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_spelling(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in docs])

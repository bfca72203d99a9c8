import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import aligned, overlap, scripts, transfer
from weftline.plans import registry

VEC = "token string, id int, vec array<double>"


def vectors(spark, n, dim, seed=0, first=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"▁w{i}", first + i, rng.normal(size=dim).tolist()) for i in range(n)], VEC)


def as_map(df):
    return {r["id"]: np.array(r["vec"]) for r in df.collect()}


def sparsemax(z):
    s = np.sort(z)[::-1]
    k = np.arange(1, len(s) + 1)
    size = k[1 + k * s > np.cumsum(s)].max()
    return np.maximum(z - (np.cumsum(s)[size - 1] - 1) / size, 0)


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_moments_and_draws(spark):
    source = vectors(spark, 50, 6)
    targets = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("token"), F.col("id").cast("int").alias("id"))
    mean = as_map(transfer.init_mean(targets, source))
    rows = np.stack([r["vec"] for r in source.collect()])
    got = np.stack(list(mean.values()))
    assert np.allclose(got.mean(axis=0), rows.mean(axis=0), atol=0.08) and np.allclose(got.std(axis=0), rows.std(axis=0, ddof=1), atol=0.08)
    again = as_map(transfer.init_mean(targets.repartition(3), source))
    assert all((mean[i] == again[i]).all() for i in mean)
    small = np.stack(list(as_map(transfer.init_random(targets, 5)).values()))
    assert small.shape[1] == 5 and abs(small.std() - 0.02) < 0.001
    assert not (as_map(transfer.init_random(targets, 5, seed=1))[0] == small[0]).any()


def test_resize_and_copies(spark):
    targets = spark.createDataFrame([("a", 260), ("b", 261), ("c", 262)], "token string, id int")
    padded = transfer.padded_targets(targets, 260, 128)
    assert sorted(r["id"] for r in padded.collect()) == list(range(260, 384))
    assert transfer.padded_targets(padded.where("id < 263"), 253, 128).count() == 3  # already a multiple
    source = spark.createDataFrame([("b", 260, [1.0, 2.0]), ("<s>", 1, [3.0, 4.0]), ("c", 900, [5.0, 6.0])], VEC)
    by_id = as_map(transfer.init_rank_copy(targets, source))
    assert by_id[260].tolist() == [1.0, 2.0] and abs(by_id[261]).max() < 0.2
    same = as_map(transfer.init_identity(targets.union(spark.createDataFrame([("<s>", 1)])), source))
    assert {k: v.tolist() for k, v in same.items()} == {261: [1.0, 2.0], 262: [5.0, 6.0]}


TOKENS = [("▁", 0), ("▁مرحبا", 1), ("Привет", 2), ("aб", 3), ("бa", 4), ("<s>", 5), ("͸", 6), ("▁x1", 7), ("漢字かな漢", 8)]
SCRIPT_OF = ["Common", "Arabic", "Cyrillic", "Latin", "Cyrillic", "Common", "UNK", "Latin", "Han"]


def test_scripts(spark):
    df = spark.createDataFrame(TOKENS, "token string, id int")
    found = {r["id"]: r["script"] for r in scripts.token_script(df).collect()}
    assert [found[i] for i in range(len(TOKENS))] == SCRIPT_OF
    groups = sorted((r["id"], r["category"]) for r in scripts.script_groups(scripts.token_script(df)).collect())
    assert (0, "Common_initial") in groups and (2, "Cyrillic_medial") in groups
    assert [c for i, c in groups if i == 5] == ["Common_medial", "special"]


def test_script_table(spark):
    lines = ["# comment", "", "0041..005A    ; Latin # L&", "0061..007A ; Latin", "0430..044F ; Cyrillic # x", "2581 ; Common # So", "1F600 ; Smile"]
    table = scripts.script_table(spark.createDataFrame([(line,) for line in lines], "value string"))
    assert table.count() == 26 + 26 + 32 + 2
    df = spark.createDataFrame([("▁", 0), ("aб", 1), ("ббa", 2), ("1", 3), ("😀", 4)], "token string, id int")
    found = {r["id"]: r["script"] for r in scripts.token_script(df, table).collect()}
    assert found == {0: "Common", 1: "Latin", 2: "Cyrillic", 3: "UNK", 4: "Smile"}


def test_category_draws(spark):
    source = spark.createDataFrame(
        [("a", 1, "L", [1.0, 5.0]), ("b", 2, "L", [1.0, 7.0]), ("c", 3, "C", [9.0, 9.0]), ("<s>", 4, "special", [0.0, 0.0])],
        "token string, id int, category string, vec array<double>",
    )
    targets = spark.createDataFrame(
        [("x", 1, "L"), ("y", 2, "C"), ("z", 3, "none"), ("<s>", 4, "special"), ("b", 5, "L")], "token string, id int, category string"
    )
    got = as_map(transfer.init_by_category(targets, source))
    assert sorted(got) == [1, 2, 5]
    assert got[1][0] == 1.0 and got[2].tolist() == [9.0, 9.0]  # one source token: deviation 0
    full = as_map(transfer.init_heuristic(targets, source))
    assert sorted(full) == [1, 2, 3, 5]
    assert full[5].tolist() == [1.0, 7.0] and full[1].tolist() == got[1].tolist() and abs(full[3]).max() < 0.2


@pytest.mark.parametrize("block", [7, 4096])
def test_overlap_means_equal_the_dense_computation(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = np.random.default_rng(4)
    q, k, v = rng.normal(size=(23, 5)), rng.normal(size=(31, 5)), rng.normal(size=(31, 3))
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "id int, aux array<double>")
    keys = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(k, v))], "id int, aux array<double>, vec array<double>")
    sims = unit(q) @ unit(k).T
    got = as_map(overlap.overlap_means(queries, keys))
    for i in range(len(q)):
        assert np.allclose(got[i], sparsemax(sims[i]) @ v)
    near = as_map(overlap.neighbour_means(queries, keys, 4, 0.1))
    for i in range(len(q)):
        top = np.argsort(-sims[i])[:4]
        w = np.exp(sims[i][top] / 0.1)
        assert np.allclose(near[i], (w / w.sum()) @ v[top])


def test_overlap_matching(spark):
    source = spark.createDataFrame([("▁The", 5), ("the", 7), ("!", 9), ("▁x", 11)], "token string, id int")
    targets = spark.createDataFrame([("▁the", 1), ("the", 2), ("▁!", 3), ("▁X", 4), ("y", 5)], "token string, id int")
    found = lambda **o: {r["id"]: r["source_id"] for r in overlap.match_overlap(targets, source, **o).collect()}
    assert found() == {2: 7}
    assert found(exact=False) == {1: 5, 2: 7, 3: 9, 4: 11}
    assert found(match_symbols=True) == {2: 7, 3: 9}


def test_overlap_layers(spark):
    source = vectors(spark, 6, 3)
    targets = spark.createDataFrame([("▁w1", 0), ("▁w2", 1), ("new", 2), ("rare", 3)], "token string, id int")
    aux = spark.createDataFrame([("▁w1", [1.0, 0.0]), ("▁w2", [0.0, 1.0]), ("new", [1.0, 0.0])], "token string, aux array<double>")
    out = {r["id"]: r for r in overlap.init_overlap(targets, source, aux).collect()}
    vec = as_map(source)
    assert [out[i]["kind"] for i in range(4)] == ["copied", "copied", "weighted", "drawn"]
    assert out[2]["vec"] == pytest.approx(vec[1])  # all weight on its only neighbour
    assert len(out[3]["vec"]) == 3


def test_alignment_recovers_a_rotation(spark):
    rng = np.random.default_rng(9)
    space = rng.normal(size=(40, 4))
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    make = lambda m, p: spark.createDataFrame([(f"{p}{i}", r.tolist()) for i, r in enumerate(m)], "token string, aux array<double>")
    source_space, target_space = make(space, "s"), make(space @ turn, "t")
    pairs = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(30)], "source_token string, target_token string")
    assert np.allclose(aligned.alignment(source_space, target_space, pairs), turn)
    v = rng.normal(size=(40, 2))
    source = spark.createDataFrame([(f"s{i}", i, r.tolist()) for i, r in enumerate(v)], VEC)
    targets = spark.createDataFrame([(f"t{i}", i) for i in range(40)], "token string, id int")
    got = as_map(aligned.init_aligned(targets, source, source_space, target_space, pairs, neighbours=1))
    assert all(np.allclose(got[i], v[i]) for i in range(40))


def test_aligned_vectors_of_the_query(spark, monkeypatch):
    """The registered query against numpy: rotate, cosine, softmax over the ten nearest."""
    rng = np.random.default_rng(12)
    spaces = {lang: {f"{lang if i % 2 else 'both'}{i}": rng.normal(size=3) for i in range(30)} for lang in ("en", "de")}
    vec = {t: rng.normal(size=4) for t in [*spaces["en"], "without"]}
    ids = {t: i for i, t in enumerate([*spaces["de"], "rare"])}
    monkeypatch.setattr(registry.derived, "auxiliary", lambda s, d, lang: spark.createDataFrame([(t, v.tolist()) for t, v in spaces[lang].items()], "token string, aux array<double>"))
    monkeypatch.setattr(registry, "_source", lambda s, d: spark.createDataFrame([(t, i, v.tolist()) for i, (t, v) in enumerate(vec.items())], VEC))
    monkeypatch.setattr(registry, "_target", lambda s, d: spark.createDataFrame(list(ids.items()), "token string, id int"))
    got = {r["token"]: r["vec"] for r in registry.QUERIES["init_aligned_vectors"](spark, "").collect()}
    unit = lambda v: v / np.linalg.norm(v)
    u, _, vt = np.linalg.svd(sum(np.outer(unit(v), unit(spaces["de"][t])) for t, v in spaces["en"].items() if t in spaces["de"]))
    want = {}
    for t, v in spaces["de"].items():
        near = sorted(((unit(x @ u @ vt) @ unit(v), s) for s, x in spaces["en"].items()), reverse=True)[:10]
        weights = np.exp([sim / 0.1 for sim, _ in near])
        want[t] = weights @ np.stack([vec[s] for _, s in near]) / weights.sum()
    shown = spark.createDataFrame([(t, v.tolist()) for t, v in want.items()], "token string, vec array<double>")
    shown = {r["token"]: r["vec"] for r in registry.vector_text(shown).collect()}
    assert got.keys() == shown.keys()
    number = lambda text: np.array(re.findall(r"-?[0-9]+", text), float)
    assert all(np.abs(number(got[t]) - number(shown[t])).max() <= 1 and len(number(got[t])) == 4 for t in shown)


def test_scripts_of_the_whole_table(spark):
    given = {"a": "Latin", "ⴰ": "Tifinagh", "ߊ": "Nko", "ⲁ": "Coptic", "ꦲ": "Javanese", "ᮊ": "Sundanese", "𐰀": "Old_Turkic", "漢": "Han", "1": "Common", "\ue000": "UNK"}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(given)], "id int, token string")
    assert {r["token"]: r["script"] for r in scripts.token_script(df).collect()} == given

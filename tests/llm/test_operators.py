"""The operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import best_fit, exact_dedup, jaccard_join, knn_join, language_id, line_dedup, lm_score, piece_sampling, token_frames, warc
from weftline.session import fresh_folder

DOCS = "doc_id long, text string, lang string, kept boolean, n long, sig string, id string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    from weftline.session import build_session

    session = build_session("local[8]", 8, spark__driver__memory="8g", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("OFF")
    return session


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [a + b for a in "ab cd ef gh ij kl".split() for b in "on er al is".split()]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    texts = list(base)
    for t in base[: n // 2]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for k in range(40):  # a family around one text
        w = base[0].split(" ") + words
        w[rng.randrange(len(w))] = f"own{k}"
        texts.append(" ".join(w))
    texts += [base[1], base[1].upper(), base[2].replace(" ", " \n"), None, "", "   ", "one", "One", "two words", "long " * 30000, "é中🙂 ▁ \x00 <|endoftext|>"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a row without an id"), (3, base[3])]
    return rows


def frame(spark, rows):
    out = [(i, t, ("xx", "yy")[len(t or "") % 2], True, 7, "s", "i") for i, t in rows]
    return spark.createDataFrame(out, DOCS).repartition(5)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_copies(spark):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_copies(frame(spark, rows), digest_all=True).collect()
    key = lambda x: (str(x[0]), x[-1])
    want = [(i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), sha(norm(t))) for i, t in rows]
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    plain = exact_dedup.exact_copies(frame(spark, rows)).collect()
    assert all((r.text_sha256 is not None) for r in plain if r.group_size > 1)
    assert exact_dedup.exact_copies(frame(spark, [])).count() == 0


def components_of(rows, size, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("size", "num", "long_list"), [(4, 85, jaccard_join.LONG_LIST), (5, 80, jaccard_join.LONG_LIST), (4, 85, 3), (5, 80, 2)])
def test_jaccard_components(spark, size, num, long_list):
    rows = corpus(2)
    got = jaccard_join.linked_documents(frame(spark, rows), size=size, num=num, den=100, long_list=long_list)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(got, key=str) == sorted(components_of(rows, size, num, 100), key=str)


def test_jaccard_empty(spark):
    assert jaccard_join.linked_documents(frame(spark, [])).count() == 0


def test_jaccard_bit_set(spark, monkeypatch):
    """Words of bits reach the driver, not slots."""
    rng = np.random.default_rng(4)
    slots = [0, 63, 64, jaccard_join.BITS - 1, *range(6400, 6528), *rng.integers(0, jaccard_join.BITS, 300).tolist()]
    df = spark.createDataFrame([(x,) for x in slots * 2], "slot int")
    rows, collect = [], type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: (out := collect(self), rows.append(out.num_rows))[0])
    bits = jaccard_join.bit_set(df)
    assert rows == [len({x >> 6 for x in slots})]
    assert len(bits) == jaccard_join.BITS >> 3 and np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted(set(slots))
    assert not jaccard_join.bit_set(df.limit(0)).any()


def test_jaccard_subsets_and_blocks():
    t = jaccard_join.Threshold(85, 100)
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for _ in range(60):  # light sets that link share a subset of the right size
        a = np.unique(rng.choice(pool[:14], rng.integers(1, 14), replace=False))
        b = np.unique(rng.choice(pool[:14], rng.integers(1, 14), replace=False))
        shared = len(np.intersect1d(a, b))
        keys = [set(zip(jaccard_join.subset_keys(x, t.subset_sizes(len(x))).tolist(), np.repeat(t.subset_sizes(len(x)), [__import__("math").comb(len(x), c) for c in t.subset_sizes(len(x))]).tolist())) for x in (a, b)]
        common = any((len(a) + len(b)) * 85 <= c * 185 for _, c in keys[0] & keys[1])
        assert common == (100 * shared >= 85 * (len(a) + len(b) - shared))


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [f"a line of some length {k}" for k in range(30)] + ["short", "", "  A LINE of some length 3\t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(80)] + [(90, None), (91, ""), (92, lines[5] * 3000)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    want = {}
    for i, t in rows:
        own = (t or "").split("\n")
        keep = [x for x in own if len(key(x)) < 20 or len(where[key(x)]) < 3 or max(where[key(x)]) == i]
        want[i] = (len(own), len(own) - len(keep), sha("\n".join(keep)))
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    twice = line_dedup.dedup_lines(frame(spark, rows + [(None, lines[0]), (None, lines[0])]))
    assert twice.count() == len(rows) + 2
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in corpus(5) if i is not None][:-1]
    folder = fresh_folder(spark, "t")
    index = token_frames.write_token_files(frame(spark, rows), folder, path, 2, frame_ids=500)
    want, start = {}, 0
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_frames.read_tokens(index, folder, ids=False).collect()}
    assert got == want
    some = token_frames.read_tokens(index.filter("id % 7 = 3"), folder).collect()
    assert {r.id: len(r.ids) for r in some} == {i: n for i, (_, n, _) in want.items() if i % 7 == 3}
    assert token_frames.write_token_files(frame(spark, []), fresh_folder(spark, "t"), path, 2).count() == 0


def test_archives(spark):
    body = "<html>" + "x" * 200
    rows = [(i, f"http://a/{i}", body + str(i % 4)) for i in range(20)] + [(30, None, None), (31, "http://b/ \n?é", ""), (32, "u", "tiny"), (33, "u", "tiny"), (None, "u", body + "0"), (34, "u", "é" * 50), (35, "v", "é" * 50)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = fresh_folder(spark, "w")
    index = warc.write_archives(pages, folder)
    got = {r.id: r for r in warc.read_records(index, folder, gap=10, most=2000).collect()}
    assert len(got) == len(rows)
    for i, _, t in rows:
        r, raw = got[i], (t or "").encode()
        same = [x for x, _, y in rows if y == t and x is not None]
        again = len(raw) >= 100 and min(same) != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None)
        assert r.payload is None if again else bytes(r.payload) == raw
    assert warc.write_archives(pages.limit(0), fresh_folder(spark, "w")).count() == 0


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(400)] + [(400 + i, [1.0] * 6) for i in range(300)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = knn_join.top_k(df, df.filter("vec_id % 50 = 0"), 5, pivots=16, block=4, slice_=64).collect()
    ok = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v))))) for i, v in rows if i is not None and (i < 900 or i == 904)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert knn_join.top_k(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit(rule):
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 101, 700)
    for caps in ((100, 100, 1e4), (100, 4, 1e4), (100, 100, 4000.0 + 6001)):
        bins = best_fit.best_fit(tokens, caps, (1.0, 0.01, 0.01), rule)
        assert np.bincount(bins, tokens).max() <= caps[0] and np.bincount(bins).max() <= caps[1]
        assert np.bincount(bins, tokens.astype(float) ** 2).max() <= caps[2]
    # Best fit on decreasing sizes needs at most 11/9 of the fewest sequences, and one more; tokens / 100 is a lower bound.
    assert len(set(best_fit.best_fit(tokens, (100, 700, 1e4), (1.0, 0.0, 0.0), rule))) <= 11 / 9 * tokens.sum() / 100 + 1
    with pytest.raises(ValueError, match="capacity"):
        best_fit.best_fit(np.array([101]), (100, 10, 1e6), (1, 1, 1), rule)


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = corpus(6)
    got = best_fit.pack_documents(frame(spark, rows), path, capacity=256, shard=50).toPandas()
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((str(i), p, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 256)))
    found = [(str(None if d != d else int(d)), *r) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert collections.Counter(found) == want
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group.length.sum() <= 256 and (group.length.cumsum() - group.length == group.offset).all()
    assert got.sequence_id.nunique() <= 11 / 9 * got.length.sum() / 256 + 1
    assert best_fit.pack_documents(frame(spark, []), path).count() == 0


def test_pack_until_one_shard(spark):
    """Three of these fit a sequence and leave room, so no round fills one; shards of about 40 would each end with a part."""
    df = spark.range(1500).select("id", F.lit(30).cast("long").alias("size"))
    got = best_fit.pack(df, "size", (100, 100, 1e4), shard=40).toPandas()
    assert sorted(got.id) == list(range(1500))
    sizes = got.groupby("sequence_id")["size"].agg(["sum", "size"])
    assert sizes["sum"].max() <= 100 and len(sizes) <= 500 + 3
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group["size"].cumsum() - group["size"] == group.offset).all()


def test_language_id(spark):
    rng = random.Random(0)
    words = {"aa": ["baba", "bibo", "tabi"], "bb": ["zyx", "qwy", "xyq"], "cc": ["mnop", "nomp", "pomn"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate(list(words) * 40)] + [(900, None, "aa"), (901, "123 !", "bb"), (902, "", None), (None, "baba", None), (903, "baba " * 100000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = language_id.fit(df.filter(~language_id.held_out()))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:120]) and got[903].lang_pred == got[None].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.predict(df, language_id.fit(df.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {None, "und"}


def test_lm_score_of_every_bigram(spark, monkeypatch):
    """Many small blocks and parts; scores against brute force over all words and bigrams."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lm_score, "PART_KEYS", 300)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice((5, 400))]) for _ in range(rng.randint(1, 60)))) for i in range(50)]
    rows += [(60, None), (61, " \n"), (62, "W1 once"), (62, "W1 once"), (62, "w1 w2"), (None, "w1 never w2"), (None, None), (63, "é only here"), (63, "é only there"), (64, "long w1 " * 30000)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, target int, n int").repartition(4)
    good = spark.createDataFrame([(i,) for i in (*range(0, 50, 3), 0, 62, None)], "doc_id long")
    split = [(i, (t or "").translate(LOW).split()) for i, t in rows]
    targets = {*range(0, 50, 3), 62}
    for least, marked in ((1, targets), (2, targets), (4, targets), (2, set())):
        seen = collections.Counter(w for _, ws in split for w in ws)
        ids = [(i, [w if seen[w] >= least else None for w in ws]) for i, ws in split]
        size = sum(n >= least for n in seen.values())
        loss = []
        for own in ([ws for _, ws in ids], [ws for i, ws in ids if i in marked]):
            uni = collections.Counter(w for ws in own for w in ws)
            pairs = collections.Counter(p for ws in own for p in zip(["<s>", *ws], ws))
            contexts = collections.Counter(p for ws in own for p in ["<s>", *ws][: len(ws)])
            loss.append([-sum(np.log((pairs[v, w] + 2 * (uni[w] + 1) / (sum(uni.values()) + size + 1)) / (contexts[v] + 2)) for v, w in zip(["<s>", *ws], ws)) / len(ws) if ws else None for _, ws in ids])
        want = sorted((str(i), len(ws), *((round(t, 9), round(b, 9), round(t - b, 9)) if ws else (None,) * 3)) for (i, ws), b, t in zip(ids, *loss))
        got = lm_score.score_corpus(df, good if marked else good.limit(0), least=least, mu=2.0)
        assert got.columns == ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
        found = sorted((str(r.doc_id), r.n_tokens, *((round(x, 9) if x is not None else None) for x in (r.target_loss, r.background_loss, r.score))) for r in got.collect())
        assert [f[:2] for f in found] == [w[:2] for w in want]
        assert all(a is b is None or abs(a - b) < 1e-8 for f, w in zip(found, want) for a, b in zip(f[2:], w[2:]))
    assert lm_score.score_corpus(df.limit(0), good).count() == 0


def test_piece_sampling(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = corpus(7)
    a = {(r.doc_id, r.n_pieces, r.ids_crc32, r.text_sha256) for r in piece_sampling.sample_pieces(frame(spark, rows), path, ids=False).collect()}
    b = {(r.doc_id, r.n_pieces, r.ids_crc32, r.text_sha256) for r in piece_sampling.sample_pieces(frame(spark, rows[::-1]).coalesce(1), path, ids=False).collect()}
    assert a == b and {(i, s) for i, _, _, s in a} == {(i, sha(t)) for i, t in rows}
    other = {(r.doc_id, r.ids_crc32) for r in piece_sampling.sample_pieces(frame(spark, rows), path, seed=1, ids=False).collect()}
    assert other != {(i, c) for i, _, c, _ in a}


def test_piece_distribution():
    model = piece_sampling.Lattice(public_tokenizers.path("piece_bpe_32k.model"), 0.2)

    def every(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in model.weight:
                i, w = model.weight[s[:k]]
                yield from (((i, *rest), w + x) for rest, x in every(s[k:]))

    mass = {k: np.exp(v) for k, v in every(" then")}
    n = 40000
    seen = collections.Counter(tuple(x.tolist()) for x in piece_sampling.segment(model, list(range(n)), ["then"] * n, 5))
    z = sum(mass.values())
    assert set(seen) <= set(mass)
    assert all(abs(seen[k] - n * m / z) < 5 * (n * m / z) ** 0.5 + 3 for k, m in mass.items())


def test_pipeline_rejects_what_no_filter_holds(spark):
    import corpus_pipeline

    rng = random.Random(0)
    words = {"aa": ["baba", "bibo", "tabi"], "bb": ["zyx", "qwy", "xyq"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x) for i, x in enumerate(list(words) * 20)]
    rows += [(900, "hjkl fghj jklh", None), (901, "中文字符 東京都庁", None), (902, None, "aa"), (903, "12 !", "bb"), (904, "baba hjkl", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, df, "").collect()}
    assert kept == {*range(40), 904}
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, unlabelled, "").collect()} == {*range(40), 900, 901, 904}


def test_pipeline_keeps_one_row_of_a_component(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], *words[k + 1 :]]) for k in (0, 59)]
    other = [" ".join(w[::-1] for w in t.split()) for t in near]
    third = [t.replace("w", "v") for t in near]
    rows = [(5, near[0]), (5, near[1]), (5, near[1]), (None, other[0]), (None, other[1]), (None, third[0]), (7, third[1]), (7, "alone"), (8, ""), (9, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert len(got) == 7 and collections.Counter(i for i, _ in got) == {5: 1, None: 2, 7: 2, 8: 1, 9: 1}
    assert sum(t in near for _, t in got) == sum(t in other for _, t in got) == 1 and (7, third[1]) in got


def test_pipeline(spark):
    import corpus_pipeline

    docs = frame(spark, corpus(8)).drop("sig")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = components_of(rows, 5, 80, 100)
    assert all(i == c for i, _, c in found) and len({t for _, t in rows}) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == len({i for i, _ in rows})
    empty = docs.limit(0)
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)

from conftest import rows
from pyspark.sql import functions as F

from weftline.functions.text import clip_words, pieces, strip
from weftline.operators import corpus

LINE = "source_id string, line_no long, text string"


def test_strip_takes_all_unicode_white_space(spark):
    texts = [" \t a b \n　", "\n", "", " x ", "a "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(strip(F.col("text"))).collect()] == [t.strip() for t in texts]
    assert rows(corpus.normalise_text(df)) == sorted([(t.strip() + "\n",) for t in texts if t != "\n"], key=repr)


def test_warnings(spark):
    data = [(1, None), (2, []), (3, [None]), (4, ["long", None]), (5, ["noisy"]), (6, ["long", "adult"]), (7, [None, "tiny"]), (8, ["noisy2"])]
    df = spark.createDataFrame(data, "id int, warnings array<string>")
    assert [r["id"] for r in corpus.quality_filter(df).orderBy("id").collect()] == [1, 2, 3, 4, 8]


def test_lines_to_documents(spark):
    texts = {"a": ["x\n", "y\n", "\n", "\n", "z\n"], "b": ["\n", "q\n", "\n"], "c": ["open\n"]}
    data = [(s, i * 3, t) for s, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data[::-1], LINE)
    assert rows(corpus.lines_to_documents(df), "source_id", "doc_no") == [("a", 0, "x\ny\n"), ("a", 1, ""), ("b", 0, ""), ("b", 1, "q\n")]
    kept = rows(corpus.lines_to_documents(df, keep_tail=True), "source_id", "doc_no")
    assert ("a", 2, "z\n") in kept and ("c", 0, "open\n") in kept


def test_clip_equals_a_split_on_the_single_space(spark):
    texts = ["a  b c", "", " a", "a", "a b\nc d e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (1, 2, 3, 50):
        assert [r[0] for r in df.select(clip_words(F.col("text"), n)).collect()] == [" ".join(t.split(" ")[:n]) for t in texts]


def test_pieces(spark):
    cases = {"the cat": ["▁the", "▁cat"], " a\n\tb　c ": ["▁a", "▁b", "▁c"], "x12 3": ["▁x", "1", "2", "▁", "3"], "": [], " \n": []}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert [r[0] for r in df.select(pieces(F.col("text"))).collect()] == list(cases.values())


def landed(spark, data, split_bytes):
    """Lines as text files in order, several a source, read in splits of so many bytes."""
    from weftline.session import fresh_folder
    from weftline.sources import corpora

    folder = fresh_folder(spark, "lines")
    df = spark.createDataFrame(data, LINE)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a small table is one range
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        corpora.write_ordered_lines(df, folder, ["line_no"])
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        lines = corpora.read_lines(spark, folder)
        n_splits = lines.select("file", "split").distinct().count()
        out = [rows(corpus.lines_in_splits_to_documents(lines, keep_tail)) for keep_tail in (False, True)]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = [rows(corpus.lines_to_documents(df, keep_tail).select("source_id", "doc_no", "text")) for keep_tail in (False, True)]
    return out, want, n_splits


def test_documents_from_files_cut_into_splits(spark):
    import random

    rng = random.Random(4)
    data = []
    for source in ("en", "01", None, "de"):
        texts = [rng.choice(["\n", "a\n", "b c\n", "é\r\n", " \n", "line of many words " * 3 + "\n"]) for _ in range(rng.randint(1, 300))]
        data += [(source, k * 5 + (1 << 40), t) for k, t in enumerate(texts)]
    data += [("long", k, "one document over many splits\n") for k in range(90)] + [("long", 90, "\n")]
    data += [("open", k, "never closed\n") for k in range(50)]
    rng.shuffle(data)
    for split_bytes in (64, 700, 1 << 20):
        got, want, n_splits = landed(spark, data, split_bytes)
        assert got == want
        assert n_splits > 20 or split_bytes > 64


def test_only_borders_of_splits_are_shuffled(spark):
    data = [("en", k, "\n" if k % 4 == 3 else f"line {k}\n") for k in range(400)]
    got, want, n_splits = landed(spark, data, 1 << 20)
    assert got == want and len(got[0]) == 100 and n_splits <= 5

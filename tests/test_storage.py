import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import corpus, telemetry
from weftline.plans import derived
from weftline.session import fresh_folder, workspace
from weftline.sources import corpora
from weftline.sources.tables import materialise
from weftline.streaming import ingest


def test_corpora_reduce_to_one_schema(spark, tmp_path):
    records = {
        "mc4": {"text": "a", "timestamp": "t", "url": "u"},
        "cc100": {"id": "0", "text": "a\n"},
        "oscar2023": {"text": "a", "meta": {"quality_warnings": ["tiny"], "other": 1}},
        "culturax": {"text": "a", "timestamp": "t", "url": "u", "source": "s"},
        "pile": {"text": "a", "meta": "{}"},
    }
    for name, record in records.items():
        for lang in ("de", "fr"):
            (tmp_path / name / f"lang={lang}").mkdir(parents=True)
            (tmp_path / name / f"lang={lang}" / "x.jsonl").write_text(json.dumps(record))
        got = corpora.read_corpus(spark, name, str(tmp_path / name), "de")
        assert got.columns == ["text", "lang", "corpus", "warnings"]
        assert got.count() == (2 if name == "pile" else 1)
        assert got.first()["warnings"] == (["tiny"] if name == "oscar2023" else None)
    with pytest.raises(ValueError):
        corpora.adapt(spark.range(1), "other")


def test_texts_by_suffix(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x\\ny", "more": 1}\n{"text": "z"}')
    (tmp_path / "b.txt").write_text("x\nz")
    assert rows(corpora.read_texts(spark, str(tmp_path / "a.jsonl"))) == [("x\ny",), ("z",)]
    assert rows(corpora.read_texts(spark, str(tmp_path / "b.txt"))) == [("x",), ("z",)]
    with pytest.raises(ValueError):
        corpora.read_texts(spark, str(tmp_path / "c.csv"))


@pytest.mark.parametrize("fmt", ["json", "text", "parquet"])
def test_split_round_trip(spark, tmp_path, fmt):
    texts = ["a\nb\n", "back\\slash \\n literal\n", "\\", "\n", "ü"]
    df = spark.createDataFrame([("de", "train" if i else "dev", t) for i, t in enumerate(texts)], "lang string, split string, text string")
    corpora.write_splits(df, str(tmp_path / fmt), fmt)
    back = corpora.read_splits(spark, str(tmp_path / fmt), T.StructType([T.StructField("text", T.StringType())]), fmt)
    assert rows(back.select("lang", "split", "text")) == rows(df)
    assert not (tmp_path / fmt / "lang=de" / "split=test").exists()


@pytest.mark.parametrize("fmt", ["json", "text"])
@pytest.mark.parametrize("split_bytes", ["134217728", "700"])
def test_ordered_splits_give_positions_back(spark, tmp_path, fmt, split_bytes):
    """Ties aside, the order written is the order read, also where files are read in pieces; null languages, nulls and odd texts stay."""
    lang = F.when(F.col("id") % 3 > 0, "de").when(F.col("id") % 2 == 0, "fr")
    text = F.concat(F.lit("a\r\\"), F.col("id").cast("string"), F.lit("\n\\n\u2028x"))
    df = spark.range(600).select(lang.alias("lang"), F.when(F.col("id") < 90, "dev").otherwise("train").alias("split"), F.md5(F.col("id").cast("string")).alias("order"), text.alias("text"))
    corpora.write_splits(df.repartition(5), f"file://{tmp_path}/s", fmt, order="order")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        back = corpora.read_ordered_splits(spark, f"file://{tmp_path}/s", T.StructType([T.StructField("text", T.StringType())]), fmt)
        got = {(r["lang"], r["split"], r["position"]): r["text"] for r in back.collect()}
        some = {(r["lang"], r["split"], r["position"]): r["text"] for r in back.where("lang = 'fr' and position < 7").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for r in sorted(df.collect(), key=lambda r: r["order"]):
        at = sum(1 for k in want if k[:2] == (r["lang"], r["split"]))
        want[r["lang"], r["split"], at] = r["text"]
    assert got == want and some == {k: t for k, t in want.items() if k[0] == "fr" and k[2] < 7}


def test_contiguous_shards(spark, tmp_path):
    corpora.write_contiguous(spark.range(1000).orderBy(F.rand(1)), str(tmp_path / "s"), "id", 7)
    files = sorted((tmp_path / "s").glob("part-*"))
    ids = [r["id"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert ids == list(range(1000))
    corpora.write_lines(spark.createDataFrame([("▁a ▁b",)], "line string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "▁a ▁b"


def test_materialise_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    (tmp_path / "in").write_text("x")
    inputs = [str(tmp_path / "in")]
    for _ in range(2):
        assert materialise(spark, "t", {"a": 1}, inputs, build, str(tmp_path)).count() == 3
    assert len(built) == 1
    materialise(spark, "t", {"a": 2}, inputs, build, str(tmp_path))
    (tmp_path / "in").write_text("xy")
    materialise(spark, "t", {"a": 1}, inputs, build, str(tmp_path))
    assert len(built) == 3


def test_workspace_is_the_checkpoint_folder(spark):
    assert workspace(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def land(spark, df, parts):
    """Files that arrive one after the other."""
    folder = fresh_folder(spark, "landing")
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_documents_equal_the_batch(spark):
    texts = {"a": ["x\n", "y\n", "\n", "z\n", "\n", "\n", "p\n"], "b": ["q\n", "r\n", "s\n", "t\n", "\n"], "c": ["only\n"]}
    data = [(s, i, t) for s, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(data, "source_id string, line_no long, text string")
    folder = fresh_folder(spark, "docs")
    # the border cuts an open document of a and b, and one batch has no line of c
    stream = land(spark, df, ["line_no < 2", "line_no between 2 and 3", "line_no > 3"])
    ingest.stream_documents(stream, folder).awaitTermination()
    got = spark.read.parquet(folder + "/out").select("source_id", "doc_no", "text")
    assert rows(got) == rows(corpus.lines_to_documents(df).select("source_id", "doc_no", "text"))


def test_streamed_rates_equal_the_batch(spark):
    df = derived.telemetry(spark, "/root/testdata/sf0.001").drop("event_id", "event_type")
    folder = fresh_folder(spark, "rates")
    ingest.stream_throughput(land(spark, df, ["step < 9", "step between 9 and 20", "step > 20"]), folder, 10, 2).awaitTermination()
    want = telemetry.throughput(df, 10, 2)
    got = spark.read.parquet(folder + "/out").select(*want.columns)
    near = lambda d: rows(d.select(*[F.round(c, 6) if "per_sec" in c and "flops" not in c else c for c in d.columns if "flops" not in c]))
    assert near(got) == near(want)


def test_restarted_stream_goes_on(spark):
    """A second run with more files continues from the state of the first."""
    df = spark.createDataFrame([("a", i, "\n" if i % 3 == 2 else f"l{i}\n") for i in range(10)], "source_id string, line_no long, text string")
    landing, folder = fresh_folder(spark, "landing"), fresh_folder(spark, "docs")
    for part in ("line_no < 4", "line_no >= 4"):
        df.where(part).coalesce(1).write.mode("append").parquet(landing)
        ingest.stream_documents(spark.readStream.schema(df.schema).parquet(landing), folder).awaitTermination()
    got = spark.read.parquet(folder + "/out").select("source_id", "doc_no", "text")
    assert rows(got) == rows(corpus.lines_to_documents(df).select("source_id", "doc_no", "text"))


def test_event_time_windows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "ts", (F.col("user_id") % 2).alias("run_id"), F.lit(0).alias("device"), F.lit(1).alias("samples"), F.lit(5).alias("tokens"), F.lit(0.5).alias("train_s")
    )
    stream = land(spark, df, ["true"])
    query = ingest.windowed_rates(stream, width="1 day").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("select sum(batches), sum(tokens), min(tokens_per_sec), max(tokens_per_sec), count(distinct start) > 20 from rates").first()
    assert tuple(got) == (df.count(), df.count() * 5, 10.0, 10.0, True)


def test_text_sink_keeps_every_character(spark, tmp_path):
    from pyspark.sql import types as T

    from weftline.sources import corpora

    texts = ["a\rb", "a\r\nb", "back\\slash", "\\n", "\\\n", "\\\\r\r", "nul\x00", "plain"]
    df = spark.createDataFrame([(t, "en", "train") for t in texts], "text string, lang string, split string")
    corpora.write_splits(df, f"file://{tmp_path}/t", "text")
    back = corpora.read_splits(spark, f"file://{tmp_path}/t", T.StructType([T.StructField("text", T.StringType())]), "text")
    assert sorted(r.text for r in back.collect()) == sorted(texts)


def test_streams_keep_null_sources_and_devices(spark):
    data = [(s, i, t) for s in (None, "a") for i, t in enumerate(["x\n", "\n", "y\n", "\n", "z\n", "w\n", "\n"])]
    df = spark.createDataFrame(data, "source_id string, line_no long, text string")
    folder = fresh_folder(spark, "docs")
    ingest.stream_documents(land(spark, df, ["line_no < 2", "line_no between 2 and 4", "line_no > 4"]), folder).awaitTermination()
    got = spark.read.parquet(folder + "/out").select("source_id", "doc_no", "text")
    assert rows(got) == rows(corpus.lines_to_documents(df).select("source_id", "doc_no", "text")) and got.count() == 6

    times = derived.telemetry(spark, "/root/testdata/sf0.001").drop("event_id", "event_type").where("step < 30")
    times = times.withColumn("device", F.when(F.col("device") != 0, F.col("device"))).withColumn("run_id", F.when(F.col("run_id") > 1, F.col("run_id")))
    times = times.where("run_id is not null or device is not null").where("run_id is null or run_id = 3")
    times = times.dropDuplicates(["run_id", "device", "step"])
    folder = fresh_folder(spark, "rates")
    ingest.stream_throughput(land(spark, times, ["step < 9", "step >= 9"]), folder, 5).awaitTermination()
    want = telemetry.throughput(times, 5)
    got = spark.read.parquet(folder + "/out")
    keys = ["run_id", "device", "step"]
    assert rows(got.select(*keys)) == rows(want.select(*keys)) and got.where("device is null").count() > 0


def test_event_time_windows_drop_what_is_too_late(spark):
    """A batch moves the watermark; rows that it passed two batches ago are dropped, rows in open windows count however old."""
    times = [("10:05", 1), ("10:55", 1), ("11:30", 2), ("11:31", 3), ("10:56", 4), ("11:02", 4), ("12:01", 4)]
    data = [(f"2024-01-01 {t}:00", None if n == 2 else 1, 0, 1, 5, 0.5, n) for t, n in times]
    df = spark.createDataFrame(data, "at string, run_id int, device int, samples int, tokens int, train_s double, n int").withColumn("ts", F.to_timestamp("at"))
    folder = fresh_folder(spark, "windows")
    ingest.stream_windows(land(spark, df, ["n = 1", "n = 2", "n = 3", "n = 4"]), folder).awaitTermination()
    got = [(r.start.hour, r.run_id, r.batches, r.tokens_per_sec) for r in ingest.latest_windows(spark, folder).collect()]
    assert sorted(got, key=str) == sorted([(10, 1, 2, 10.0), (11, None, 1, 10.0), (11, 1, 2, 10.0), (12, 1, 1, 10.0)], key=str)

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline.functions.draws import order_key
from weftline.operators import ordered, splits
from weftline.plans import registry


def frame(spark, n, seed=0, hot=True):
    rng = random.Random(seed)
    ids = rng.sample(range(10**9), n - 1) + [2**60]  # one far id: shards must not follow the id range
    return [(i, "hot" if hot and rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(20)) for i in ids]


def test_running_sums_match_a_plain_scan(spark):
    data = frame(spark, 3000)
    df = spark.createDataFrame(data, "id long, k string, v long")
    got = {r["id"]: (r["n"], r["s"]) for r in ordered.running_sums(df, ["id"], {"n": F.lit(1), "s": F.col("v")}, keys=["k"]).collect()}
    seen = {}
    for i, k, v in sorted(data):
        n, s = seen.get(k, (0, 0))
        assert got[i] == (n, s)
        seen[k] = (n + 1, s + v)
    assert len(got) == len(data)


def test_running_sums_without_key_and_with_few_rows(spark):
    for n in (1, 2, 700):
        data = sorted(frame(spark, n))
        df = spark.createDataFrame(data, "id long, k string, v long")
        got = [r["rank"] for r in ordered.ranked(df, ["id"]).orderBy("id").collect()]
        assert got == list(range(n))


def test_clustered_ids_are_cut_evenly(spark):
    # a third of all rows in a tiny id range
    df = spark.range(10000, 13000).union(spark.range(0, 6 * 10**9, 10**6))
    sizes = ordered.with_range_shard(df, "id").groupBy("_shard").count().agg(F.max("count")).first()[0]
    assert sizes < 9000 / 256 * 4


def test_more_rows_give_more_shards(spark):
    """With few rows a shard, the parts of a quantile range follow the order, and ranks stay right."""
    df = spark.range(0, 6 * 10**9, 10**6).union(spark.range(10000, 13000)).union(spark.createDataFrame([(None,), (5,), (5,)], "id long"))
    cut = ordered.with_range_shard(df, "id", shards=4, rows=100)
    spans = sorted((r["_shard"], r["lo"], r["hi"]) for r in cut.groupBy("_shard").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect())
    assert len(spans) > 40 and all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert ordered.with_range_shard(df.limit(0), "id", rows=1).count() == 0


def test_key_shards_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "KEY_SHARDS", 2)
    monkeypatch.setattr(ordered, "SHARD_ROWS", 10)
    df = spark.range(500).withColumn("_order", order_key(1, "id"))
    assert 40 <= df.select(ordered.key_shard(df, "_order").alias("s")).distinct().count() <= 50
    places = {r["id"]: r["position"] for r in splits.shuffle_global(df.select("id"), "id", seed=1).collect()}
    assert sorted(places, key=places.get) == [r["id"] for r in df.orderBy("_order").collect()]


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(frame(spark, 500), "id long, k string, v long")
    want = rows(splits.shuffle_global(df, "id"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(splits.shuffle_global(df.repartition(5), "id")) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("shards", [None, "key"])
def test_rank_marks_edges(spark, shards):
    df = spark.range(100).withColumn("_order", order_key(1, "id"))
    key, shard = ("_order", ordered.key_shard(df, "_order")) if shards else ("id", None)
    rules = {"none": lambda n: F.lit(0), "one": lambda n: F.lit(1), "some": lambda n: F.floor(n * 0.37), "all": lambda n: n, "past": lambda n: n + 5}
    marks = ordered.rank_marks(df, key, rules, shard)
    marked = df.withColumn("m", marks)
    got = marked.agg(*[F.count_if(ordered.within(F.col("m"), name, F.col(key))).alias(name) for name in rules]).first()
    assert got.asDict() == {"none": 0, "one": 1, "some": 37, "all": 100, "past": 100}


def test_windowed_equals_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") * 7919 % 97).alias("v"), F.lit("a").alias("k"))
    cut = ordered.windowed(df, ["k"], "p", 13, lambda f: {"s": F.sum("v").over(f), "n": F.count("v").over(f)}, block=40)
    frame_ = Window.partitionBy("k").orderBy("p").rowsBetween(-12, 0)
    plain = df.select("*", F.sum("v").over(frame_).alias("s"), F.count("v").over(frame_).alias("n"))
    assert rows(cut) == rows(plain)


@pytest.mark.parametrize("name", ["shuffle_global", "split_head", "split_tail", "read_slice", "epoch_order", "doc_offsets", "lines_to_docs"])
def test_only_shard_tables_are_in_one_partition(spark, name):
    """What is moved to a single partition is already aggregated, to one row or to one row per shard."""
    df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = [lines[i + 1 : i + 3] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    for below in found:
        assert re.search(r"Aggregate\(keys?=\[(_shard#\d+L?)?\]", "".join(below)), below


def test_splits_need_no_shuffle_of_the_documents(spark):
    """Texts are compared with the mark keys where they are read."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = splits.split_head(docs, 10, 10)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def test_split_bounds(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    count = lambda d: dict(d.groupBy("split").count().collect())
    assert count(splits.split_head(df, 5, 0)) == {"dev": 5, "train": 45}
    assert count(splits.split_head(df, 5, 7, 20)) == {"dev": 5, "test": 7, "train": 20}
    assert count(splits.split_tail(df, 5, 7, 20)) == {"dev": 5, "test": 7, "train": 20}
    assert count(splits.split_tail(df, 5, 7)) == {"dev": 5, "test": 7, "train": 38}
    assert splits.pre_discard(df, 1.5, 10).count() == 15
    assert splits.pre_discard(df, 1.5, 100).count() == 50
    assert splits.sample_limit(df, -1).count() == 50
    assert splits.sample_limit(df, 0).count() == 0


def test_epoch_order_is_a_permutation_per_epoch(spark):
    order = splits.epoch_order(spark.range(40).withColumnRenamed("id", "sample_id"), 3)
    seen = {}
    for r in order.collect():
        seen.setdefault(r["epoch"], {})[r["position"]] = r["sample_id"]
    assert all(sorted(s) == list(range(40)) and sorted(s.values()) == list(range(40)) for s in seen.values())
    assert seen[0] != seen[1]
    resumed = splits.resume_order(order, 6, 8)  # 48 samples: one epoch of 40 and 8 more
    assert resumed.groupBy("epoch").agg(F.min("position")).collect()[0][1] == 8
    train = splits.batch_assign(order, 12, True)
    assert train.count() == 3 * 36 and splits.batch_assign(order, 12, False).count() == 120
    plan = splits.step_plan(order, 2, 2, 2).where("epoch = 0 and position = 13").first()
    assert (plan["step"], plan["accumulation"], plan["device"]) == (1, 1, 0)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), (None, 3)], "k string, t int")
    out = ordered.ranked(df, ["t"], keys=["k"])
    assert sorted(((r.k or "", r.t, r["rank"]) for r in out.collect())) == [("", 1, 0), ("", 2, 1), ("", 3, 2), ("a", 1, 0)]

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline.operators import benchlog, evaluate, telemetry, tensors


def test_printed_times(spark):
    cases = {"500ms": 0.5, "59.99s": 59.99, "1:05m": 65.0, "1:00:05h": 3605.0, "2:01:00:01d": 2 * 86400 + 3601, "": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(benchlog.elapsed_seconds(F.col("t"))).collect()] == list(cases.values())


NAME = "run-bf16-true-g4---mb-2---activation_checkpointing-true---fsdp_sharding_strategy-FULL_SHARD---precision-bf16-true---gradient_accumulation_no_sync-false---use_paged_adamw-true.log"


def step(n, time, ram=None, wrapped=False):
    tail = f", max_cuda_ram: {ram} GB" if ram else ""
    parts = ["Step stats:", f"optimizer_step: {n}, iter: 1,", f"global_step_time: {time}{tail}"]
    return ("\n" if wrapped else " ").join(parts)


def test_log_parsing(spark, tmp_path):
    good = ["max_cuda_ram: 99.5 GB", "noise", *[step(i, "1.50s", 40 + i, wrapped=i % 2 == 0) for i in range(1, 14)]]
    short = ["args.num_devices=2", *[step(i, "1:05m") for i in range(1, 6)], "out of memory"]
    (tmp_path / NAME).write_text("\n".join(good))
    (tmp_path / NAME.replace("g4", "g8")).write_text("\n".join(short))
    logs = benchlog.read_logs(spark, str(tmp_path))
    steps = benchlog.log_steps(logs)
    mine = [tuple(r) for r in steps.where(F.col("file") == NAME).orderBy("block").select("block", "step", "time", "ram").collect()]
    # step 1 is not measured, nothing is read after step 11
    assert mine == [(0, None, None, 99.5), (1, None, None, 41.0), *[(i, i, 1.5, 40.0 + i) for i in range(2, 12)]]
    summary = {r["devices"]: r for r in benchlog.run_summary(steps, benchlog.log_config(logs)).collect()}
    assert summary[4]["gpu_hours"] == pytest.approx(1.5 * 7680 * 4 / 3600) and summary[4]["std_s"] == 0 and summary[4]["max_ram"] == 99.5
    assert summary[2]["oom"] and summary[2]["mean_s"] is None  # the count in the content comes first
    pairs = {r["file"]: (r["pairs"], r["oom"]) for r in benchlog.log_oom(logs).collect()}
    # a block in one line takes the line after it, which here opens the next block
    assert pairs[NAME] == (0, True)
    odd = [("a", "Step stats:\nStep stats:\noptimizer_step: 1"), ("b", "Step stats:\nStep stats: optimizer_step: 1\nStep stats:\noptimizer_step: 2"), ("c", ""), ("d", "Step stats:\noptimizer_step: 1\ntime\n" * 3)]
    got = {r["file"]: r["pairs"] for r in benchlog.log_oom(spark.createDataFrame(odd, "file string, content string")).collect()}
    assert got == {"a": 0, "b": 2, "c": 0, "d": 3}


def test_best_and_speedup(spark):
    data = [("a", "bf16-true", 2, False, 2.0), ("b", "bf16-true", 2, True, None), ("c", "bf16-mixed", 2, False, 3.0), ("d", "bf16-mixed", 2, False, 3.0)]
    data += [("e", "bf16-true", 4, False, 1.0), ("f", "bf16-mixed", 4, True, None)]
    df = spark.createDataFrame(data, "file string, precision string, devices int, oom boolean, mean_s double").withColumn("gpu_hours", F.col("mean_s") * F.col("devices"))
    best = benchlog.best_config(df)
    assert {(r["precision"], r["devices"]): r["file"] for r in best.collect()} == {
        ("bf16-true", 2): "a", ("bf16-mixed", 2): "c", ("bf16-true", 4): "e", ("bf16-mixed", 4): "f",
    }
    gain = {r["devices"]: r["speedup_percent"] for r in benchlog.speedup(best).collect()}
    assert gain == {2: pytest.approx(50.0), 4: math.inf}
    places = {r["file"]: r["place"] for r in benchlog.ranked_report(df).collect()}
    assert places == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0, "f": 0}


def skipped(grid, failed):
    """Configurations ruled out, one after the other in grid order, with skips counting as failures."""
    values, bad = benchlog.GRID, set(failed)
    easier = {
        "mb": lambda v: [m for m in values["mb"] if m <= v],
        "devices": lambda v: [d for d in values["devices"] if d >= v],
    }
    out = set()
    for i, cfg in enumerate(grid):
        options = [easier[a](v) if a in easier else sorted({values[a][0], v}) for a, v in zip(benchlog.AXES, cfg)]
        hit = any(all(b[j] in options[j] for j in range(7)) for b in bad)
        if hit:
            out.add(i)
            bad.add(cfg)
    return out


def test_dominated(spark):
    grid = benchlog.config_grid(spark)
    assert grid.count() == 384 and grid.select(*benchlog.AXES).distinct().count() == 384
    configs = [tuple(r)[1:] for r in grid.orderBy("config").collect()]
    rng = random.Random(1)
    for n in (0, 1, 4):
        failed = rng.sample(configs, n)
        schema = grid.drop("config").schema
        got = {r["config"] for r in benchlog.dominated(grid, spark.createDataFrame(failed, schema)).where("dominated").collect()}
        assert got == skipped(configs, failed)


def test_rates_fill_the_window_first(spark):
    data = [("r", 0, i, 2, 10 * i, 0.5 + i, 1.0 + i, 1e9) for i in range(30)]
    df = spark.createDataFrame(data, "run_id string, device int, step long, samples int, tokens long, train_s double, e2e_s double, flops double")
    got = telemetry.throughput(df, window=4, world=3).orderBy("step").collect()
    for i, r in enumerate(got):
        if i < 3:
            assert r["tokens_per_sec"] is None
        else:
            part = data[i - 3 : i + 1]
            assert r["device_tokens_per_sec"] == pytest.approx(sum(d[4] for d in part) / sum(d[5] for d in part))
            assert r["samples_per_sec_e2e"] == pytest.approx(3 * 8 / sum(d[6] for d in part))
    evals = spark.createDataFrame([("r", 0, 2, 5.0), ("r", 0, 9, 1.0)], "run_id string, device int, step long, eval_s double")
    totals = telemetry.time_totals(df, evals, 3).orderBy("step").collect()
    assert [t["time_val"] for t in totals] == [0.0] * 3 + [5.0] * 7 + [6.0] * 20
    assert totals[4]["time_train"] == pytest.approx(sum(d[5] for d in data[:5])) and totals[0]["samples"] == 6


def test_utilisation(spark):
    data = [("NVIDIA H100 80GB HBM3", "bf16-true", 494.75e12), ("NVIDIA A10G", "transformer-engine", 1.0), ("card", "bf16-true", 1.0), ("Tesla T4", "8-true", 13e12), ("Tesla V100S-PCIE-32GB", "32-true", 8.2e12), ("V4", "64-true", 27.5e12)]
    df = spark.createDataFrame(data, "device_name string, precision string, flops_per_sec double")
    got = {r["device_name"]: (r["utilisation"], r["unknown_precision"]) for r in telemetry.utilisation(df).collect()}
    assert got == {"NVIDIA H100 80GB HBM3": (0.5, False), "NVIDIA A10G": (None, True), "card": (None, False), "Tesla T4": (0.1, False), "Tesla V100S-PCIE-32GB": (0.5, False), "V4": (0.1, False)}


def test_step_metrics(spark):
    df = spark.createDataFrame([("r", i, 0.1, float(i)) for i in range(11)], "run_id string, iter long, fetch_s double, iter_s double")
    got = rows(telemetry.step_metrics(df, 2, 8, 16, log_interval=2).select("optimizer_step", "iter_time", "iters", "tokens", "samples"), "optimizer_step")
    assert got == [(1, 0.5, 2, 128, 8), (3, 4.5, 6, 384, 24), (5, 8.5, 10, 640, 40)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([("c", [2.0, 2.0]), ("r", [0.0, 64.0, 1.0]), ("r", [0.5]), ("r", []), ("n", [-3.0])], "tensor string, values array<double>")
    got = {(r["tensor"], r["bin"]): r["count"] for r in tensors.tensor_hist(df).collect()}
    assert len(got) == 3 * 64
    assert {k: v for k, v in got.items() if v} == {("c", 32): 2, ("n", 32): 1, ("r", 0): 2, ("r", 1): 1, ("r", 63): 1}
    norms = {r["tensor"]: tuple(r)[1:] for r in tensors.tensor_norms(df).collect()}
    assert norms["r"] == (4, 65.5, pytest.approx(math.sqrt(64**2 + 1.25)))


def test_tensor_groups(spark):
    data = [("_forward_module.model.embed_tokens.weight", True, [0.0] * 6), ("_fsdp_wrapped_module.norm", False, [0.0] * 2), ("layer._orig_mod.w", True, [0.0] * 2)]
    df = spark.createDataFrame(data, "name string, trainable boolean, values array<double>")
    got = {r["class"]: (r["elements"], r["weight_decay"], r["percent_trainable"]) for r in tensors.tensor_groups(df).collect()}
    assert got == {"embedding": (6, False, 80.0), "norm": (2, False, 80.0), "rest": (2, True, 80.0)}
    cleaned = df.select(tensors.clean_name(F.col("name"))).collect()
    assert [r[0] for r in cleaned] == ["model.embed_tokens.weight", "norm", "layer.w"]


def test_likelihood(spark):
    data = [(0, 0, 5, 1.0), (0, 1, 6, 3.0), (0, 1, -1, 99.0), (1, 2, 7, 5.0), (2, 3, 8, 7.0)]
    df = spark.createDataFrame(data, "batch_id long, doc_id long, label int, nll double")
    r = evaluate.eval_nll(df, 2, 4).first()
    assert (r["batches"], r["tokens"], r["loss"], r["per_token_nll"], r["per_doc_nll"]) == (2, 3, 3.5, 3.0, 2.25)
    assert r["perplexity"] == pytest.approx(math.exp(3.5)) and r["token_perplexity"] == pytest.approx(math.exp(3.0))
    both = {r["doc_id"]: r["difference"] for r in evaluate.eval_compare(df, df.withColumn("nll", F.col("nll") / 2)).collect()}
    assert both == {0: 0.5, 1: 1.5, 2: 2.5, 3: 3.5}

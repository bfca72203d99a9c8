"""Benchmark logs: parsing, summaries, rankings, the configuration grid and its pruning.

Logs are (file, content); a configuration is encoded in the file name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import ranked

# Measured steps, steps of a whole run, needed step times.
FIRST_STEP, LAST_STEP = 2, 11
RUN_STEPS = 7680
NEEDED_TIMES = 10

# The benchmarked settings, from the least to the most memory where that is ordered.
GRID = {
    "precision": ["bf16-true", "bf16-mixed"],
    "devices": [8, 4, 2],
    "mb": [1, 2, 4, 8],
    "activation_checkpointing": ["true", "false"],
    "fsdp_sharding_strategy": ["FULL_SHARD", "SHARD_GRAD_OP"],
    "gradient_accumulation_no_sync": ["false", "true"],
    "use_paged_adamw": ["true", "false"],
}
AXES = list(GRID)

_MEASURED = r"optimizer_step: (?:[2-9]|1[01])(?![0-9])"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log files (file, content). One log is small, so it is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))


def _number(text: Column, pattern: str, kind: str = "double") -> Column:
    """First group as a number, null where the pattern is absent."""
    return F.regexp_extract(text, pattern, 1).try_cast(kind)


_CLOCK = r"global_step_time: ([0-9:.]+(?:ms|s|m|h|d))"


def elapsed_seconds(printed: Column) -> Column:
    """Seconds of a printed time: 5ms, 1.23s, 1:05m, 1:00:05h or 1:02:03:04d; null for an empty text."""
    parts = F.split(F.regexp_replace(printed, "[a-z]+$", ""), ":")

    def part(from_end: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(-from_end)).try_cast("double"), F.lit(0.0))

    clock = part(1) + 60 * part(2) + 3600 * part(3) + 86400 * part(4)
    return F.when(printed.endswith("ms"), part(1) / 1000).when(printed != "", clock)


def _parse_blocks(content: Column) -> Column:
    """Step, time and memory of the text after each ``Step stats:``.

    The first step number inside the measured range counts, then the first time on that line or later.
    Each stage is its own transform, so a pattern runs once per block.
    """
    cut = F.transform(
        F.split(content, "Step stats:"),
        lambda b, i: F.struct(i.cast("long").alias("block"), b.alias("text"), F.regexp_extract(b, rf"(?sm)^([^\n]*{_MEASURED}.*)", 1).alias("tail")),
    )
    found = F.transform(
        cut,
        lambda b: F.struct(
            b["block"].alias("block"),
            b["text"].alias("text"),
            _number(b["tail"], "optimizer_step: ([0-9]+)", "int").alias("step"),
            F.regexp_extract(b["tail"], _CLOCK, 1).alias("printed"),
        ),
    )

    def read(b: Column) -> Column:
        # after the time of the last measured step nothing more is read
        last = (b["step"] == LAST_STEP) & (b["printed"] != "")
        text = F.when(last, F.regexp_extract(b["text"], r"(?s)^(.*?global_step_time: [^\n]*)", 1)).otherwise(b["text"])
        rams = F.transform(F.regexp_extract_all(text, F.lit(r"max_cuda_ram: ([0-9.]+) GB"), F.lit(1)), lambda r: r.try_cast("double"))
        return F.struct(
            b["block"].alias("block"),
            b["step"].alias("step"),
            elapsed_seconds(b["printed"]).alias("time"),
            F.array_max(rams).alias("ram"),
            F.coalesce(last, F.lit(False)).alias("last"),
        )

    return F.transform(found, read)


def log_steps(logs: DataFrame) -> DataFrame:
    """Step, time and memory per step block of each log (file, content), until the last measured step has its time.

    A log is parsed inside its row, so there is no shuffle however many logs there are.
    """
    parsed = logs.select("file", _parse_blocks(F.col("content")).alias("blocks"))
    stop = F.array_min(F.transform(F.filter("blocks", lambda b: b["last"]), lambda b: b["block"]))
    kept = F.filter("blocks", lambda b: (b["time"].isNotNull() | b["ram"].isNotNull()) & (F.col("stop").isNull() | (b["block"] <= F.col("stop"))))
    rows = parsed.withColumn("stop", stop).select("file", F.explode(kept).alias("b"))
    return rows.select("file", "b.block", "b.step", "b.time", "b.ram")


def config_columns(name: Column) -> dict[str, Column]:
    """The seven settings in a log name."""
    return {
        "precision": F.regexp_extract(name, "-(bf16-[a-z]+)-g", 1),
        "devices": _number(name, "-g([0-9]+)---", "int"),
        "mb": _number(name, "--mb-([0-9]+)", "int"),
        "activation_checkpointing": F.regexp_extract(name, "--activation_checkpointing-([a-z]+)", 1),
        "fsdp_sharding_strategy": F.regexp_extract(name, "--fsdp_sharding_strategy-([A-Z_]+)", 1),
        "gradient_accumulation_no_sync": F.regexp_extract(name, "--gradient_accumulation_no_sync-([a-z]+)", 1),
        "use_paged_adamw": F.regexp_extract(name, "--use_paged_adamw-([a-z]+)", 1),
    }


def log_config(logs: DataFrame) -> DataFrame:
    """One row per log; the device count comes from its content first, from its name second."""
    columns = config_columns(F.col("file"))
    columns["devices"] = F.coalesce(_number(F.col("content"), r"args\.num_devices=([0-9]+)", "int"), columns["devices"])
    columns["precision"] = F.when(columns["precision"] == "", "unknown").otherwise(columns["precision"])
    return logs.select("file", *[c.alias(n) for n, c in columns.items()])


def run_summary(steps: DataFrame, configs: DataFrame) -> DataFrame:
    """Mean and population deviation of the step time and GPU hours of a whole run; too few times mean out of memory.

    Times are summed in whole milliseconds, so equal runs have equal means in any order of addition.
    """
    mean = F.sum(F.round(F.col("time") * 1000).cast("long")) / 1000 / F.count("time")
    per_file = steps.groupBy("file").agg(
        F.count("time").alias("times"), mean.alias("mean_s"), F.stddev_pop("time").alias("std_s"), F.max("ram").alias("max_ram")
    )
    joined = configs.join(per_file, "file", "left").withColumn("oom", F.coalesce(F.col("times"), F.lit(0)) < NEEDED_TIMES)
    fine = ~F.col("oom")
    return joined.select(
        *configs.columns,
        "oom",
        F.when(fine, F.col("mean_s")).alias("mean_s"),
        F.when(fine, F.col("std_s")).alias("std_s"),
        F.when(fine, F.col("max_ram")).alias("max_ram"),
        F.when(fine, F.col("mean_s") * RUN_STEPS * F.col("devices") / 3600).alias("gpu_hours"),
    )


def best_config(summary: DataFrame) -> DataFrame:
    """Fastest run per precision and device count; out of memory never beats a time, ties go by name."""
    rank = F.struct(F.col("oom"), F.coalesce(F.col("mean_s"), F.lit(0.0)), F.col("file"))
    best = summary.groupBy("precision", "devices").agg(F.min_by(F.struct("file", "oom", "mean_s", "gpu_hours"), rank).alias("b"))
    return best.select("precision", "devices", "b.*")


def speedup(best: DataFrame) -> DataFrame:
    """Gain of pure over mixed precision at the same device count in percent; infinite when mixed ran out of memory."""
    mixed = best.where(F.col("precision") == "bf16-mixed").select("devices", F.col("gpu_hours").alias("mixed_hours"), F.col("oom").alias("mixed_oom"))
    pure = best.where(F.col("precision") == "bf16-true").select("devices", F.col("gpu_hours").alias("pure_hours"), F.col("oom").alias("pure_oom"))
    gain = (
        F.when(F.col("pure_oom"), None)
        .when(F.col("mixed_oom"), F.lit(float("inf")))
        .otherwise((F.col("mixed_hours") / F.col("pure_hours") - 1) * 100)
    )
    return pure.join(mixed, "devices").withColumn("speedup_percent", gain)


def ranked_report(summary: DataFrame) -> DataFrame:
    """Runs with their place by hours inside (devices, precision), out of memory last."""
    hours = F.when(F.col("oom"), F.lit(float("inf"))).otherwise(F.col("gpu_hours"))
    return ranked(summary.withColumn("_hours", hours), ["_hours", "file"], "place", keys=["devices", "precision"]).drop("_hours")


def config_grid(spark: SparkSession) -> DataFrame:
    """All combinations of the settings, numbered in nested-loop order: the number is read in mixed base."""
    sizes = [len(v) for v in GRID.values()]
    total = reduce(lambda a, b: a * b, sizes)
    at, below, columns = F.col("id"), total, []
    for (name, values), size in zip(GRID.items(), sizes):
        below //= size
        choice = (F.floor(at / below) % size + 1).cast("int")
        columns.append(F.element_at(F.array(*[F.lit(v) for v in values]), choice).alias(name))
    return spark.range(total).select(F.col("id").alias("config"), *columns)


def dominated(grid: DataFrame, failed: DataFrame) -> DataFrame:
    """Configurations presumed out of memory because a no more demanding one was.

    Every configuration lists the settings that need no more memory on each axis; a failed run equal
    to one of the combinations rules it out. An equi-join, bounded by the square of the grid.
    """

    def easier(name: str) -> Column:
        values = GRID[name]
        if name == "mb":
            return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= F.col(name))
        if name == "devices":
            return F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v >= F.col(name))
        return F.array_distinct(F.array(F.lit(values[0]), F.col(name)))

    expanded = grid
    for name in AXES:
        expanded = expanded.withColumn(f"_{name}", F.explode(easier(name)))
    bad = failed.select(*[F.col(n).alias(f"_{n}") for n in AXES]).distinct()
    hit = expanded.join(bad, [f"_{n}" for n in AXES], "left_semi").select("config").distinct()
    return grid.join(hit.withColumn("_hit", F.lit(True)), "config", "left").select(
        *grid.columns, F.coalesce("_hit", F.lit(False)).alias("dominated")
    )


def log_oom(logs: DataFrame) -> DataFrame:
    """Logs with too few lines that open a block and are followed by a step number on the next line.

    The line after an opening one belongs to it, whatever it says, and opens nothing itself.
    """

    def read(state: Column, text: Column) -> Column:
        stepped = (state["open"] & text.contains("optimizer_step:")).cast("long")
        return F.struct((~state["open"] & text.contains("Step stats:")).alias("open"), (state["pairs"] + stepped).alias("pairs"))

    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("pairs"))
    pairs = F.aggregate(F.split("content", "\n"), start, read)["pairs"]
    return logs.select("file", pairs.alias("pairs")).withColumn("oom", F.col("pairs") < NEEDED_TIMES)

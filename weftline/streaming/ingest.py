"""Corpus build and telemetry as streams.

Each micro-batch runs the batch operators, so a hot source or run is spread over tasks there too.
What must outlive a batch (open document tails, the last rows of a window) is a small table per
batch number in the shared folder. A replayed batch reads the same state and overwrites the same
output folder, so results are exactly-once and survive a lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.constants import SHUFFLE_SEED
from ..functions.draws import order_key
from ..operators.corpus import join_lines, normalise_text, number_documents, quality_filter
from ..operators.splits import split_hash
from ..operators.telemetry import DEVICE, throughput
from ..sources.tables import exists, remove


def _start(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _state(batch: DataFrame, folder: str, number: int, empty: DataFrame) -> DataFrame:
    """State left by the batch before, or nothing at the start."""
    path = f"{folder}/state/batch={number - 1}"
    spark = batch.sparkSession
    return spark.read.schema(empty.schema).parquet(path) if exists(spark, path) else empty


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys in which null meets null; the result has the keys once, from the side that has the row."""
    own = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    joined = left.withColumn("_here", F.lit(True)).join(own, [left[k].eqNullSafe(own[f"_of_{k}"]) for k in keys], how)
    if how == "left_semi":
        return joined.drop("_here")
    whole = {k: F.when(F.col("_here"), F.col(k)).otherwise(F.col(f"_of_{k}")) for k in keys} if how == "full" else {}
    return joined.withColumns(whole).drop("_here", *[f"_of_{k}" for k in keys])


def _keep(state: DataFrame, folder: str, number: int) -> None:
    """Write the state after a batch. Only the last batch can be replayed, so older states go."""
    state.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
    remove(state.sparkSession, f"{folder}/state/batch={number - 2}")


def stream_ingest(stream: DataFrame, folder: str, dev_share: float, test_share: float, seed: int = SHUFFLE_SEED) -> StreamingQuery:
    """Filter, normalise, split by hash and write; rows of a micro-batch are its shuffle buffer.

    All steps but the order are stateless. Rows need (doc_id, text, warnings); output is by split.
    """
    clean = normalise_text(quality_filter(stream)).drop("warnings")
    labelled = split_hash(clean, dev_share, test_share)

    def step(batch: DataFrame, number: int) -> None:
        mixed = batch.withColumn("_order", order_key(seed, "doc_id"))
        ordered = mixed.repartitionByRange("split", "_order").sortWithinPartitions("split", "_order").drop("_order")
        ordered.write.mode("overwrite").partitionBy("split").json(f"{folder}/out/batch={number}")

    return _start(labelled, folder, step)


def stream_documents(stream: DataFrame, folder: str) -> StreamingQuery:
    """Lines (source_id, line_no, text) to documents; the open document of each source is kept for the next batch.

    Documents are numbered by the breaks seen so far in their source, so the result equals the batch operator's.
    Lines of a source must arrive in order between batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("source_id", "line_no", "text", F.lit(0).cast("long").alias("closed"))
        empty = rows.limit(0)
        known = _state(batch, folder, number, empty)
        seen = known.groupBy("source_id").agg(F.max("closed").alias("closed_before"))  # one row per source
        lines = known.where(F.col("text").isNotNull()).unionByName(rows).select("source_id", "line_no", "text")
        placed = _meet(number_documents(lines), seen, ["source_id"], "left").withColumn("before", F.coalesce("closed_before", F.lit(0)))
        closed = F.col("doc_no") < F.col("doc_no_total")
        done = placed.where(closed).withColumn("doc_no", F.col("doc_no") + F.col("before"))
        join_lines(done).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        tail = placed.where(~closed & (F.col("text") != "\n"))
        open_lines = tail.select("source_id", "line_no", "text", (F.col("before") + F.col("doc_no_total")).alias("closed"))
        totals = lines.groupBy("source_id").agg(F.count_if(F.col("text") == "\n").alias("breaks"))
        # one mark row per source keeps its break count even when no line is open
        marks = _meet(totals, seen, ["source_id"], "full").select(
            "source_id",
            F.lit(-1).cast("long").alias("line_no"),
            F.lit(None).cast("string").alias("text"),
            (F.coalesce("breaks", F.lit(0)) + F.coalesce("closed_before", F.lit(0))).alias("closed"),
        )
        _keep(open_lines.unionByName(marks), folder, number)

    return _start(stream, folder, step)


def stream_throughput(stream: DataFrame, folder: str, window: int, world: int = 1) -> StreamingQuery:
    """Rolling rates over the last ``window`` batches of a device; each batch keeps the last ``window - 1`` rows per device.

    Rows carry a dense ``step`` per device and arrive in order between micro-batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("fresh", F.lit(True))
        known = _state(batch, folder, number, rows.limit(0))
        both = known.withColumn("fresh", F.lit(False)).unionByName(rows)
        rates = throughput(both, window, world)
        new = _meet(rates, rows.select(*DEVICE, "step"), [*DEVICE, "step"], "left_semi")
        new.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last = both.groupBy(*DEVICE).agg(F.max("step").alias("_last"))
        kept = _meet(both, last, DEVICE, "inner").where(F.col("step") > F.col("_last") - (window - 1)).drop("_last")
        _keep(kept, folder, number)

    return _start(stream, folder, step)


def stream_windows(stream: DataFrame, folder: str, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> StreamingQuery:
    """``windowed_rates`` written as they change: each micro-batch writes the windows it touched, as they stand then.

    Windows live in Spark's keyed state until the watermark has passed them; later rows of theirs are dropped. A replayed batch
    overwrites its folder. ``latest_windows`` reads the last state of each window.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return (
        windowed_rates(stream, time, width, lateness)
        .writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The last row written for each window and device; null devices are a group like any other."""
    rows = spark.read.parquet(f"{folder}/out").drop("batch")
    values = [c for c in rows.columns if c not in ("start", *DEVICE, "batch_no")]
    last = rows.groupBy("start", *DEVICE).agg(F.max(F.struct("batch_no", *values)).alias("last"))
    return last.select("start", *DEVICE, *[f"last.{c}" for c in values])


def windowed_rates(stream: DataFrame, time: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Samples and tokens per second in tumbling event-time windows, late rows up to the watermark included."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    grouped = stamped.groupBy(F.window(time, width), *DEVICE).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("samples").alias("samples"), F.sum("tokens").alias("tokens"), F.sum("train_s").alias("train_s")
    )
    return grouped.select(
        F.col("window.start").alias("start"), *DEVICE, "batches", "samples", "tokens", (F.col("tokens") / F.col("train_s")).alias("tokens_per_sec")
    )



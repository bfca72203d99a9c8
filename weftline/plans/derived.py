"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_VOCAB_SIZE
from ..functions.text import clip_words
from ..operators import benchlog, encode, index, merges, ordered, packing, vocab
from ..session import spread
from ..sources.tables import materialise

SMALL_VOCAB = 2048  # leaves rare pieces to byte tokens
BLOCK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents spread over the cores, for work that is heavy per character."""
    return spread(documents(spark, sf_dir))


def warned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    marks = F.array_append(
        F.filter(
            F.array(
                F.when(F.col("n_chars") < 300, "tiny"),
                F.when(doc % 5 == 1, "noisy"),
                F.when(doc % 7 == 2, "adult"),
                F.when(doc % 4 == 1, "curated"),
            ),
            lambda m: m.isNotNull(),
        ),
        F.when(doc % 2 == 0, "long_lines"),
    )
    return documents(spark, sf_dir).withColumn("warnings", F.when(doc % 3 != 0, marks))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with their newline, one break after every document; an order number per source (a string has under 2^31 lines)."""
    parts = F.concat(F.transform(F.split("text", "\n"), lambda p: F.concat(p, F.lit("\n"))), F.array(F.lit("\n")))
    flat = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("source_id"), F.posexplode(parts).alias("pos", "text"))
    return flat.select("source_id", (F.shiftleft("doc_id", 31) + F.col("pos")).alias("line_no"), "text")


def ragged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    wrapped = (
        F.when(doc % 17 == 5, "\n")
        .when(doc % 17 == 7, " \t\n")
        .when(doc % 4 == 0, F.concat(F.lit(" \t"), text, F.lit("\n\n")))
        .when(doc % 4 == 1, F.concat(F.lit(" "), text, F.lit("　")))
        .when(doc % 4 == 2, F.concat(F.lit(" \n"), text, F.lit("\r\n")))
        .otherwise(text)
    )
    return documents(spark, sf_dir).select("doc_id", wrapped.alias("text"))


def corpus_vocab(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Vocabulary over all documents, written once per size."""

    def build() -> DataFrame:
        return vocab.build_vocab(vocab.word_freq(texts(spark, sf_dir)), size)

    return materialise(spark, "vocab", {"size": size}, [f"{sf_dir}/documents.parquet"], build)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and their counts, written once."""
    return materialise(spark, "word-counts", {}, [f"{sf_dir}/documents.parquet"], lambda: vocab.word_freq(texts(spark, sf_dir)))


def merge_vocab(spark: SparkSession, sf_dir: str, size: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    """Vocabulary by merges over all documents, written once per size."""

    def build() -> DataFrame:
        return merges.merge_vocab(word_counts(spark, sf_dir), size)

    return materialise(spark, "merge-vocab", {"size": size}, [f"{sf_dir}/documents.parquet"], build)


def language_vocab(spark: SparkSession, sf_dir: str, lang: str, size: int = DEFAULT_VOCAB_SIZE) -> DataFrame:
    def build() -> DataFrame:
        mine = texts(spark, sf_dir).where(F.col("lang") == lang)
        return vocab.build_vocab(vocab.word_freq(mine), size)

    return materialise(spark, "vocab", {"size": size, "lang": lang}, [f"{sf_dir}/documents.parquet"], build)


def encoded(spark: SparkSession, sf_dir: str, size: int, **options) -> DataFrame:
    """Documents as token rows (doc_id, ids, len), not written."""
    encoder = encode.vocab_encoder(corpus_vocab(spark, sf_dir, size))
    return encode.encode_corpus(texts(spark, sf_dir).select("doc_id", "text"), encoder, **options)


def tokens(spark: SparkSession, sf_dir: str, size: int = SMALL_VOCAB) -> DataFrame:
    """The tokenised set, written once and read by every later step."""
    return materialise(spark, "tokens", {"size": size}, [f"{sf_dir}/documents.parquet"], lambda: encoded(spark, sf_dir, size))


def members(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    return packing.pack_greedy(tokens(spark, sf_dir), block)


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_offsets(tokens(spark, sf_dir).select("doc_id", "len"))


def language_vectors(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    """Vocabulary of a language with one vector per id: the vectors given are taken in rank order."""
    ids = language_vocab(spark, sf_dir, lang).withColumn("vec_id", F.col("id") - 260)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return ids.join(vectors, "vec_id").select("token", "id", "vec")


def auxiliary(spark: SparkSession, sf_dir: str, lang: str, min_count: int = 10) -> DataFrame:
    """Per token of a language, a 20-value vector of its counts by document source.

    A deterministic stand-in for trained vectors; like a trainer, it leaves out rare tokens.
    """

    def build() -> DataFrame:
        mine = texts(spark, sf_dir).where(F.col("lang") == lang)
        slot = F.pmod(F.regexp_extract("source", "([0-9]+)", 1).cast("int"), F.lit(20))
        counts = vocab.word_freq(mine.withColumn("slot", slot), ["slot"])
        columns = [F.sum(F.when(F.col("slot") == i, F.col("freq")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(20)]
        wide = counts.groupBy("token").agg(F.sum("freq").alias("n"), *columns).where(F.col("n") >= min_count)
        return wide.select("token", F.array(*[f"c{i}" for i in range(20)]).alias("aux"))

    return materialise(spark, "aux", {"lang": lang, "min": min_count}, [f"{sf_dir}/documents.parquet"], build)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches: run, device, dense step, samples, tokens, times, flops. Written once, as a trainer would."""
    return materialise(spark, "telemetry", {"time_unit": "1/1024"}, [f"{sf_dir}/events.parquet"], lambda: _telemetry(spark, sf_dir))


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    named = table(spark, sf_dir, "events").select(
        (user % 8).alias("run_id"),
        (F.floor(user / 8) % 2).alias("device"),
        "event_id",
        "event_type",
        F.lit(1).alias("samples"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        # fractions of a power of two, so that sums are exact in any order
        ((F.round(F.col("value") * 100) + 1) / 1024).alias("train_s"),
        ((F.round(F.col("value") * 100) + 9) / 1024).alias("e2e_s"),
    ).withColumn("flops", F.col("tokens") * 6000000000.0)
    return ordered.ranked(named, ["event_id"], "step", keys=["run_id", "device"])


def timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training batches with their time, and ``at``, the time in microseconds."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        "ts",
        (user % 8).alias("run_id"),
        (F.floor(user / 8) % 2).alias("device"),
        F.lit(1).alias("samples"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        ((F.round(F.col("value") * 100) + 1) / 1024).alias("train_s"),
    )


def tensor_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(
        F.array(
            *[
                F.lit(n)
                for n in (
                    "_forward_module.model.embed_tokens.weight",
                    "_forward_module.lm_head.weight",
                    "model._orig_mod.norm.weight",
                    "model.layers.0._fsdp_wrapped_module.input_layernorm.weight",
                    "model.layers.0._checkpoint_wrapped_module.self_attn.q_proj.weight",
                )
            ]
        ),
        (F.col("label") % 5 + 1).cast("int"),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.concat(names, F.lit("."), F.col("label")).alias("name"),
        F.col("label").alias("tensor"),
        (F.col("vec_id") % 4).alias("shard"),
        (F.col("label") % 2 == 0).alias("trainable"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as benchmark logs (file, content): twelve steps per file, files over the configurations in turn.

    Every second log wraps its blocks over three lines; demanding configurations stop after step 5. Written once, as landed logs are.
    """
    return spread(materialise(spark, "logs", {}, [f"{sf_dir}/events.parquet"], lambda: _log_files(spark, sf_dir)))


def _log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    file_no = F.floor(F.col("event_id") / 12)
    base = events.select(
        file_no.alias("f"),
        (F.col("event_id") % 12 + 1).alias("step"),
        (file_no % 384).alias("config"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.floor(F.round(F.col("value") * 100).cast("long") / 5) + 50).alias("cs"),
    )
    grid = benchlog.config_grid(spark)
    named = base.join(F.broadcast(grid), "config")  # 384 rows
    demand = F.col("mb") * F.when(F.col("precision") == "bf16-mixed", 2).otherwise(1) * F.when(F.col("activation_checkpointing") == "false", 2).otherwise(1)
    kept = named.where((demand < 4 * F.col("devices")) | (F.col("step") <= 5))
    name = F.concat(
        F.lit("r"), F.floor(F.col("f") / 384), F.lit("-run-"), "precision", F.lit("-g"), "devices", F.lit("---mb-"), "mb",
        F.lit("---activation_checkpointing-"), "activation_checkpointing", F.lit("---fsdp_sharding_strategy-"), "fsdp_sharding_strategy",
        F.lit("---precision-"), "precision", F.lit("---gradient_accumulation_no_sync-"), "gradient_accumulation_no_sync",
        F.lit("---use_paged_adamw-"), "use_paged_adamw", F.lit(".log"),
    )
    seconds = F.floor(F.col("cs") / 100)
    short = F.concat(seconds, F.lit("."), F.lpad((F.col("cs") % 100).cast("string"), 2, "0"), F.lit("s"))
    long = F.concat(F.floor(seconds / 60), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit("m"))
    time = F.concat(F.lit("global_step_time: "), F.when(seconds < 60, short).otherwise(long))
    ram = F.concat(F.lit(", max_cuda_ram: "), 40 + F.col("k") % 40, F.lit("."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit(" GB"))
    head = F.concat(F.lit("optimizer_step: "), "step", F.lit(", iter: "), F.col("step") * 4, F.lit(", "))
    wrapped = F.col("f") % 2 == 1
    body = F.when(wrapped, F.array(F.lit("Step stats:"), head, F.concat(time, ram))).otherwise(
        F.array(F.concat(F.lit("Step stats: "), head, time, ram))
    )
    first = F.when(F.col("f") % 3 == 0, F.concat(F.lit("args.num_devices="), "devices")).otherwise(F.lit("starting"))
    lines_of = F.when(F.col("step") == 1, F.concat(F.array(first), body)).otherwise(body)
    text = kept.select(name.alias("file"), "step", F.array_join(lines_of, "\n").alias("text"))
    # twelve events make one log
    parts = text.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("step", "text"))).alias("parts"))
    return parts.select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("content"))


def scored(spark: SparkSession, sf_dir: str, size: int = SMALL_VOCAB, batch: int = 16, clip: int | None = None) -> DataFrame:
    """Tokens scored by add-one unigram counts, in batches of documents by position."""
    every = tokens(spark, sf_dir, size)
    counts = every.select(F.explode("ids").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    nll = counts.select("label", (-F.ln((F.col("n") + 1) / (total + F.lit(size)))).alias("nll"))
    if clip is None:
        placed = ordered.ranked(every, ["doc_id"], "place")
    else:  # ranked before they are encoded: a rank reads its rows several times
        short = texts(spark, sf_dir).select("doc_id", clip_words(F.col("text"), clip).alias("text"))
        placed = encode.encode_corpus(ordered.ranked(short, ["doc_id"], "place"), encode.vocab_encoder(corpus_vocab(spark, sf_dir, size)), clip=clip)
    placed = placed.withColumn("batch_id", F.floor(F.col("place") / batch))
    flat = placed.select("batch_id", "doc_id", F.explode("ids").alias("label"))
    return flat.join(F.broadcast(nll), "label")  # as many rows as the vocabulary has ids


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every device of each run as a sequence of iterations of its own."""
    return telemetry(spark, sf_dir).select(
        (F.col("run_id") * 2 + F.col("device")).alias("run_id"), F.col("step").alias("iter"), (F.col("e2e_s") - F.col("train_s")).alias("fetch_s"), F.col("train_s").alias("iter_s")
    )


def device_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Achieved rate per event as reported by a device under a precision."""
    names = ["NVIDIA H100 80GB HBM3", "NVIDIA A100-SXM4-80GB", "NVIDIA A10G", "Tesla T4", "NVIDIA H100 PCIe", "Some other card", "Tesla V100S-PCIE-32GB", "V4"]
    precisions = ["bf16-true", "bf16-mixed", "16-mixed", "32-true", "transformer-engine"]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        pick(names, F.col("user_id") % 8).alias("device_name"),
        pick(precisions, F.col("event_id") % 5).alias("precision"),
        (F.col("value") * 1e12).alias("flops_per_sec"),
    )

"""One registered query per operator, over the given tables.

Arrays leave as comma-joined text and vectors as millionths, so that values compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import ensure_bos
from ..functions.constants import BOS_ID, EOS_ID, FIRST_PIECE_ID, SHUFFLE_SEED
from ..functions.draws import order_key
from ..functions.text import pieces
from ..operators import aligned, benchlog, bpe, corpus, encode, evaluate, index, merges, overlap, packing
from ..operators import samples as shaping
from ..operators import scripts, splits, telemetry, tensors, transfer, vocab
from ..session import fresh_folder, spread, written
from ..sources import corpora
from ..sources.tables import materialise
from ..streaming import ingest
from . import derived

BLOCK = derived.BLOCK
DEV, TEST, TRAIN_CAP = 100, 100, 500

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(values: Column | str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def millionths(value: Column) -> Column:
    return F.round(value * 1000000).cast("long")


def vector_text(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "vec"]
    return df.select(*kept, joined(F.transform("vec", millionths)).alias("vec"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- corpus ---


@query
def source_normalise(spark, sf_dir):
    """Documents in the five raw layouts, read back through the adapters."""
    docs = derived.warned_documents(spark, sf_dir)
    common = ["doc_id", "lang", "text"]
    raw = {
        "mc4": docs.select(*common, F.lit("t").alias("timestamp"), F.col("source").alias("url")),
        "cc100": docs.select(*common, F.col("doc_id").cast("string").alias("id")),
        "oscar2023": docs.select(*common, F.struct(F.col("warnings").alias("quality_warnings")).alias("meta")),
        "culturax": docs.select(*common, F.lit("t").alias("timestamp"), F.lit("u").alias("url"), "source"),
        "pile": docs.select(*common, F.col("source").alias("meta")),
    }
    out = None
    for i, (name, frame) in enumerate(raw.items()):
        part = corpora.adapt(frame.where(F.col("doc_id") % len(raw) == i), name)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "text", "lang", "corpus", F.array_join("warnings", ",", "-").alias("warnings"))


@query
def read_slice(spark, sf_dir):
    return splits.read_slice(derived.documents(spark, sf_dir).select("doc_id", "lang"), 0.5)


@query
def scan_jsonl(spark, sf_dir):
    folder = fresh_folder(spark, "scan") + "/train.jsonl"
    derived.documents(spark, sf_dir).select("text").write.json(folder)
    return corpora.read_texts(spark, folder).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query
def sink_roundtrip(spark, sf_dir):
    """Splits written in shuffled order as JSON and as text, read back with their positions; a split of size 0 leaves no folder."""
    docs = splits.split_head(derived.documents(spark, sf_dir).select("doc_id", "text", "lang"), DEV, 0, TRAIN_CAP)
    mixed = docs.withColumn("order", order_key(SHUFFLE_SEED, "doc_id"))
    folder = fresh_folder(spark, "sink")
    schema = T.StructType([T.StructField("text", T.StringType())])
    out = None
    for fmt in ("json", "text"):
        corpora.write_splits(mixed, f"{folder}/{fmt}", fmt, order="order")
        part = corpora.read_ordered_splits(spark, f"{folder}/{fmt}", schema, fmt).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query
def materialise_reuse(spark, sf_dir):
    """A table built once and read twice through its fingerprint."""

    def build() -> DataFrame:
        return derived.documents(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))

    inputs = [f"{sf_dir}/documents.parquet"]
    first = materialise(spark, "language_sizes", {}, inputs, build)
    again = materialise(spark, "language_sizes", {}, inputs, build)
    return first.join(again.select("lang", F.col("docs").alias("docs_again")), "lang")


@query
def token_shards(spark, sf_dir):
    """Tokens in contiguous shards: read back, no file overlaps the next one."""
    folder = fresh_folder(spark, "shards")
    corpora.write_contiguous(derived.tokens(spark, sf_dir).select("doc_id", "ids"), folder, "doc_id", 16)
    back = spark.read.parquet(folder).select("*", F.col("_metadata.file_name").alias("file"))
    sum_ids = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    files = back.groupBy("file").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("t"), F.sum(sum_ids).alias("s"))
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("int")
    # files are numbered in order: each must end before the next one starts; 16 rows
    ordered = F.array_sort(F.collect_list(F.struct(number.alias("no"), "lo", "hi")))
    out = files.agg(F.sum("n").alias("docs"), F.sum("t").alias("tokens"), F.sum("s").alias("id_sum"), ordered.alias("o"))
    wrong = F.filter(F.transform("o", lambda f, i: F.coalesce(F.get("o", i - 1)["hi"] >= f["lo"], F.lit(False))), lambda bad: bad)
    return out.select("docs", "tokens", "id_sum", F.size(wrong).alias("overlaps"))


@query
def token_text(spark, sf_dir):
    return encode.token_text(derived.texts(spark, sf_dir).select("doc_id", "text"))


@query
def quality_filter(spark, sf_dir):
    return corpus.quality_filter(derived.warned_documents(spark, sf_dir)).select("doc_id", "lang")


@query
def lines_to_docs(spark, sf_dir):
    return corpus.lines_to_documents(derived.lines(spark, sf_dir))


@query
def lines_from_files(spark, sf_dir):
    """Lines landed as text files in a folder per source, read in splits and put together again."""
    folder = fresh_folder(spark, "landed-lines")
    corpora.write_ordered_lines(derived.lines(spark, sf_dir), folder, ["line_no"])
    return corpus.lines_in_splits_to_documents(corpora.read_lines(spark, folder))


@query
def normalise_text(spark, sf_dir):
    return corpus.normalise_text(derived.ragged_documents(spark, sf_dir))


@query
def clip_words(spark, sf_dir):
    return corpus.clip_documents(derived.documents(spark, sf_dir).select("doc_id", "text"), 64)


# --- order and splits ---


@query
def shuffle_global(spark, sf_dir):
    return splits.shuffle_global(derived.documents(spark, sf_dir).select("doc_id", "text"))


@query
def shuffle_buffered(spark, sf_dir):
    return splits.shuffle_buffered(derived.documents(spark, sf_dir).select("doc_id", "text"), 100)


@query
def pre_discard(spark, sf_dir):
    return splits.pre_discard(derived.documents(spark, sf_dir).select("doc_id", "lang"), 1.5, 300)


@query
def split_head(spark, sf_dir):
    return splits.split_head(derived.documents(spark, sf_dir).select("doc_id", "text"), DEV, TEST, TRAIN_CAP)


@query
def split_tail(spark, sf_dir):
    return splits.split_tail(derived.documents(spark, sf_dir).select("doc_id", "text"), DEV, TEST, TRAIN_CAP)


@query
def split_hash(spark, sf_dir):
    return splits.split_hash(derived.documents(spark, sf_dir).select("doc_id", "text"), 0.05, 0.05)


@query
def sample_limit(spark, sf_dir):
    return splits.sample_limit(derived.documents(spark, sf_dir).select("doc_id", "text"), 200)


def _order(spark, sf_dir, epochs: int = 3) -> DataFrame:
    return splits.epoch_order(derived.documents(spark, sf_dir).select(F.col("doc_id").alias("sample_id")), epochs)


@query
def epoch_order(spark, sf_dir):
    return _order(spark, sf_dir)


@query
def resume_order(spark, sf_dir):
    return splits.resume_order(_order(spark, sf_dir), 37, 32)


@query
def batch_assign(spark, sf_dir):
    order = _order(spark, sf_dir)
    train = splits.batch_assign(order, 48, True).withColumn("kind", F.lit("train"))
    return train.unionByName(splits.batch_assign(order, 48, False).withColumn("kind", F.lit("val")))


@query
def step_plan(spark, sf_dir):
    """Samples and tokens per step, with the slots and devices they use."""
    plan = splits.step_plan(_order(spark, sf_dir), 2, 4, 4)
    sized = plan.join(derived.tokens(spark, sf_dir).select(F.col("doc_id").alias("sample_id"), "len"), "sample_id")
    return sized.groupBy("epoch", "step").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("len").alias("tokens"),
        F.sum("accumulation").alias("slots"),
        F.sum("device").alias("devices"),
    )


# --- vocabulary and tokens ---


@query
def word_freq(spark, sf_dir):
    return vocab.word_freq(vocab.training_text(derived.texts(spark, sf_dir)))


@query
def char_coverage(spark, sf_dir):
    words = vocab.word_freq(derived.texts(spark, sf_dir))
    return vocab.char_coverage(vocab.char_freq(words)).select("char", "freq")


@query
def pretokenise(spark, sf_dir):
    found = pieces(F.col("text"))
    out = derived.texts(spark, sf_dir).select("doc_id", F.octet_length("text").alias("bytes"), found.alias("p"))
    return out.select("doc_id", "bytes", (F.col("bytes") <= 8192).alias("in_limit"), F.size("p").alias("n"), F.md5(F.array_join("p", " ")).alias("pieces"))


@query
def bpe_pairs(spark, sf_dir):
    return bpe.pair_counts(bpe.symbol_words(vocab.word_freq(derived.texts(spark, sf_dir))))


@query
def bpe_merges(spark, sf_dir):
    """All merges that a vocabulary of the default size has room for beside the special and byte tokens and the characters. No SQL:
    tests hold them against training one by one."""
    words = derived.word_counts(spark, sf_dir)
    return bpe.train_merges(words, max(0, vocab.DEFAULT_VOCAB_SIZE - FIRST_PIECE_ID - vocab.char_freq(words).count()))


@query
def bpe_vocab(spark, sf_dir):
    """The vocabulary of the default size by merges over all words of all documents. No SQL: tests hold it against training one by one."""
    return derived.merge_vocab(spark, sf_dir)


@query
def encode_bpe(spark, sf_dir):
    """All documents encoded with the merge vocabulary. No SQL: tests hold it against plain joins by rank."""
    encoder = merges.merge_vocab_encoder(derived.merge_vocab(spark, sf_dir))
    return _token_rows(encode.encode_corpus(derived.texts(spark, sf_dir).select("doc_id", "text"), encoder))


def _token_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "len", joined("ids").alias("ids"))


@query
def encode_vocab(spark, sf_dir):
    return _token_rows(derived.encoded(spark, sf_dir, derived.SMALL_VOCAB))


@query
def encode_bytes(spark, sf_dir):
    """A vocabulary without pieces: every id is a byte token."""
    return _token_rows(derived.encoded(spark, sf_dir, 260))


@query
def encode_special(spark, sf_dir):
    return _token_rows(derived.encoded(spark, sf_dir, derived.SMALL_VOCAB, prepend_bos=True, append_eos=True))


@query
def val_clipped(spark, sf_dir):
    dev = splits.split_head(derived.documents(spark, sf_dir).select("doc_id", "text"), DEV, 0).where(F.col("split") == "dev")
    encoder = encode.vocab_encoder(derived.corpus_vocab(spark, sf_dir, derived.SMALL_VOCAB))
    return _token_rows(encode.encode_corpus(dev.drop("split"), encoder, prepend_bos=True, clip=64))


@query
def doc_offsets(spark, sf_dir):
    return derived.offsets(spark, sf_dir)


@query
def offset_check(spark, sf_dir):
    return index.offset_check(derived.offsets(spark, sf_dir))


@query
def manifest(spark, sf_dir):
    words = derived.corpus_vocab(spark, sf_dir, vocab.DEFAULT_VOCAB_SIZE)
    return vocab.manifest(words, "pieces", False, True, BOS_ID, EOS_ID, clip=64)


@query
def vocab_diff(spark, sf_dir):
    return vocab.vocab_diff(*[vocab.with_specials(derived.language_vocab(spark, sf_dir, lang)) for lang in ("en", "de")])


# --- samples ---


@query
def pack_greedy(spark, sf_dir):
    return derived.members(spark, sf_dir).select("sample_id", "doc_id")


@query
def pack_report(spark, sf_dir):
    return packing.pack_report(derived.members(spark, sf_dir), derived.tokens(spark, sf_dir), BLOCK)


def _sample_text(df: DataFrame) -> DataFrame:
    extra = [joined("segment_ids").alias("segment_ids")] if "segment_ids" in df.columns else []
    return df.select("sample_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"), *extra)


def _packed(spark, sf_dir, segment_mask: bool) -> DataFrame:
    """Study runs mark documents with bos and carry segments; plain runs use eos as separator."""
    tokens = derived.tokens(spark, sf_dir)
    access = shaping.PACKED if segment_mask else shaping.PACKED_PLAIN
    return shaping.training_samples(derived.members(spark, sf_dir), tokens, BLOCK, access, bos=segment_mask, eos=not segment_mask)


@query
def sample_packed(spark, sf_dir):
    return _sample_text(_packed(spark, sf_dir, True)).drop("segment_ids")


@query
def sample_segments(spark, sf_dir):
    return _sample_text(_packed(spark, sf_dir, True)).select("sample_id", "segment_ids")


@query
def sample_packed_plain(spark, sf_dir):
    return _sample_text(_packed(spark, sf_dir, False))


def _single(spark, sf_dir, access: str) -> DataFrame:
    return _sample_text(shaping.document_samples(derived.tokens(spark, sf_dir), BLOCK, access, eos=True))


@query
def sample_padded(spark, sf_dir):
    return _single(spark, sf_dir, shaping.PADDED)


@query
def sample_truncated(spark, sf_dir):
    return _single(spark, sf_dir, shaping.TRUNCATED)


@query
def sample_full(spark, sf_dir):
    return _single(spark, sf_dir, shaping.FULL)


@query
def sample_contiguous(spark, sf_dir):
    return _sample_text(shaping.contiguous_samples(derived.tokens(spark, sf_dir), BLOCK))


@query
def segment_lengths(spark, sf_dir):
    """Over the written samples in the batches of an epoch, as a trainer would read them."""
    inputs = [f"{sf_dir}/documents.parquet"]
    samples = materialise(spark, "packed", {"block": BLOCK, "vocab": derived.SMALL_VOCAB}, inputs, lambda: _packed(spark, sf_dir, True))
    order = splits.epoch_order(samples.select("sample_id"), 1)
    batches = splits.batch_assign(order, 8, False).select("sample_id", "batch_id", "position")
    return shaping.segment_lengths(samples.select("sample_id", "segment_ids").join(batches, "sample_id"), order="position")


@query
def label_mask(spark, sf_dir):
    """Label rules on shifted ids that hold marks and pad ids, with both optional flags."""
    ids = F.concat(ensure_bos(F.col("ids")), F.array(F.lit(3), F.lit(EOS_ID)), F.slice("ids", 1, 2))
    shifted = derived.tokens(spark, sf_dir).select("doc_id", ids.alias("d"))
    pairs = shifted.select(
        "doc_id",
        F.slice("d", F.lit(1), F.size("d") - 1).alias("input_ids"),
        F.slice("d", F.lit(2), F.size("d") - 1).alias("labels"),
    )
    out = shaping.label_mask(pairs, mask_bos=True, mask_eos=True)
    return out.select("doc_id", joined("labels").alias("labels"))


# --- vocabulary transfer ---


def _target(spark, sf_dir) -> DataFrame:
    return spread(derived.language_vocab(spark, sf_dir, "de").select("token", "id"))


def _source(spark, sf_dir) -> DataFrame:
    return derived.language_vectors(spark, sf_dir, "en")


@query
def init_mean(spark, sf_dir):
    """Rows for a matrix padded to a multiple of 128."""
    padded = transfer.padded_targets(_target(spark, sf_dir), 260, 128)
    return vector_text(transfer.init_mean(padded, _source(spark, sf_dir)))


@query
def init_random(spark, sf_dir):
    width = transfer.vector_width(_source(spark, sf_dir))
    return vector_text(transfer.init_random(_target(spark, sf_dir), width))


@query
def init_rank_copy(spark, sf_dir):
    return vector_text(transfer.init_rank_copy(_target(spark, sf_dir), _source(spark, sf_dir)))


@query
def init_identity(spark, sf_dir):
    return vector_text(transfer.init_identity(_target(spark, sf_dir), _source(spark, sf_dir)))


def _categories(df: DataFrame) -> DataFrame:
    return scripts.script_groups(scripts.token_script(df.select("token", "id")))


@query
def token_script(spark, sf_dir):
    every = derived.corpus_vocab(spark, sf_dir, vocab.DEFAULT_VOCAB_SIZE).select("token", "id")
    return scripts.token_script(every)


@query
def script_groups(spark, sf_dir):
    return _categories(derived.corpus_vocab(spark, sf_dir, vocab.DEFAULT_VOCAB_SIZE))


def _known_categories(spark, sf_dir) -> DataFrame:
    source = _source(spark, sf_dir)
    return _categories(source).join(source.select("id", "vec"), "id")


@query
def init_script(spark, sf_dir):
    return vector_text(transfer.init_by_category(_categories(_target(spark, sf_dir)), _known_categories(spark, sf_dir)))


@query
def init_heuristic(spark, sf_dir):
    return vector_text(transfer.init_heuristic(_categories(_target(spark, sf_dir)), _known_categories(spark, sf_dir)))


@query
def init_overlap(spark, sf_dir):
    target, source = _target(spark, sf_dir), _source(spark, sf_dir)
    auxiliary = derived.auxiliary(spark, sf_dir, "de")
    return vector_text(overlap.init_overlap(target, source, auxiliary))


@query
def overlap_fuzzy(spark, sf_dir):
    source = derived.language_vocab(spark, sf_dir, "en").select("token", "id")
    return overlap.match_overlap(_target(spark, sf_dir), source, exact=False)


def _aligned(spark, sf_dir):
    """Dictionary: the tokens spelt alike in both languages."""
    source_space, target_space = derived.auxiliary(spark, sf_dir, "en"), derived.auxiliary(spark, sf_dir, "de")
    dictionary = source_space.join(target_space.select("token"), "token").select(
        F.col("token").alias("source_token"), F.col("token").alias("target_token")
    )
    return aligned.init_aligned(_target(spark, sf_dir), _source(spark, sf_dir), source_space, target_space, dictionary)


@query
def init_aligned(spark, sf_dir):
    return _aligned(spark, sf_dir).select("token", "id", F.size("vec").alias("dim"))


@query
def init_aligned_vectors(spark, sf_dir):
    """The vectors themselves; SQL cannot express the rotation."""
    return vector_text(_aligned(spark, sf_dir))


# --- evaluation, telemetry, tensors ---


@query
def eval_nll(spark, sf_dir):
    """All batches, and a cap of 320 documents."""
    rows = derived.scored(spark, sf_dir)
    out = evaluate.eval_nll(rows, 16).withColumn("cap", F.lit(-1))
    out = out.unionByName(evaluate.eval_nll(rows, 16, 320).withColumn("cap", F.lit(320)))
    return rounded(out, "loss", "perplexity", "per_token_nll", "per_doc_nll", "token_perplexity")


@query
def eval_compare(spark, sf_dir):
    """Two vocabularies on the same clipped documents."""
    left = derived.scored(spark, sf_dir, derived.SMALL_VOCAB, clip=64)
    right = derived.scored(spark, sf_dir, 1024, clip=64)
    return rounded(evaluate.eval_compare(left, right), "left_nll", "right_nll", "difference")


def _rounded_rates(rates: DataFrame) -> DataFrame:
    """Rates to six digits, operations per second in units of 10^12."""
    out = [F.round(F.col(c) / 1e12, 6).alias(c.replace("flops", "tflops")) if "flops" in c else F.round(c, 6).alias(c) for c in rates.columns]
    return rates.select(*out)


@query
def throughput(spark, sf_dir):
    return _rounded_rates(telemetry.throughput(derived.telemetry(spark, sf_dir), window=100, world=2))


@query
def time_totals(spark, sf_dir):
    every = derived.telemetry(spark, sf_dir)
    evals = every.where(F.col("event_type") == "error").select("run_id", "device", "step", (F.col("train_s") * 3).alias("eval_s"))
    return rounded(telemetry.time_totals(every, evals, world=2), "time_train", "time_val", "time_total")


@query
def utilisation(spark, sf_dir):
    out = telemetry.utilisation(derived.device_rates(spark, sf_dir))
    return rounded(out, "utilisation").select("event_id", "device_class", "precision", "peak", "utilisation", "unknown_precision")


@query
def step_metrics(spark, sf_dir):
    out = telemetry.step_metrics(derived.iterations(spark, sf_dir), accumulation=4, batch=256, block=4096, log_interval=5)
    return rounded(out, "data_fetch_time", "iter_time")


@query
def tensor_hist(spark, sf_dir):
    return rounded(tensors.tensor_hist(derived.tensor_shards(spark, sf_dir)), "edge_low", "edge_high")


@query
def tensor_norms(spark, sf_dir):
    return rounded(tensors.tensor_norms(derived.tensor_shards(spark, sf_dir)), "l1_norm", "l2_norm")


@query
def tensor_groups(spark, sf_dir):
    return rounded(tensors.tensor_groups(derived.tensor_shards(spark, sf_dir)), "percent_trainable")


# --- benchmark logs ---


def _summary(spark, sf_dir) -> DataFrame:
    logs = derived.log_files(spark, sf_dir)
    return benchlog.run_summary(benchlog.log_steps(logs), benchlog.log_config(logs))


@query
def log_steps(spark, sf_dir):
    return benchlog.log_steps(derived.log_files(spark, sf_dir))


@query
def log_config(spark, sf_dir):
    return benchlog.log_config(derived.log_files(spark, sf_dir))


@query
def run_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), "mean_s", "std_s", "gpu_hours")


@query
def best_config(spark, sf_dir):
    return rounded(benchlog.best_config(_summary(spark, sf_dir)), "mean_s", "gpu_hours")


@query
def speedup(spark, sf_dir):
    out = benchlog.speedup(benchlog.best_config(_summary(spark, sf_dir)))
    return rounded(out, "mixed_hours", "pure_hours", "speedup_percent")


@query
def ranked_report(spark, sf_dir):
    out = benchlog.ranked_report(written(_summary(spark, sf_dir), "summary"))
    return rounded(out.select("devices", "precision", "file", "oom", "gpu_hours", "place"), "gpu_hours")


@query
def config_grid(spark, sf_dir):
    """The grid with the logs and measured steps found for each configuration."""
    logs = derived.log_files(spark, sf_dir)
    steps = benchlog.log_steps(logs).groupBy("file").agg(F.count("time").alias("times"))
    runs = benchlog.log_config(logs).join(steps, "file", "left")
    found = runs.groupBy(*benchlog.AXES).agg(F.count(F.lit(1)).alias("logs"), F.sum("times").alias("times"))
    grid = benchlog.config_grid(spark).join(found, benchlog.AXES, "left")
    return grid.select(
        "config", *benchlog.AXES, F.coalesce("logs", F.lit(0)).alias("logs"), F.coalesce("times", F.lit(0)).alias("times")
    )


@query
def dominated(spark, sf_dir):
    """Pruning by the configurations that failed in all their repetitions."""
    failed = _summary(spark, sf_dir).groupBy(*benchlog.AXES).agg(F.bool_and("oom").alias("oom")).where("oom")
    return benchlog.dominated(benchlog.config_grid(spark), failed).select("config", "dominated")


@query
def log_oom(spark, sf_dir):
    return benchlog.log_oom(derived.log_files(spark, sf_dir))


# --- streams ---


def _streamed(spark, df: DataFrame, order: str, start: Callable[[DataFrame, str], object], parts: int = 3) -> str:
    """Land a table in parts along ``order``, each as as many files as Spark writes, and let the stream go on after each part.

    The stream starts again from its checkpoint, so what arrived in a part is one micro-batch. Rows without an order come first.
    """
    landing, folder = fresh_folder(spark, "landing"), fresh_folder(spark, "stream")
    bounds = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    low, width = bounds["lo"] or 0, ((bounds["hi"] or 0) - (bounds["lo"] or 0)) // parts + 1
    part = F.coalesce(F.floor((F.col(order) - low) / width), F.lit(0))
    for i in range(parts):
        df.where(part == i).write.mode("append").parquet(landing)
        start(spark.readStream.schema(df.schema).parquet(landing), folder).awaitTermination()
    return f"{folder}/out"


@query
def stream_ingest(spark, sf_dir):
    docs = derived.warned_documents(spark, sf_dir).select("doc_id", "text", "warnings")
    out = _streamed(spark, docs, "doc_id", lambda s, f: ingest.stream_ingest(s, f, 0.05, 0.05))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return spark.read.schema(schema).json(out).select("doc_id", "split", "text")


@query
def stream_docs(spark, sf_dir):
    out = _streamed(spark, derived.lines(spark, sf_dir), "line_no", ingest.stream_documents)
    return spark.read.parquet(out).select("source_id", "doc_no", "text")


@query
def stream_throughput(spark, sf_dir):
    rows = derived.telemetry(spark, sf_dir).drop("event_id", "event_type")
    out = _streamed(spark, rows, "step", lambda s, f: ingest.stream_throughput(s, f, 100, 2))
    return _rounded_rates(spark.read.parquet(out).drop("batch"))


@query
def stream_windows(spark, sf_dir):
    """Rates by hours of event time; the rows arrive in order of time, so none is late."""
    out = _streamed(spark, derived.timed_batches(spark, sf_dir), "at", ingest.stream_windows)
    rates = ingest.latest_windows(spark, out.removesuffix("/out"))
    return rates.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "run_id", "device", "batches", "samples", "tokens", F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


# --- flagship ---


def german_packing(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """How many packed samples does the German corpus give, and how full are they?"""

    def build() -> DataFrame:
        german = corpus.normalise_text(corpora.adapt(derived.texts(spark, sf_dir), "mc4", "de")).select("doc_id", "text")
        words = vocab.build_vocab(vocab.word_freq(german))
        return encode.encode_corpus(german, encode.vocab_encoder(words))

    tokens = materialise(spark, "german_tokens", {}, [f"{sf_dir}/documents.parquet"], build)
    members = packing.pack_greedy(tokens, block)
    shaped = shaping.packed_samples(members, tokens, block, bos=True, eos=False, segment_mask=True)
    scored = F.size(F.filter("labels", lambda v: v != -1))
    facts = shaped.select(scored.alias("scored"), F.array_max("segment_ids").alias("segments"))
    out = facts.agg(F.sum("scored").alias("scored_labels"), F.max("segments").alias("max_segments"))
    report = packing.pack_report(members, tokens, block)
    return report.withColumn("facts", out.select(F.struct("scored_labels", "max_segments").alias("f")).scalar()).select("*", "facts.*").drop("facts")


QUERIES["german_packing"] = german_packing


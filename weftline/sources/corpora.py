"""Readers of landed corpora, all reduced to one schema, and corpus sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StructField("text", T.StringType())
_STAMPED = [T.StructField("timestamp", T.StringType()), T.StructField("url", T.StringType())]

# Record layout of each corpus.
SCHEMAS = {
    "mc4": T.StructType([_TEXT, *_STAMPED]),
    "cc100": T.StructType([T.StructField("id", T.StringType()), _TEXT]),
    "oscar2023": T.StructType(
        [_TEXT, T.StructField("meta", T.StructType([T.StructField("quality_warnings", T.ArrayType(T.StringType()))]))]
    ),
    "culturax": T.StructType([_TEXT, *_STAMPED, T.StructField("source", T.StringType())]),
    "pile": T.StructType([_TEXT, T.StructField("meta", T.StringType())]),
}
MONOLINGUAL = {"pile"}


def adapt(df: DataFrame, corpus: str, lang: str | None = None) -> DataFrame:
    """Raw records to (text, lang, corpus, warnings), with the record id where there is one."""
    if corpus not in SCHEMAS:
        raise ValueError(f"unknown corpus: {corpus}")
    warnings = F.col("meta.quality_warnings") if corpus == "oscar2023" else F.lit(None).cast("array<string>")
    language = F.col("lang") if "lang" in df.columns else F.lit(lang)
    ident = ["doc_id"] if "doc_id" in df.columns else []
    out = df.select(*ident, "text", language.alias("lang"), F.lit(corpus).alias("corpus"), warnings.alias("warnings"))
    return out.where(F.col("lang") == lang) if lang and corpus not in MONOLINGUAL else out


def read_corpus(spark: SparkSession, corpus: str, path: str, lang: str | None = None) -> DataFrame:
    """Landed JSON lines of a corpus; a ``lang=`` folder level is pruned to the language asked for."""
    raw = spark.read.schema(SCHEMAS[corpus]).json(path)
    return adapt(raw, corpus, lang)


def read_lines(spark: SparkSession, path: str, source: str = "source_id") -> DataFrame:
    """Lines of landed text files with their order: (source, file, split, at, text), one line feed at the end of each.

    Large files are read in splits; ``split`` is where a line's split starts in its file, and ``at`` grows along the split. So
    (file, split, at) is the order of the lines, whatever the splits are. ``source`` is a folder column; carriage returns stay.
    """
    layout = T.StructType([T.StructField("value", T.StringType()), T.StructField(source, T.StringType())])  # no guess at the folders' type
    rows = spark.read.schema(layout).option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    return rows.select(F.col(source).alias("source_id"), *place, F.concat("value", F.lit("\n")).alias("text"))


def write_ordered_lines(df: DataFrame, path: str, order: list[str], source: str = "source_id") -> None:
    """Lines (source, order, text) as text files in a folder per source: by file name, then by line, they are in order."""
    slim = df.select(source, *order, F.regexp_replace("text", "\n$", "").alias("value"))
    slim.repartitionByRange(source, *order).sortWithinPartitions(source, *order).select(source, "value").write.partitionBy(source).text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts for tokenisation, by suffix: JSON lines with a ``text`` field, or plain lines."""
    plain = path.rstrip("/")
    if plain.endswith((".json", ".jsonl")):
        return spark.read.schema(T.StructType([_TEXT])).json(path)
    if plain.endswith(".txt"):
        return spark.read.text(path).withColumnRenamed("value", "text")
    raise ValueError(f"expected .json, .jsonl or .txt: {path}")


def write_splits(df: DataFrame, path: str, fmt: str = "json", order: str | None = None) -> None:
    """One folder per language and split. A split without rows writes nothing.

    With ``order`` the rows of a split are in that order, by number of the file, then by line; ``read_ordered_splits`` gives
    their places back. The column itself is not written. The text format keeps one document per line by escaping
    backslashes, line feeds and carriage returns.
    """
    writer = df
    if order:
        place = ["lang", "split", order]
        writer = df.repartitionByRange(*place).sortWithinPartitions(*place)
    if fmt == "text":
        escaped = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        escaped = F.replace(escaped, F.lit("\r"), F.lit("\\r"))
        writer = writer.select("lang", "split", escaped.alias("text"))
    elif order:
        writer = writer.drop(order)
    writer.write.mode("overwrite").partitionBy("lang", "split").format(fmt).save(path)


def _unescaped(line: str) -> Column:
    # Between escaped backslashes, the other escapes stand alone.
    plain = F.transform(F.split(line, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(plain, "\\")


def read_splits(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Read written splits; language and split are folder columns, so filters on them prune."""
    full = T.StructType([*schema.fields, T.StructField("lang", T.StringType()), T.StructField("split", T.StringType())])
    if fmt == "text":
        return spark.read.text(path).select(_unescaped("value").alias("text"), "lang", "split")
    return spark.read.schema(full).format(fmt).load(path)


def read_ordered_splits(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Splits written in an order, as JSON or text lines, with ``position`` from 0 in each language and split.

    A file is read in pieces, whose rows Spark numbers in turn. The index has one row per piece: its first number and the rows
    before it in its split. So a row's position needs no sort and no window over the texts. Null languages are a group like any other.
    """
    folders = [T.StructField("lang", T.StringType()), T.StructField("split", T.StringType())]
    lines = T.StructType([T.StructField("value", T.StringType()), *folders])
    number = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).cast("long")
    place = [number.alias("_no"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    # both formats are read as lines, and parsed after the numbers are given: a record that is dropped would shift the others
    read = spark.read.schema(lines).option("lineSep", "\n").text(path)
    raw = read.select("lang", "split", "value", *place, F.monotonically_increasing_id().alias("_row"))
    keys = ["lang", "split", "_no", "_file", "_at"]
    pieces = raw.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("lang", "split").orderBy("_no", "_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    index = pieces.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumnsRenamed({k: f"_of{k}" for k in keys})
    rows = raw.join(index, [raw[k].eqNullSafe(index[f"_of{k}"]) for k in keys])
    position = (F.col("_base") + F.col("_row") - F.col("_first")).alias("position")
    if fmt == "text":
        return rows.select("lang", "split", position, _unescaped("value").alias("text"))
    return rows.select("lang", "split", position, F.from_json("value", schema).alias("_record")).select("lang", "split", "position", "_record.*")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """One text line per row, as vector trainers read it."""
    df.select(column).write.mode("overwrite").text(path)


def write_contiguous(df: DataFrame, path: str, order: str, shards: int = 1024) -> None:
    """Contiguous shards in order: concatenating the files by name gives the ordered set."""
    df.repartitionByRange(shards, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)

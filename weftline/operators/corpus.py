"""Corpus build: warnings filter, line grouping, normalising."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import REJECTED_WARNINGS
from ..functions.text import clip_words, normalised
from ..session import written
from .ordered import running_sums


def quality_filter(df: DataFrame, warnings: str = "warnings", rejected: list[str] = REJECTED_WARNINGS) -> DataFrame:
    """Keep rows whose warnings are null or hold none of the rejected marks; other marks are tolerated.

    arrays_overlap gives null when nothing matches and an element is null: such a row is kept.
    """
    marks = F.array(*[F.lit(m) for m in rejected])
    return df.where(F.col(warnings).isNull() | ~F.coalesce(F.arrays_overlap(warnings, marks), F.lit(False)))


def number_documents(lines: DataFrame) -> DataFrame:
    """Add ``doc_no``, the breaks before a line in its source, and ``doc_no_total`` to lines (source_id, line_no, text)."""
    is_break = F.when(F.col("text") == "\n", 1).otherwise(0).cast("long")
    return running_sums(lines, ["line_no"], {"doc_no": is_break}, keys=["source_id"], totals_too=True)


def join_lines(numbered: DataFrame) -> DataFrame:
    """Texts of numbered lines by (source_id, doc_no); a group is one document, break rows add nothing."""
    body = F.when(F.col("text") != "\n", F.struct("line_no", "text"))
    grouped = numbered.groupBy("source_id", "doc_no").agg(F.array_sort(F.collect_list(body)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda part: part["text"]), "")
    return grouped.select("source_id", "doc_no", text.alias("text"))


def lines_to_documents(lines: DataFrame, keep_tail: bool = False) -> DataFrame:
    """Join consecutive lines of a source without separator; a line that is only a newline closes the document.

    Two breaks in a row give an empty document. An unclosed tail is dropped unless ``keep_tail``;
    it is dropped before grouping, so it is never collected.
    """
    numbered = number_documents(lines)
    return join_lines(numbered if keep_tail else numbered.where(F.col("doc_no") < F.col("doc_no_total")))


_FRAGMENT = pa.schema(
    [("source_id", pa.string()), ("file", pa.string()), ("split", pa.int64()), ("nth", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("text", pa.string())]
)
_FRAGMENT_DDL = "source_id string, file string, split long, nth long, opens boolean, closes boolean, text string"


def _fragments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies between the breaks of a split, in order: ``opens`` if a break comes before it in the split, ``closes`` if one ends it."""
    key, nth, lines = None, 0, []

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(_FRAGMENT)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FRAGMENT, strict=True)], schema=_FRAGMENT)

    for part in parts:
        rows = []
        for *own, text in zip(*(part.column(c).to_pylist() for c in ("source_id", "file", "split", "text")), strict=True):
            if own != key:
                if key:
                    rows.append((*key, nth, nth > 0, False, "".join(lines)))
                key, nth, lines = own, 0, []
            if text == "\n":
                rows.append((*key, nth, nth > 0, True, "".join(lines)))
                nth, lines = nth + 1, []
            else:
                lines.append(text)
        yield told(rows)
    if key:
        yield told([(*key, nth, nth > 0, False, "".join(lines))])


def lines_in_splits_to_documents(lines: DataFrame, keep_tail: bool = False) -> DataFrame:
    """(source_id, doc_no, text) as ``lines_to_documents`` gives them, from lines as they are read from files.

    A document that opens and closes inside a split is put together where it is read. Only the fragments at the borders of
    splits, two a split, meet in a shuffle; their documents are numbered by the breaks of the splits before, one row a split.
    Lines must come as ``read_lines`` gives them, without an exchange between. A source goes through its files by name.
    """
    found = written(lines.select("source_id", "file", "split", "text").mapInArrow(_fragments, _FRAGMENT_DDL), "fragments")
    breaks = found.groupBy("source_id", "file", "split").agg(F.count_if("closes").alias("breaks"))
    before = Window.partitionBy("source_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source_id")  # one row a split
    bases = breaks.select(
        *[F.col(c).alias(f"_{c}") for c in ("source_id", "file", "split")],
        F.coalesce(F.sum("breaks").over(before), F.lit(0)).alias("base"),
        F.sum("breaks").over(whole).alias("total"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("source_id", "file", "split")]
    placed = found.join(bases, same).withColumn("doc_no", F.col("base") + F.col("nth"))
    if not keep_tail:
        placed = placed.where(F.col("doc_no") < F.col("total"))
    inner = placed.where(F.col("opens") & F.col("closes")).select("source_id", "doc_no", "text")
    border = placed.where(~(F.col("opens") & F.col("closes"))).groupBy("source_id", "doc_no")
    parts = border.agg(F.array_sort(F.collect_list(F.struct("file", "split", "text"))).alias("parts"))
    texts = parts.select("source_id", "doc_no", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    if keep_tail:  # an empty rest after the last break is no document
        texts = texts.join(bases.select("_source_id", "total").distinct(), F.col("source_id").eqNullSafe(F.col("_source_id")))
        texts = texts.where((F.col("doc_no") < F.col("total")) | (F.col("text") != "")).select("source_id", "doc_no", "text")
    return inner.unionByName(texts)


def normalise_text(df: DataFrame) -> DataFrame:
    """Drop rows that are only a newline, strip the rest and end them in one newline.

    An empty document is not such a row: it becomes a newline and stays.
    """
    return df.where(F.col("text") != "\n").withColumn("text", normalised(F.col("text")))


def clip_documents(df: DataFrame, limit: int | None) -> DataFrame:
    return df.withColumn("text", clip_words(F.col("text"), limit))

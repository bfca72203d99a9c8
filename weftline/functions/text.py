"""Text columns: strip, blank test, clip, pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import WHITESPACE, WORD_MARK


def strip(text: Column) -> Column:
    """Strip all Unicode white space; the plain trim function only strips U+0020."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalised(text: Column) -> Column:
    return F.concat(strip(text), F.lit("\n"))


def clip_words(text: Column, limit: int | None) -> Column:
    """The first ``limit`` pieces of a split on the single space, joined again."""
    return text if limit is None else F.substring_index(text, " ", limit)


def pieces(text: Column) -> Column:
    """Word pieces: white space runs collapse, words open with the mark, every digit stands alone.

    White space is folded with translate and split on one character, so the cost stays
    linear in the text length (regexp_extract_all copies the text for every match).
    """
    folded = F.translate(strip(text), WHITESPACE, " " * len(WHITESPACE))
    marked = F.concat(F.lit(WORD_MARK), F.regexp_replace(folded, " +", " " + WORD_MARK))
    apart = F.regexp_replace(marked, "([0-9])", r" $1 ")
    found = F.filter(F.split(apart, " "), lambda piece: piece != "")
    return F.when(folded == "", F.array().cast("array<string>")).otherwise(found)


def _without_empty(lists: pa.ListArray) -> pa.ListArray:
    flat = lists.flatten()
    keep = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(before[lists.offsets.to_numpy()], pa.int32()), flat.filter(keep))


def words(texts: pa.Array) -> pa.ListArray:
    """The words of each text of an Arrow batch, cut at WHITESPACE; a null text has none."""
    return _without_empty(pc.utf8_split_whitespace(pc.fill_null(texts, "")))


def word_pieces(found: pa.Array) -> pa.ListArray:
    """The pieces of each word of an Arrow array, as ``pieces`` makes them."""
    marked = pc.binary_join_element_wise(pa.scalar(WORD_MARK), found, "")
    if not pc.any(pc.match_substring_regex(marked, "[0-9]")).as_py():
        return pa.ListArray.from_arrays(pa.array(np.arange(len(marked) + 1), pa.int32()), marked)
    return _without_empty(pc.split_pattern(pc.replace_substring_regex(marked, "([0-9])", r" \1 "), " "))


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive texts of about ``most`` bytes together; a longer text makes a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = (np.flatnonzero(np.diff(ends // most)) + 1).tolist()
    return ((a, b - a) for a, b in zip([0, *cuts], [*cuts, len(texts)]) if b > a)

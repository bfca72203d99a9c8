"""Token-array columns: document marks, shifting, padding, masking, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BOS_ID, EOS_ID, IGNORE_ID, PAD_ID


def int_array(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def ensure_bos(ids: Column, bos: int = BOS_ID) -> Column:
    """Prepend the mark unless it is the first id already (safe on empty arrays)."""
    return F.when(F.try_element_at(ids, F.lit(1)).eqNullSafe(F.lit(bos)), ids).otherwise(F.concat(int_array(bos), ids))


def ensure_eos(ids: Column, eos: int = EOS_ID) -> Column:
    return F.when(F.try_element_at(ids, F.lit(-1)).eqNullSafe(F.lit(eos)), ids).otherwise(F.concat(ids, int_array(eos)))


def ensure_marks(ids: Column, bos: bool, eos: bool) -> Column:
    if bos:
        ids = ensure_bos(ids)
    return ensure_eos(ids) if eos else ids


def pad_right(values: Column, length: int, filler: int) -> Column:
    missing = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(filler).cast("int"), missing))


def mask_labels(x: Column, y: Column, mask_bos: bool = False, mask_eos: bool = False, pad: int = PAD_ID) -> Column:
    """Ignore labels that are bos, eos or pad, labels at pad inputs, optionally at bos / eos inputs."""
    skip_inputs = [pad] + ([BOS_ID] if mask_bos else []) + ([EOS_ID] if mask_eos else [])
    return F.zip_with(
        x,
        y,
        lambda a, b: F.when(b.isin(BOS_ID, EOS_ID, pad) | a.isin(skip_inputs), F.lit(IGNORE_ID)).otherwise(b),
    )


def segments(documents: Column) -> Column:
    """1 for every token of the first document, 2 for the second, and so on."""
    return F.flatten(F.transform(documents, lambda ids, i: F.array_repeat((i + 1).cast("int"), F.size(ids))))

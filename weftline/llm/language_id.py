"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots holds the filters of all languages: a slot is a word with one bit per language. A gram reads its
``hashes`` slots, and their bitwise AND has the bits of all languages that (may) contain it. A document's hits in each
language, over all grams of its whole text, are corrected for that filter's false positives, and the largest share decides.

The model is fitted on a bounded sample: at most about ``per_language`` labelled rows of each language, chosen by a hash of
their id. A gram enters a language's filter when it occurs there at least ``least`` times and its rate is at least
``share`` of its highest rate in any language. The table's size follows the number of grams, up to ``most_slots``.

A text that is null or has no letter is ``und`` with score 0. Ties go to the language with more sampled rows, then by name.
Rows with a null text or language teach nothing; if none are left, a text with letters has a null language and score 0. A
null id counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.functions.text import slices
from weftline.llm.common import STEP_BYTES, batches, constants, mix, only, signed, worker_cache

#: Lengths of grams in characters, with one space at each end of a word.
SIZES = (3, 4)
UNKNOWN = "und"
#: Bytes of text that a task holds as Python strings at a time.
SLICE_BYTES = 1 << 22


def letters() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    cache = worker_cache("letters")
    if "table" not in cache:
        cache["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["table"]


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Hashes of all grams and the document of each, for ranges of documents: words of letters, lower-cased, other characters as one space."""
    weights = constants(3, max(SIZES) + 1)
    is_letter = letters()
    low = [(t or "").lower() for t in texts]
    start = 0
    while start < len(low):
        end, size = start, 0
        while end < len(low) and (end == start or size + len(low[end]) < STEP_BYTES):
            size += len(low[end]) + 1
            end += 1
        codes = np.frombuffer((" " + " ".join(low[start:end]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) + 1 for t in low[start:end]])
        owner = np.concatenate(([0], np.repeat(np.arange(end - start), lengths)))
        letter = is_letter[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        code, own, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
        hashes, docs = [], []
        for n in SIZES:
            m = len(code) - n + 1
            if m <= 0:
                continue
            whole = letter[1 : 1 + m].copy()
            for j in range(2, n - 1):
                whole &= letter[j : j + m]
            at = np.flatnonzero(whole)
            h = np.full(len(at), weights[-1] * np.uint64(n), np.uint64)
            for j in range(n):
                h += code[at + j] * weights[j]
            hashes.append(mix(h))
            docs.append(own[at + 1])
        yield start, end, np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(docs) if docs else np.empty(0, np.int64)
        start = end


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for part in (whole.slice(*s) for whole in parts for s in slices(whole.column(1), SLICE_BYTES)):
        langs = np.array(part.column(0).to_pylist(), object)
        texts = part.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for _, _, hashes, _ in grams(own):
                gram, n = np.unique(hashes, return_counts=True)
                yield from batches({"lang": [lang] * len(gram), "gram": signed(gram), "n": n}, schema, 1 << 18)


@dataclass
class Model:
    languages: list[str]  # bit i stands for the i-th
    table: np.ndarray  # slots x words of 64 languages
    hashes: int
    false_rate: np.ndarray  # of each language's filter


def _slots(gram: np.ndarray, hashes: int, slots: int) -> list[np.ndarray]:
    """Double hashing: the low half plus multiples of the odd high half."""
    low, high = gram & np.uint64(0xFFFFFFFF), gram >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(slots - 1)).astype(np.int64) for i in range(hashes)]


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 10_000, least: int = 2, share: float = 0.25, hashes: int = 2, most_slots: int = 1 << 22) -> Model:
    """Fit on the labelled rows given; ``per_language`` bounds the sample of each language."""
    rows = only(rows, id_col, text_col, lang_col).toDF("id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts, key=lambda x: (-min(counts[x], per_language), x))
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), hashes, np.zeros(0))
    part = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / counts[x]))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < part[F.col("lang")]).select("lang", "text")
    grams_ = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    totals = grams_.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    rated = grams_.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    bit = F.create_map(*[F.lit(v) for i, x in enumerate(languages) for v in (x, i)])[F.col("lang")]
    masks = (
        rated.groupBy("gram")
        .agg(F.max("rate").alias("top"), F.collect_list(F.struct(bit.alias("bit"), "rate")).alias("own"))
        .select("gram", F.expr(f"transform(filter(own, x -> x.rate >= {share} * top), x -> x.bit)").alias("bits"))
    )
    n = max(1, masks.count())
    slots = min(most_slots, 1 << (12 * n - 1).bit_length())
    words = -(-len(languages) // 64)
    mask = F.expr("aggregate(filter(bits, b -> b div 64 = word), 0L, (m, b) -> m | shiftleft(1L, cast(b % 64 as int)))")

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            gram = p.column(0).to_numpy().view(np.uint64)
            where = np.concatenate(_slots(gram, hashes, slots))
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.tile(p.column(1).to_numpy(), hashes)), pa.array(np.tile(p.column(2).to_numpy(), hashes))], ["slot", "word", "mask"])

    filled = (
        masks.withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(words - 1))))
        .select("gram", "word", mask.alias("mask"))
        .mapInArrow(place, "slot long, word int, mask long")
        .groupBy("slot", "word")
        .agg(F.expr("bit_or(mask)").alias("mask"))
    )
    table = np.zeros((slots, words), np.uint64)
    got = filled.toArrow()  # at most one row per slot and word
    table[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(table[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / slots for i in range(len(languages))])
    return Model(languages, table, hashes, fill**hashes)


def shares(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Each document's grams, and for each language the corrected share of them that its filter holds."""
    n, found = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages)))
    for a, b, hashes, docs in grams(texts):
        n[a:b] = np.bincount(docs, minlength=b - a)
        places = _slots(hashes, model.hashes, len(model.table))
        for word in range(model.table.shape[1]):
            mask = model.table[places[0], word]
            for p in places[1:]:
                mask &= model.table[p, word]
            for i in range(word * 64, min(len(model.languages), word * 64 + 64)):
                found[a:b, i] = np.bincount(docs, weights=mask >> np.uint64(i & 63) & np.uint64(1), minlength=b - a)
    rate = np.divide(found, n[:, None], out=np.zeros_like(found), where=n[:, None] > 0)
    return n, np.clip((rate - model.false_rate) / (1 - np.minimum(model.false_rate, 0.999999)), 0, 1)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The id, the ``keep`` columns, and the language and score of every row, ``named`` so, from its whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.hashes, model.false_rate))
    names = [*dict.fromkeys([id_col, *keep])]

    given = [f.dataType for f in docs.select(*names).schema if f.name == text_col]
    at = names.index(text_col) if given == [StringType()] else len(names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for whole in parts:
            for start, length in slices(whole.column(at), SLICE_BYTES):
                part = whole.slice(start, length)
                n, rate = shares(known, part.column(at).to_pylist())
                if known.languages:
                    best = rate.argmax(axis=1)
                    score = np.where(n > 0, rate[np.arange(len(n)), best], 0.0)
                    lang = [known.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), n.tolist())]
                else:
                    score, lang = np.zeros(len(n)), [None if k else UNKNOWN for k in n.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, *named])

    # a text that is kept anyway is sent once
    rows = docs.select(*names, *([] if at < len(names) else [F.col(text_col).cast("string").alias("__text")]))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return rows.mapInArrow(run, f"{ddl}, `{named[0]}` string, `{named[1]}` double")


def held_out(id_col: str = "doc_id"):
    """The rows that teach nothing: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2

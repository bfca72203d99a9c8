"""N-gram Jaccard join, size-aware: subsets for light sets, inverted lists for heavy ones.

Documents with equal shingle sets make one class; everything below is about classes. Two classes of a and b shingles link
when they share at least c(a, b) = ceil(num * (a + b) / (num + den)).

Light classes (at most x shingles) enumerate their subsets of every size c(a, b) that a partner b allows. Classes that share
a c-subset and have a + b <= c * (num + den) / num link without any check; a subset's smallest class links to all that link
there at all, so one star per subset keeps the components. The boundary x is chosen by cost from the histogram of sizes:
subsets to write against prefix entries and moved sets.

Heavy classes are found by inverted lists over prefixes: in any common order of shingles two linked classes share one of
their first s - ceil(num * s / den) + 1. The order is by hash with frequent shingles last; which ones are frequent is counted
over all documents and kept in a bit set of fixed size. The lists serve in two ways:

- lists of ordinary shingles are short, since shingles found frequent are counted away twice; their pairs are counted, and a pair goes on only if the prefix entries it shares
  leave room for c(a, b) (an exact bound); then both whole sets are compared. A list that is long all the same makes no pairs:
  it ties its classes to its first one, and they join the families below;
- frequent shingles that are still in a prefix belong to classes made of frequent shingles only, families of near copies.
  Classes that such lists connect form a family; a family is cut into blocks by size, and each pair of blocks
  whose sizes allow links compares its sets in one task as a matrix product and reports a spanning forest of its links.
  No pair of a family is ever written.

Light classes near the boundary enter the lists as well, for their heavy partners. Every link that is reported has been
checked on whole sets, and no link between components is lost.

A null or blank text has no shingles, its own component and no links. Rows that repeat an id and a text fall into one class;
rows that share an id with different texts stay separate. A null id takes part, and a component's id is the smallest id
that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import batches, constants, long_lists, mix, only, raw_texts, shingle_sets, signed
from weftline.llm.graph import components
from weftline.session import written

#: Documents from which a shingle counts as frequent: first in the smallest quarters of plain prefixes, then in the prefixes
#: without those; and how many frequent ones the order knows at most (beyond, the counts from which they are so double).
SKETCH_LEAST, LIST_LEAST, MOST_FREQUENT = 6, 8, 1 << 23
#: Bits of the set of frequent shingles (16 MB), and of the set of rows whose whole sets are compared.
BITS = 1 << 27
#: Classes from which a list makes a family instead of pairs.
LONG_LIST = 256
#: Classes in one block of a family.
BLOCK = 1024
#: Largest size that may count as light.
LIGHT_MOST = 24


class Threshold:
    """The similarity num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, both: int) -> int:
        return -(-self.num * both // (self.num + self.den))

    def least_partner(self, size: int) -> int:
        return -(-self.num * size // self.den)

    def most_partner(self, size: int) -> int:
        return size * self.den // self.num

    def prefix(self, size: int) -> int:
        return size - self.least_partner(size) + 1 if size else 0

    def subset_sizes(self, size: int) -> list[int]:
        return sorted({self.overlap(size + b) for b in range(max(1, self.least_partner(size)), self.most_partner(size) + 1)} & set(range(1, size + 1)))


def signature(tokens: np.ndarray) -> bytes:
    a, b = constants(21, 2)
    return b"".join(int(mix(tokens ^ x).sum(dtype=np.uint64)).to_bytes(8, "little") for x in (a, b))


def subset_keys(tokens: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A key for each subset of each size: sums of mixed shingles, with the size mixed in. Built by leaving out elements."""
    mixed = mix(tokens ^ constants(22, 1)[0])
    total, out = mixed.sum(dtype=np.uint64), []
    for size in sizes:
        gone = len(tokens) - size
        dropped = np.zeros(1, np.uint64)
        last = np.full(1, -1)
        for _ in range(gone):
            step = [(dropped[last < j] + mixed[j], np.full(int((last < j).sum()), j)) for j in range(len(tokens))]
            dropped, last = np.concatenate([s[0] for s in step]), np.concatenate([s[1] for s in step])
        out.append(mix((total - dropped) * np.uint64(2 * size + 1)))
    return np.concatenate(out)


def light_boundary(histogram: dict[int, int], t: Threshold, most: int = LIGHT_MOST) -> int:
    """The size x up to which enumerating is cheapest in all.

    A light class writes one row per subset; a heavy one writes its prefix and moves its whole set about twice, at a third
    of a row per shingle. Light classes with heavy partners pay for both.
    """
    subsets = {s: sum(comb(s, c) for c in t.subset_sizes(s)) for s in range(1, most + 1)}
    heavy = {s: t.prefix(s) + 2 * s / 3 for s in range(1, most + 1)}

    def cost(x: int) -> float:
        light = sum(histogram.get(s, 0) * (subsets[s] + (heavy[s] if t.most_partner(s) > x else 0)) for s in range(1, x + 1))
        return light + sum(histogram.get(s, 0) * heavy[s] for s in range(x + 1, most + 1))

    return min(range(most + 1), key=lambda x: (cost(x), x))


class Order:
    """Shingles in order of their hash, frequent ones last."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(tokens), bool)
        slot = (tokens >> np.uint64(8)) & np.uint64(BITS - 1)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def prefix(self, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n shingles and which of them are frequent; tokens come sorted."""
        flags = self.frequent(tokens)
        rare = tokens[~flags]
        if len(rare) >= n:
            return rare[:n], np.zeros(n, bool)
        rest = tokens[flags][: n - len(rare)]
        return np.concatenate([rare, rest]), np.arange(n) >= len(rare)


def bit_set(slots: DataFrame) -> np.ndarray:
    """The bits of the column slot, grouped by 64-bit word on Spark: at most BITS / 64 rows reach the driver."""
    word, bit = F.expr("cast(slot div 64 as int)").alias("word"), F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")
    got = slots.groupBy(word).agg(bit).toArrow()
    words = np.zeros(BITS >> 6, "<i8")
    words[got["word"].to_numpy()] = got["bits"].to_numpy()
    return words.view(np.uint8)


def _sketch(size: int, t: Threshold):
    """id, n, signature and the first quarter of the plain prefix of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, sig, heads = [], [], []
            for tokens in shingle_sets(raw_texts(part.column(1)), size):
                n.append(len(tokens))
                sig.append(signature(tokens) if len(tokens) else None)
                heads.append(tokens[: -(-t.prefix(len(tokens)) // 4)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), long_lists(heads)], ["id", "text_hash", "n", "sig", "head"])

    return run


def _ordinary(size: int, t: Threshold, sent):
    """The ordinary shingles of each document's prefix."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(sent.value)
        for part in parts:
            found = []
            for tokens in shingle_sets(raw_texts(part.column(1)), size):
                first, flags = order.prefix(tokens, t.prefix(len(tokens)))
                found.append(first[~flags])
            yield pa.RecordBatch.from_arrays([long_lists(found)], ["rare"])

    return run


def _entries(size: int, t: Threshold, light: int, sent):
    """id, sig, n, last (the prefix's last shingle), prefix, its frequent part, and subset keys of light sets."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(sent.value)
        for part in parts:
            n, sig, rare, often, last, keys, subset = [], [], [], [], [], [], []
            for tokens in shingle_sets(raw_texts(part.column(1)), size):
                n.append(len(tokens))
                sig.append(signature(tokens) if len(tokens) else None)
                sizes = t.subset_sizes(len(tokens)) if 0 < len(tokens) <= light else []
                keys.append(subset_keys(tokens, sizes) if sizes else tokens[:0])
                subset.append(np.repeat(sizes, [comb(len(tokens), c) for c in sizes]).astype(np.uint64) if sizes else tokens[:0])
                # A light set is listed only if it may have a heavy partner.
                listed = len(tokens) and t.most_partner(len(tokens)) > light
                first, flags = order.prefix(tokens, t.prefix(len(tokens))) if listed else (tokens[:0], np.zeros(0, bool))
                rare.append(first[~flags])
                often.append(first[flags])
                # Order key of the last prefix entry: the flag, then the hash without its lowest bit.
                last.append(int(first[-1] >> np.uint64(1)) - (0 if flags[-1] else 1 << 63) if len(first) else 0)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), long_lists(rare), long_lists(often), pa.array(last, pa.int64()), long_lists(keys), long_lists(subset)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "sig", "rare", "often", "last", "keys", "subset"])

    return run


_PAIR = pa.schema([(n, pa.int64()) for n in ("u", "v", "nu", "nv", "first", "shared")])


def _pairs(t: Threshold, light: int, long_list: int):
    """Pairs of classes in each list, with sizes that allow a link and at least one heavy; rows come sorted by shingle and class.

    ``first`` is the size of the set whose prefix ends first, for the bound on what they can still share. A long list gives
    a star (class, first class) with sizes of -1.
    """

    def bounds(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        return starts, np.diff(np.append(starts, len(token)))

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts, lengths = bounds(rows["token"])
        long = np.repeat(lengths >= long_list, lengths)
        if long.any():
            tied = rows["cid"][long]
            none = pa.array(np.full(len(tied), -1))
            head = np.repeat(rows["cid"][starts], lengths)[long]
            yield pa.RecordBatch.from_arrays([pa.array(tied), pa.array(head), none, none, none, none], schema=_PAIR)
            rows = {c: x[~long] for c, x in rows.items()}
            if not len(rows["token"]):
                return
            starts, lengths = bounds(rows["token"])
        token = rows["token"]
        place = np.arange(len(token)) - np.repeat(starts, lengths)
        done = np.cumsum(place)
        a = 0
        while a < len(token):  # a bounded number of pairs at a time
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + (1 << 18))))
            count = place[a:b]
            right = np.repeat(np.arange(a, b), count)
            left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(count) - count, count))
            nu, nv = rows["n"][left], rows["n"][right]
            small, large = np.minimum(nu, nv), np.maximum(nu, nv)
            ok = (small * t.den >= large * t.num) & (large > light) & (rows["cid"][left] != rows["cid"][right])
            ok &= (rows["family"][left] < 0) | (rows["family"][left] != rows["family"][right])
            left, right = left[ok], right[ok]
            if len(left):
                u, v = rows["cid"][left], rows["cid"][right]
                swap = u > v
                left, right = np.where(swap, right, left), np.where(swap, left, right)
                ends_first = np.where(rows["last"][left] <= rows["last"][right], rows["n"][left], rows["n"][right])
                columns = np.stack([rows["cid"][left], rows["cid"][right], rows["n"][left], rows["n"][right], ends_first])
                order = np.lexsort((columns[1], columns[0]))
                columns = columns[:, order]
                heads = np.flatnonzero((np.diff(columns[0], prepend=-1) != 0) | (np.diff(columns[1], prepend=-1) != 0))
                shared = np.diff(np.append(heads, columns.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c[heads]) for c in columns] + [pa.array(shared.astype(np.int64))], schema=_PAIR)
            a = b

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in parts:
            if not part.num_rows:
                continue
            rows = {c: part.column(c).to_numpy() for c in ("token", "cid", "n", "last", "family")}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
            # The last list may go on in the next batch.
            cut = int(np.searchsorted(rows["token"], rows["token"][-1], "left"))
            held = {c: x[cut:] for c, x in rows.items()}
            if cut:
                yield from pairs({c: x[:cut] for c, x in rows.items()})
        if held is not None:
            yield from pairs(held)

    return run


def packed(tokens: np.ndarray) -> bytes:
    """A sorted set as 48-bit hashes: whole sets move once or twice, and two sets of a thousand have one false hit in 10**8 pairs."""
    return np.ascontiguousarray((tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def row_slot(sig: bytes, id_: int | None) -> int:
    """What ``xxhash64(sig, id)`` gives in Spark, cut to a slot."""
    h = xxhash.xxh64_intdigest(sig, 42)
    if id_ is not None:
        h = xxhash.xxh64_intdigest(id_.to_bytes(8, "little", signed=True), h)
    return h & (BITS - 1)


def _whole_sets(size: int, sent):
    """sig and the whole set of the rows that stand for a class asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for part in parts:
            out: dict[str, list] = {"sig": [], "tokens": []}
            for id_, tokens in zip(part.column(0).to_pylist(), shingle_sets(raw_texts(part.column(1)), size)):
                if not len(tokens):
                    continue
                sig = signature(tokens)
                slot = row_slot(sig, id_)
                if bits[slot >> 3] >> (slot & 7) & 1:
                    out["sig"].append(sig)
                    out["tokens"].append(packed(tokens))
            yield from batches(out, pa.schema([("sig", pa.binary()), ("tokens", pa.binary())]), 4096)

    return run


def _verify(t: Threshold):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 512):
                part, keep = whole.slice(at, 512), []
                for a, b in zip(part.column("tu").to_pylist(), part.column("tv").to_pylist()):
                    a, b = unpacked(a), unpacked(b)
                    both = np.sort(np.concatenate([a, b]))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep.append(shared >= t.overlap(len(a) + len(b)))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def block_links(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, t: Threshold) -> np.ndarray:
    """A spanning forest of the links between the sets of group 0 and those of group 1, or within group 0 if it is alone."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes)
    often = count > 1  # the others cannot be shared
    number = np.cumsum(often) - 1
    keep = often[column]
    rows, column = rows[keep], number[column[keep]]
    left = np.flatnonzero(group == 0)
    right = np.flatnonzero(group == 1) if (group == 1).any() else left
    shared = np.zeros((len(left), len(right)), np.float32)
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    for a in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(column, (a, a + 4096))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[rows[lo:hi], column[lo:hi] - a] = 1
        shared += dense[left] @ dense[right].T
    need = -(-t.num * (sizes[left][:, None] + sizes[right][None]) // (t.num + t.den))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(shared >= need)):
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            root[a] = b
            out.append((ids[left[i]], ids[right[j]]))
    return np.array(out, np.int64).reshape(-1, 2)


def _compare(t: Threshold):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [unpacked(x) for x in frame["tokens"]]
        found = block_links(frame["cid"].to_numpy(), sets, frame["side"].to_numpy(), t)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    return run


def _frequent_bits(lists: DataFrame, least: int) -> np.ndarray:
    """The bit set of the shingles that occur at least so often; of at most MOST_FREQUENT of them."""
    often = lists.groupBy("token").count().filter(F.col("count") >= least)
    often = written(often.select(F.expr(f"cast(shiftrightunsigned(token, 8) & {BITS - 1}L as int)").alias("slot"), F.expr("cast(log2(count) as int)").alias("size")), "jaccard-frequent")
    sizes = sorted(((r["size"], r["n"]) for r in often.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, from_ = 0, 64
    for size, n in sizes:
        if total + n > MOST_FREQUENT:
            break
        total, from_ = total + n, size
    return bit_set(often.filter(F.col("size") >= from_).select("slot"))


def linked_documents(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", long_list: int = LONG_LIST, labelled: bool = False) -> DataFrame:
    """One row per input row: the id, text_hash (xxhash64 of the text), n_shingles, class_id (signature of its set, null if empty), component_id.

    ``labelled`` adds component, a number of its own for each component, null for an empty set: ids may be null or repeat.
    """
    spark = docs.sparkSession
    t = Threshold(num, den)
    texts = only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    base = written(texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch(size, t), "id long, text_hash long, n long, sig binary, head array<long>"), "jaccard-base")
    rows = base.filter("sig is not null")
    classes = rows.groupBy("sig", "n").agg(F.min("id").alias("least_id")).withColumn("cid", F.monotonically_increasing_id())
    classes = written(classes, "jaccard-classes")
    small = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    light = light_boundary(small, t)
    bits = _frequent_bits(rows.select(F.explode("head").alias("token")), SKETCH_LEAST)
    ordinary = texts.mapInArrow(_ordinary(size, t, spark.sparkContext.broadcast(bits)), "rare array<long>")
    bits = bits | _frequent_bits(ordinary.select(F.explode("rare").alias("token")), LIST_LEAST)
    entries = texts.mapInArrow(_entries(size, t, light, spark.sparkContext.broadcast(bits)), "id long, n long, sig binary, rare array<long>, often array<long>, last long, keys array<long>, subset array<long>")
    own = classes.select("sig", "cid", "least_id").hint("merge")
    entries = entries.filter("sig is not null").join(own, "sig").filter("id <=> least_id").dropDuplicates(["sig"])
    entries = written(entries.select("cid", "n", "rare", "often", "last", "keys", "subset"), "jaccard-entries")

    # Light classes: a star per subset, around its smallest class.
    subsets = entries.filter("size(keys) > 0").select("cid", "n", F.explode(F.arrays_zip("keys", "subset")).alias("s")).select("cid", "n", F.col("s.keys").alias("key"), F.col("s.subset").alias("c"))
    centre = subsets.groupBy("key", "c").agg(F.min(F.struct("n", "cid")).alias("m")).filter("m is not null")
    stars = subsets.join(centre.hint("merge"), ["key", "c"]).filter(f"cid != m.cid and (n + m.n) * {num} <= c * {num + den}").select(F.col("cid").alias("u"), F.col("m.cid").alias("v")).distinct()

    # Ordinary lists: pairs, bounded by what they share of their prefixes.
    # Pairs within a family are left to its blocks.
    often = written(entries.filter("size(often) > 0").select("cid", F.explode("often").alias("token")), "jaccard-often")
    head = often.groupBy("token").agg(F.min("cid").alias("v"))
    ties = often.join(head.hint("merge"), "token").select(F.col("cid").alias("u"), "v").distinct()
    families = written(_families(ties, entries), "jaccard-family")
    of = families.select("cid", "family").hint("merge")
    listed = entries.select("cid", "n", "last", "rare").join(of, "cid", "left").select("cid", "n", "last", F.coalesce("family", F.lit(-1)).alias("family"), F.explode("rare").alias("token"))
    pairs = listed.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(_pairs(t, light, long_list), ", ".join(f"{n} long" for n in _PAIR.names))
    pairs = pairs.groupBy("u", "v", "nu", "nv", "first").agg(F.sum("shared").alias("shared"))
    least = F.expr(f"({num} * (nu + nv) + {num + den - 1}) div {num + den}")
    unseen = F.expr(f"({num} * first + {den - 1}) div {den} - 1")  # of the set whose prefix ends first, what lies behind it
    pairs = written(pairs.filter((F.col("nu") < 0) | (F.col("shared") + unseen >= least)).select("u", "v", (F.col("nu") < 0).alias("tie")), "jaccard-lists")
    # A tie's ends are compared in the blocks of their family, and so are all classes of that list.
    families = written(_families(ties.unionByName(pairs.filter("tie").select("u", "v")), entries), "jaccard-family")
    return _finish(texts, base, classes, families, stars, pairs.filter("not tie").select("u", "v"), size, t, id_col, labelled)


def _families(ties: DataFrame, entries: DataFrame) -> DataFrame:
    """cid, n, family of the classes that ties connect."""
    labels = components(ties, "jaccard-families")
    return entries.select("cid", "n").join(labels.hint("merge"), F.col("cid") == F.col("id")).select("cid", "n", F.col("label").alias("family"))


def _blocks(families: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """cid, family, block; and the blocks of each family with their range of sizes. Blocks hold about BLOCK classes of near sizes.

    A block's number comes from the counts of classes by family and size, not from an order of a whole family.
    """
    by_size = families.groupBy("family", "n").count()
    total = by_size.groupBy("family").agg(F.sum("count").alias("total"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = by_size.withColumn("before", before).join(total, "family").filter("total > 1").withColumnRenamed("count", "same")
    # Classes of one size are dealt over the blocks that this size spans, by a hash.
    at = F.expr(f"(before + pmod(xxhash64(cid), same)) div {BLOCK}")
    blocks = families.join(placed, ["family", "n"]).select("cid", "family", "n", at.alias("block"))
    return blocks, blocks.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def _finish(texts: DataFrame, base: DataFrame, classes: DataFrame, families: DataFrame, stars: DataFrame, pairs: DataFrame, size: int, t: Threshold, id_col: str, labelled: bool) -> DataFrame:
    spark = texts.sparkSession
    pairs = written(pairs, "jaccard-pairs")
    blocks, ranges = _blocks(families, t)
    blocks, ranges = written(blocks, "jaccard-blocks"), written(ranges, "jaccard-ranges")
    a, b = ranges.alias("a"), ranges.alias("b")
    meet = (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block")) & (F.col("a.high") * t.den >= F.col("b.low") * t.num)
    tasks = a.join(b, meet).select(F.col("a.family").alias("family"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))

    # Whole sets of the classes to compare, from one more scan; a bit set of fixed size leaves out most others.
    asked = pairs.select(F.col("u").alias("cid")).unionByName(pairs.select(F.col("v").alias("cid"))).unionByName(blocks.select("cid")).distinct()
    wanted = written(classes.join(asked.hint("merge"), "cid").select("cid", "sig", "least_id"), "jaccard-wanted")
    bits = bit_set(wanted.select(F.expr(f"cast(xxhash64(sig, least_id) & {BITS - 1}L as int)").alias("slot")))
    sets = texts.mapInArrow(_whole_sets(size, spark.sparkContext.broadcast(bits)), "sig binary, tokens binary")
    sets = written(sets, "jaccard-sets").dropDuplicates(["sig"])

    named = wanted.select("cid", "sig")
    asked = pairs.join(named.toDF("u", "su").hint("merge"), "u").join(named.toDF("v", "sv").hint("merge"), "v")
    left = asked.join(sets.toDF("su", "tu").hint("merge"), "su")
    both = left.join(sets.toDF("sv", "tv").hint("merge"), "sv")
    links = both.select("u", "v", "tu", "tv").mapInArrow(_verify(t), "u long, v long")

    member = blocks.join(named.hint("merge"), "cid").join(sets.hint("merge"), "sig").select("cid", "family", "block", "tokens")
    first = member.join(tasks, (member.family == tasks.family) & (member.block == tasks.x)).select("cid", "tokens", tasks.family, "x", "y", F.lit(0).alias("side"))
    second = member.join(tasks.filter("x != y"), (member.family == tasks.family) & (member.block == tasks.y)).select("cid", "tokens", tasks.family, "x", "y", F.lit(1).alias("side"))
    forest = first.unionByName(second).groupBy("family", "x", "y").applyInPandas(_compare(t), "u long, v long")

    labels = components(links.unionByName(forest).unionByName(stars), "jaccard-components")
    named = classes.join(labels.hint("merge"), classes.cid == labels.id, "left").select("sig", "least_id", F.coalesce("label", "cid").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(smallest.hint("merge"), "label").select("sig", "component_id", F.col("label").alias("component"))
    out = base.select("id", "text_hash", "n", "sig").join(of_class.hint("merge"), "sig", "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.lower(F.hex("sig")).alias("class_id"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), *(["component"] if labelled else []))

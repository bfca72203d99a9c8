"""A Merkle manifest of a dataset and proofs for its rows, fetched by leaf partitions as octopus multiproofs.

Tree. A row's leaf is the hash of its columns. The leaves of a group (``source``) in order of their ids form a tree: each run
of three neighbours becomes the hash of their hexadecimal digests one after another, until one node is left, the subroot. The
subroots in order of their groups form the top tree in the same way; it ends in the root. A node is named by its tree (number
of the group, -1 for the top), its level and its place in the level.

Building. Slim rows of leaves (no texts) go through one range exchange by (group, id, leaf), so that a hot group is cut into
many ranges. Each range counts its rows a group; these counts, at most one a range and a group, give every leaf its place. Whole
subtrees of ``BLOCK`` leaves are then folded by one task each, a round for every ``STEPS`` levels, and all nodes above leaves
are written as the manifest.

Proving. Leaves go to leaf partitions of up to ``PARTITION`` neighbours in the order of all leaves. A leaf partition works out
the least set of nodes that its leaves need and do not give: going up, the neighbours of the nodes it can derive which it cannot
derive itself. It fetches each of them once by a join on the nodes' names, derives the interiors that its leaves share from
the leaves up, and then expands the proof of each leaf from these nodes on the spot.

Rows whose id is null come first in their group; equal ids are ordered by their leaf, so that repeated rows are leaves of
their own and the tree does not depend on how rows arrive. A null column and a null group are valid; an empty text is not null. A group
of one leaf has that leaf as subroot, one group alone has its subroot as root, an empty table gives no leaf and no node. Texts are hashed
where they are read, whole. Columns that are not named take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written

FAN = 3
#: Levels that one task folds at once, and the leaves of such a subtree.
STEPS = 7
BLOCK = FAN**STEPS
#: Leaves that are proven together.
PARTITION = 4096
TOP = -1

_NODE = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.binary()), ("last", pa.bool_())])
_NODE_DDL = "tree long, n long, level int, pos long, hash binary, last boolean"
_REQUEST = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64())])
_BEFORE = (Window.unboundedPreceding, -1)


def joined(digests: Iterable[bytes]) -> bytes:
    """The hash of hexadecimal digests one after another, in hexadecimal."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def widths(n: int) -> list[int]:
    """How many nodes each level of a tree with n leaves has, up to the one node at its end."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def leaf_hash(*columns: Column) -> Column:
    """The hash of column values, each as - if null, else its length in bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def _number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the sorted rows of one range which group of the range they are in, and their place in that group there."""
    group, ordinal, at = None, -1, 0
    for part in parts:
        ordinals, places = [], []
        for value in part.column("source").to_pylist():
            if ordinal < 0 or value != group:
                group, ordinal, at = value, ordinal + 1, 0
            ordinals.append(ordinal)
            places.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(ordinals, pa.int64()), pa.array(places, pa.int64())], names=[*part.schema.names, "ordinal", "place"]
        )


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """Leaves (source, id, leaf, other) with their tree, its n leaves, pos in it and place ``at`` among all; the number of trees
    and of leaves of the largest one."""
    slim = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")  # stored, so that it stays: repeated rows differ by it
    keys = ["source", "id", "leaf", "tie"]
    ranges = slim.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", ordinal long, place long"
    ranges = written(ranges.mapInArrow(_number, schema), "merkle-ranges")
    # From here on at most one row a range and a group.
    counts = ranges.groupBy("part", "ordinal").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("source").orderBy("part")
    counts = counts.select(
        "part",
        "ordinal",
        "rows",
        F.coalesce(F.sum("rows").over(group.rowsBetween(*_BEFORE)), F.lit(0)).alias("base"),
        F.sum("rows").over(Window.partitionBy("source")).alias("n"),
        F.when(F.row_number().over(group) == 1, 1).otherwise(0).alias("starts"),
    )
    counts = written(counts, "merkle-counts")
    order = Window.orderBy("part").rowsBetween(*_BEFORE)  # one row a range
    whole = counts.groupBy("part").agg(F.sum("starts").alias("starts"), F.sum("rows").alias("rows"))
    whole = whole.select(
        "part", F.coalesce(F.sum("starts").over(order), F.lit(0)).alias("trees_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before")
    )
    inside = Window.partitionBy("part").orderBy("ordinal")
    bases = counts.join(whole, "part").select(
        "part",
        "ordinal",
        "n",
        "base",
        (F.col("trees_before") + F.sum("starts").over(inside) - 1).alias("tree"),
        (F.col("rows_before") + F.coalesce(F.sum("rows").over(inside.rowsBetween(*_BEFORE)), F.lit(0))).alias("first"),
    )
    placed = ranges.join(bases, ["part", "ordinal"]).select(
        "id", "leaf", "other", "tree", "n", (F.col("base") + F.col("place")).alias("pos"), (F.col("first") + F.col("place")).alias("at")
    )
    n_trees, most = counts.agg(F.coalesce(F.sum("starts"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return written(placed, "merkle-placed"), n_trees, most


def _fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the next levels above sorted nodes of one level, a block of neighbours at a time."""

    def above(tree: int, n: int, level: int, block: int, hashes: list[bytes]) -> Iterator[tuple]:
        width = widths(n)
        for up in range(level + 1, min(level + STEPS, len(width) - 1) + 1):
            hashes = [joined(hashes[k : k + FAN]) for k in range(0, len(hashes), FAN)]
            first = block * FAN ** (STEPS - (up - level))
            for k, digest in enumerate(hashes):
                yield tree, n, up, first + k, bytes.fromhex(digest.decode()), width[up] == 1

    def rows() -> Iterator[tuple]:
        key, hashes = None, []
        for part in parts:
            for tree, n, level, pos, digest in zip(*(part.column(c).to_pylist() for c in ("tree", "n", "level", "pos", "hash")), strict=True):
                own = tree, n, level, pos // BLOCK
                if own != key:
                    if hashes:
                        yield from above(*key, hashes)
                    key, hashes = own, []
                hashes.append(digest.hex().encode())
        if hashes:
            yield from above(*key, hashes)

    found = []
    for row in rows():
        found.append(row)
        if len(found) == 8192:
            yield _table(found)
            found = []
    if found:
        yield _table(found)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _tree_nodes(lowest: DataFrame, most: int) -> DataFrame:
    """All nodes above ``lowest`` (tree, n, level 0, pos, hash) for trees of at most ``most`` leaves."""
    level, found = lowest, None
    for k in range(0, max(1, len(widths(most)) - 1), STEPS):
        if k:
            level = found[-1].filter((F.col("level") == k) & ~F.col("last"))
        block = F.floor(F.col("pos") / BLOCK)
        sent = level.select("tree", "n", "level", "pos", "hash").repartition("tree", block).sortWithinPartitions("tree", "pos")
        found = [*(found or []), written(sent.mapInArrow(_fold, _NODE_DDL), "merkle-nodes")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def manifest(placed: DataFrame, n_trees: int, most: int) -> DataFrame:
    """(tree, n, level, pos, hash, last): the nodes above leaves, the subroots as level 0 of the top tree, and the top tree."""
    own = _tree_nodes(placed.select("tree", "n", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash")), most)
    alone = placed.filter("n = 1").select("tree", F.col("leaf").alias("hash"))
    subroots = own.filter("last").select("tree", "hash").unionByName(alone)
    top = written(
        subroots.select(
            F.lit(TOP).cast("long").alias("tree"),
            F.lit(n_trees).cast("long").alias("n"),
            F.lit(0).alias("level"),
            F.col("tree").alias("pos"),
            "hash",
            F.lit(n_trees == 1).alias("last"),
        ),
        "merkle-subroots",
    )
    return own.unionByName(top).unionByName(_tree_nodes(top, n_trees))


def missing(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The least set of (level, pos) that the nodes at the known places of a tree with n leaves lack to give its last node."""
    out, here = [], set(known)
    for level, width in enumerate(widths(n)[:-1]):
        runs = {p // FAN for p in here}
        out += [(level, p) for r in sorted(runs) for p in range(FAN * r, min(FAN * r + FAN, width)) if p not in here]
        here = runs
    return out


def _requests(n_trees: int):
    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for part, leaves in zip(batch.column("part").to_pylist(), batch.column("leaves").to_pylist(), strict=True):
                trees = defaultdict(list)
                for leaf in leaves:
                    trees[leaf["tree"], leaf["n"]].append(leaf["pos"])
                for (tree, n), known in trees.items():
                    rows += [(part, tree, level, pos) for level, pos in missing(known, n)]
                rows += [(part, TOP, level, pos) for level, pos in missing({tree for tree, _ in trees}, n_trees)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REQUEST, strict=True)], schema=_REQUEST)

    return ask


class Paths:
    """The nodes of one tree that known leaves and fetched nodes give, with the way from each of them to the last node."""

    def __init__(self, n: int, known: dict[int, bytes], fetched: dict[tuple[int, int], bytes], beyond: bytes = b""):
        self.widths = widths(n)
        self.levels = [dict(known)]
        for level, width in enumerate(self.widths[:-1]):
            here = self.levels[-1]
            runs = {p // FAN for p in here}
            here.update((p, digest) for (at, p), digest in fetched.items() if at == level)
            self.levels.append({r: joined(here[p] for p in range(FAN * r, min(FAN * r + FAN, width))) for r in runs})
        self.last = self.levels[-1][0]
        self._ways: list[dict[int, bytes]] = [{} for _ in self.levels]
        self._ways[-1][0] = beyond

    def beside(self, level: int, pos: int) -> tuple[bytes, bytes]:
        """The digests before and after a node in its run."""
        here, first = self.levels[level], pos - pos % FAN
        last = min(first + FAN, self.widths[level])
        return b"".join([here[p] for p in range(first, pos)]), b"".join([here[p] for p in range(pos + 1, last)])

    def way(self, level: int, pos: int) -> bytes:
        """The digests beside a node and its parents, from it upwards; those of a parent are put together once."""
        ways = self._ways[level]
        if pos not in ways:
            ways[pos] = b"".join(self.beside(level, pos)) + self.way(level + 1, pos // FAN)
        return ways[pos]

    def folded(self, pos: int, digest: bytes) -> bytes:
        """The last node as it follows from another digest in place of a leaf's."""
        for level in range(len(self.widths) - 1):
            before, after = self.beside(level, pos)
            digest, pos = joined((before, digest, after)), pos // FAN
        return digest


_PROOF_DDL = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prover(n_trees: int, proofs: bool):
    def prove(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        given = defaultdict(dict)
        for r in fetched.to_pylist():
            given[r["tree"]][r["level"], r["pos"]] = r["hash"].hex().encode()
        rows = leaves.to_pylist()
        known, size = defaultdict(dict), {}
        for r in rows:
            known[r["tree"]][r["pos"]], size[r["tree"]] = r["leaf"].hex().encode(), r["n"]
        subroots = {tree: Paths(size[tree], leaf, given[tree]).last for tree, leaf in known.items()}
        top = Paths(n_trees, subroots, given[TOP])
        trees = {tree: Paths(size[tree], leaf, given[tree], top.way(0, tree)) for tree, leaf in known.items()}
        out = defaultdict(list)
        for r in rows:
            tree, pos = r["tree"], r["pos"]
            way = trees[tree].way(0, pos)
            folded = top.folded(tree, trees[tree].folded(pos, r["other"].hex().encode()))
            values = {"leaf": known[tree][pos], "subroot": subroots[tree], "root": top.last, "proof_sha256": joined([way]), "folded_root": folded}
            for name, value in values.items():
                out[name].append(value.decode())
            out["verified"].append(folded == top.last)
            if proofs:
                out["proof"].append(way.decode())
        return pa.table({"id": leaves.column("id"), **out})

    return prove


def prove(placed: DataFrame, nodes: DataFrame, n_trees: int, proofs: bool = False) -> DataFrame:
    """For every leaf (id, leaf, subroot, root, proof_sha256, folded_root, verified): its proof against the manifest, and what ``other``
    gives with it. ``proofs`` adds the proof itself, digests in hexadecimal from the leaf upwards, left to right."""
    part = F.floor(F.col("at") / PARTITION).alias("part")
    members = placed.select(part, F.struct("tree", "n", "pos").alias("leaf")).groupBy("part").agg(F.collect_list("leaf").alias("leaves"))  # PARTITION at most
    asked = members.mapInArrow(_requests(n_trees), "part long, tree long, level int, pos long")
    # A leaf partition is a run of neighbours, so a leaf that another one lacks lies within a run of its border.
    near = placed.filter((F.col("at") % PARTITION < FAN - 1) | (F.col("at") % PARTITION >= PARTITION - (FAN - 1)))
    there = nodes.select("tree", "level", "pos", "hash").unionByName(near.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash")))
    fetched = asked.join(there, ["tree", "level", "pos"]).select("part", "tree", "level", "pos", "hash")
    kind = placed.schema["id"].dataType.simpleString()
    leaves = placed.select(part, "id", "leaf", "other", "tree", "n", "pos").groupBy("part")
    return leaves.cogroup(fetched.groupBy("part")).applyInArrow(_prover(n_trees, proofs), f"id {kind}, {_PROOF_DDL}{', proof string' if proofs else ''}")


def prove_rows(docs: DataFrame, columns: list[str], group: str, id_column: str, other: dict[str, Column] | None = None, proofs: bool = False) -> DataFrame:
    """The proof of every row of docs, with the id under its own name. ``other`` gives what stands in place of columns in the
    rows that are checked against the manifest of the rows as they are."""
    other = other or {}
    own, changed = [docs[c] for c in columns], [other.get(c, docs[c]) for c in columns]
    leaves = docs.select(docs[group].cast("string").alias("source"), docs[id_column].alias("id"), leaf_hash(*own).alias("leaf"), leaf_hash(*changed).alias("other"))
    placed, n_trees, most = placed_leaves(leaves)
    nodes = manifest(placed, n_trees, most)
    return prove(placed, nodes, n_trees, proofs).withColumnRenamed("id", id_column)

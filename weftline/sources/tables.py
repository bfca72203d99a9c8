"""Written intermediate tables, reused by fingerprint."""

from __future__ import annotations

import functools
import hashlib
import json
import pathlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import workspace


def _file_marks(spark: SparkSession, paths: list[str]) -> list[str]:
    """Path, length and modification time of every input file."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        status = fs.globStatus(root) or []
        for found in status:
            inner = fs.listStatus(found.getPath()) if found.isDirectory() else [found]
            marks += [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in inner]
    return sorted(marks)


@functools.cache
def _code_mark() -> str:
    """Digest of this package's source: a changed program does not read tables of an older one."""
    root = pathlib.Path(__file__).resolve().parent.parent
    return hashlib.sha256(b"".join(f.read_bytes() for f in sorted(root.rglob("*.py")))).hexdigest()


def fingerprint(spark: SparkSession, name: str, params: dict, inputs: list[str]) -> str:
    facts = json.dumps({"name": name, "params": params, "inputs": _file_marks(spark, inputs), "code": _code_mark()}, sort_keys=True)
    return hashlib.sha256(facts.encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _move(spark: SparkSession, path: str, target: str) -> None:
    if not exists(spark, target):
        Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(Path(path), Path(target))


def materialise(
    spark: SparkSession,
    name: str,
    params: dict,
    inputs: list[str],
    build: Callable[[], DataFrame],
    folder: str | None = None,
) -> DataFrame:
    """Write ``build()`` once under a path derived from its name, parameters and input files; read it from there.

    A finished table is recognised by its success mark, so a half-written one is never read. Each builder writes to a hidden
    folder of its own and moves it into place; a builder that comes second drops what it wrote.
    """
    root, own = folder or workspace(spark), f"{name}-{fingerprint(spark, name, params, inputs)}"
    path = f"{root}/{own}"
    if not exists(spark, path + "/_SUCCESS"):
        made = f".{own}-{uuid.uuid4().hex}"
        build().write.parquet(f"{root}/{made}")
        _move(spark, f"{root}/{made}", path)
        if not exists(spark, path + "/_SUCCESS"):  # a move that was broken off left its folder there
            return spark.read.parquet(f"{root}/{made}")
        # what was not moved, or was moved into the folder that another builder had just finished
        remove(spark, f"{root}/{made}")
        remove(spark, f"{path}/{made}")
    return spark.read.parquet(path)

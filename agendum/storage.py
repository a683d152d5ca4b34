"""Intermediate results in the folder that driver and executors share, instead of long lineages."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


class _Scopes(threading.local):
    """Folders in the shared folder by scope, the innermost last; each thread has its own, so jobs side by side keep theirs apart."""

    def __init__(self):
        self.stack: list[list[str]] = [[]]


_scopes = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; on a cluster ValueError is raised,
    as that would be a folder of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="agendum-"))
        root = _own[0]
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder there, which the innermost scope deletes."""
    _scopes.stack[-1].append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back; the innermost scope deletes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """Deletes at its end what was stored in it, but for what keep() was told; for callers that have consumed all of it."""
    _scopes.stack.append([])
    try:
        yield
    finally:
        _delete(_scopes.stack.pop())


def keep(df: DataFrame) -> DataFrame:
    """Leaves the newest stored folder, which df reads, to the scope outside."""
    _scopes.stack[-2].append(_scopes.stack[-1].pop())
    return df


def parts_for(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Partitions that hold about each rows at most, so that a task's share does not grow with the table; the session's at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


@contextmanager
def shuffled_for(spark: SparkSession, rows: int):
    """Shuffles of what is run inside have parts_for(rows) partitions; AQE joins them where they are small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts_for(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drop_stored() -> None:
    """Deletes all that was stored in this thread outside of any scope; for callers that are done with all results."""
    _delete(_scopes.stack[0])
    _scopes.stack[0].clear()


def _delete(paths: list[str]) -> None:
    for path in paths:
        system, base = fs.FileSystem.from_uri(path)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)

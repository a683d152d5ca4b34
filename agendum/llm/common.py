"""What the operators share: tables, the shared folder, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII digits, lower-case ASCII letters and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same lower-casing for Python strings.
ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Rows of an Arrow batch at most.
BATCH_ROWS = 2000

_shipped: dict[str, str] = {}
#: Folders in the shared folder by scope, the innermost last.
_scopes: list[list[str]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary one; on a cluster that would be a folder of one machine, so ValueError is raised."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _shipped.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="agendum-"))
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder there, which the innermost scope deletes."""
    _scopes[-1].append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it survives lost executors and cuts the lineage.

    Spark removes the shuffle files of the write when it is done, as nothing reads them again.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = shared_path(spark, name), spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope():
    """Deletes at its end what was stored in it, but for what keep() was told; for callers that have consumed all of it."""
    _scopes.append([])
    try:
        yield
    finally:
        _delete(_scopes.pop())


def keep(df: DataFrame) -> DataFrame:
    """Leaves the newest stored folder, which df reads, to the scope outside."""
    _scopes[-2].append(_scopes[-1].pop())
    return df


def drop_stored() -> None:
    """Deletes all that was stored in this process outside of any scope; for callers that are done with all results."""
    _delete(_scopes[0])
    _scopes[0].clear()


def _delete(paths: list[str]) -> None:
    for path in paths:
        system, base = fs.FileSystem.from_uri(path)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, most: int = 10_000) -> DataFrame:
    """left joined with right, which has one row for each key and the number n of left rows with it; rows: of left in all.

    Keys of more than rows / most left rows (100 at least), so at most `most` of them, are broadcast; left rows of these
    stay where they are and no task gets a hot key. The most frequent key always counts as one, so the plan is the same
    at every size. The rest meet by a shuffle of keys with few rows each.
    """
    many = max(100, rows // most)
    first = right.agg(F.max_by(F.struct(*right.columns), F.struct("n", key)).alias("r")).select("r.*").filter(F.col("n") <= many)
    hot, cold = F.broadcast(right.filter(F.col("n") > many).unionByName(first).drop("n")), right.filter(F.col("n") <= many).drop("n")
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def ship(spark: SparkSession) -> None:
    """Sends this package's files to the executors, once for each application, and makes Arrow batches small: a row holds a whole text."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="agendum-"), "agendum_files.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def fresh(df: DataFrame, stem: str) -> str:
    """A column name beginning with stem that df does not have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def parallelism(spark: SparkSession) -> int:
    """Partitions for work dealt out by hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def slices(texts: list[str | None], chars: int = 500_000):
    """Ranges of texts of about so many characters, one text at least."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def without(df: DataFrame, names) -> list[str]:
    """Columns of df but for those that an operator is about to add."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import ensure_checkpoint_dir, ship_package

# ASCII white space: the word separators of every operator here
SPACE = r"[\x20\x09-\x0D]+"
# rows and bytes of one Arrow batch sent to a Python task (texts can be long)
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Shared folder, package on the executors, bounded Arrow batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor sees."""
    app = spark.sparkContext.applicationId
    path = os.path.join(ensure_checkpoint_dir(spark), f"llm-{app}", f"{name}-{uuid.uuid4().hex}")
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and lets later joins see real sizes."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


# paths of the open scopes, innermost last
_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at the end, but for those named to the function
    it gives: tables from ``written`` or paths. These belong to the scope around it."""
    kept: set = set()

    def keep(*things):
        kept.update(t if isinstance(t, str) else t.work_path for t in things)
        return things[0] if things else None

    _SCOPES.append([])
    try:
        yield keep
    finally:
        made = _SCOPES.pop()
        remove_folders(spark, [p for p in made if p not in kept])
        if _SCOPES:
            _SCOPES[-1].extend(p for p in made if p in kept)


@contextmanager
def noted(folders: list[str]):
    """Note the folders made inside that outlive their scopes in ``folders``."""
    _SCOPES.append(folders)
    try:
        yield
    finally:
        _SCOPES.remove(folders)


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``df`` has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name that may hold dots or back quotes."""
    return "`" + name.replace("`", "``") + "`"


def remove_work_tables(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder."""
    remove_folders(spark, [os.path.join(ensure_checkpoint_dir(spark), f"llm-{spark.sparkContext.applicationId}")])


_HELD: dict = {}


def worker_object(key, make):
    """The large object (a tokenizer with its cache, a mapped model) that this Python
    worker holds under ``key``. A worker outlives its tasks and serves several
    operators, so it holds one such object: the last one asked for."""
    if key not in _HELD:
        release_worker_object()
        _HELD[key] = make()
    return _HELD[key]


def release_worker_object() -> None:
    """Give back what an earlier operator's tasks left in this worker."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def lower_ascii(c: Column | str) -> Column:
    """Lower-case A-Z only (locale-free)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column | str) -> Column:
    """Words of a text as an array; empty for null or blank texts."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE, -1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row. A lambda that indexes
    into an expression would otherwise compute it anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(w: Column, n: int, whole_if_short: bool = True) -> Column:
    """64-bit hashes of the ``n``-word shingles of a word array, in order.

    A shorter, non-empty array gives one shingle of all its words unless
    ``whole_if_short`` is false; an empty one gives none."""
    none = F.array().cast("array<bigint>")

    def of(a):
        runs = F.transform(F.sequence(F.lit(0), F.size(a) - n),
                           lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(n)]))
        short = F.when(F.size(a) == 0, none).otherwise(
            F.array(F.xxhash64(F.array_join(a, " ")))) if whole_if_short else none
        return F.when(F.size(a) >= n, runs).otherwise(short)

    return let(w, of)


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only for a table proven to be small; otherwise Spark joins
    it as it sees fit (shuffle join with skew handling)."""
    return F.broadcast(df) if bounded(df, max_rows) else df

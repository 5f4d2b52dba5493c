"""Sinks and resumable runs.

Outputs are partitioned tables; resuming is an anti-join against what is
already written, then an append - the write itself is the checkpoint, so a
lost executor or a restarted job only redoes missing keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagesift.operators.relational import pending


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> None:
    """Partitioned parquet, csv (with header) or json."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_results_json(df: DataFrame, path: str, partition_by=("category", "site")) -> None:
    """Per-seed results as JSON rows without the raw HTML."""
    write_table(df.drop("raw_html", "html"), path, "json", list(partition_by), "append")


def read_done(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resume(spark: SparkSession, todo: DataFrame, path: str, keys: list[str], run,
           fmt: str = "parquet", partition_by=None) -> DataFrame:
    """Run ``run(pending_rows)`` only for keys without output,
    append its result, return everything written so far."""
    done = read_done(spark, path, fmt)
    rest = todo if done is None else pending(todo, done, keys)
    out = run(rest)
    write_table(out, path, fmt, partition_by, "append")
    return spark.read.format(fmt).load(path)


def convert_ground_truth(spark: SparkSession, root: str, out: str) -> None:
    """All sites' ground truth in one partitioned Parquet table."""
    from pagesift.sources.swde import read_ground_truth, truth_maps
    t = truth_maps(read_ground_truth(spark, root))
    write_table(t.withColumn("attributes", F.to_json("attributes")), out, "parquet",
                ["category", "site"])

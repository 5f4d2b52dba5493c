"""Spark session and shared-folder helpers.

Library functions never create a session; they take DataFrames. Tests, the
bench and the entry point use :func:`get_spark`.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))
_REPO_DIR = os.path.dirname(_PKG_DIR)
_SHIPPED: set = set()


def get_spark(app: str = "pagesift", cpus: int | str = "*", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    pp = os.environ.get("PYTHONPATH", "")
    if _REPO_DIR not in pp.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join([p for p in (_REPO_DIR, pp) if p])
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Pages are large rows: keep Arrow batches into Python tasks small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``pagesift`` importable in Python workers (pandas UDFs, mapInArrow).

    The package is zipped once per application on the driver and handed to
    ``addPyFile``, which distributes it to every executor (what ``--py-files``
    does). With a local checkpoint folder the zip is written there; with a
    remote one it is written next to the driver's other temporary files only
    as the source of that upload.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    ckpt = ensure_checkpoint_dir(spark)
    local = ckpt.replace("file:", "") if ("://" not in ckpt or ckpt.startswith("file:")) else None
    folder = local or tempfile.mkdtemp(prefix="pagesift-pkg-")
    path = os.path.join(folder, f"pagesift-{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(_PKG_DIR):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, _REPO_DIR))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is given and must point at shared storage; it is
    only filled in here when unset (local runs and tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pagesift-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A table location inside the shared checkpoint folder (cuts lineage)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)

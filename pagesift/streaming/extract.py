"""Apply a static program table to a stream of pages (R1) with exactly-once
intake by page key (R2).

Intake is keyed state: a stateful operator holds one small entry per page key
in RocksDB, so a batch is told apart from what came before without reading
anything but its own rows. Entries expire after a time-to-live; a page that
comes again later than that counts as new. Each micro-batch goes through the
batch operators (``explode_dom`` + ``apply_programs``) and is written to a
folder of its own, named by run and batch: a batch that is replayed after a
failure gets the same pages from the state's version of that batch and
replaces its folder, so nothing is written twice.

A run whose checkpoint is new, but whose sink already holds pages (a lost
checkpoint), takes the sink's keys as the state's initial rows, once, in its
first batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagesift.functions.text import site_of
from pagesift.operators.dom import explode_dom
from pagesift.operators.xpath import apply_programs
from pagesift.sources.sinks import read_done

# how long a page key is remembered
TTL_DAYS = 30
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Passes on the first row of each key and remembers the key for ``ttl_ms``."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = next((r for r in rows if len(r)), None)
        if first is not None and not self.seen.exists():
            self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))
            yield first.head(1)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((timerValues.getCurrentProcessingTimeInMs(),))

    def close(self) -> None:
        pass


def page_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet",
                files_per_trigger: int = 1) -> DataFrame:
    """Pages arriving as parquet files named ``glob`` in ``folder``."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("basePath", folder).parquet(f"{folder.rstrip('/')}/{glob}"))


def first_by_key(source: DataFrame, key: str, known: DataFrame | None = None, ttl_days: float = TTL_DAYS) -> DataFrame:
    """R2: the stream's rows, one per ``key``, across all batches and restarts.
    ``known`` (a batch table with ``key``) counts as seen before the first batch."""
    initial = None if known is None else known.select(key).groupBy(key)
    return source.groupBy(key).transformWithStateInPandas(
        FirstOfKey(int(ttl_days * 86_400_000)), source.schema, "Append", "ProcessingTime", initial)


def extract_batch(batch: DataFrame, programs: DataFrame, out_path: str, key: str = "page_id",
                  broadcast_programs: bool | None = None) -> None:
    """Apply the programs to one batch of distinct pages and write ``out_path``.
    A page whose site has no program gets one row with a null field."""
    pages = batch.withColumn("site", site_of("url"))
    spark = batch.sparkSession  # of the stream only
    # a batch's tables would go through the driver again and again, batch after batch
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # read by several branches of the program plan: parsed once per batch, and dealt out once for all joins by page
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes = explode_dom(pages, keep=["site"]).repartition(n, key).checkpoint(eager=True)
    res = apply_programs(nodes, programs, ["site"], ["field"], "program", None, broadcast_programs)
    res = res.select(key, "site", "field", "program", "values", "invalid")
    sites = programs.select("site").distinct()
    without = nodes.filter("parent_id = -1").select(key, "site").distinct().join(sites, "site", "left_anti").select(
        key, "site", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("program"),
        F.array().cast("array<string>").alias("values"), F.lit(False).alias("invalid"))
    res.unionByName(without).write.mode("overwrite").parquet(out_path)


def run_extraction(spark: SparkSession, source: DataFrame, programs: DataFrame, out_path: str,
                   checkpoint: str, available_now: bool = True, key: str = "page_id", ttl_days: float = TTL_DAYS):
    """Start the stream; with ``available_now`` it drains what is there and stops.
    ``out_path`` is one table, partitioned by ``run`` and ``batch``."""
    progs = programs.checkpoint(eager=True)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    known = read_done(spark, out_path)
    if known is not None:
        known = known.filter(F.col("run") != run)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # a processing-time operator would ask for batches without data for ever
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    w = (first_by_key(source, key, known, ttl_days).writeStream.option("checkpointLocation", checkpoint)
         .outputMode("append")
         .foreachBatch(lambda df, batch: extract_batch(df, progs, f"{out_path.rstrip('/')}/run={run}/batch={batch}", key)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

"""Shared loaders and guards for plans over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import category_of, site_of
from pagesift.operators.dom import explode_dom
from pagesift.session import ensure_checkpoint_dir, ship_package

# node table hash-partitioned by page and reused by page-keyed joins
CO_PARTITION = True
# pages are large rows: bound the rows per Arrow batch sent to Python tasks
MAX_ARROW_ROWS = 256
# pages in a partition of the node table (some 60 nodes each in the harness tables)
PAGES_PER_PARTITION = 4096
# pages for which a partition more is worth its task
FEW_PAGES = 256


def prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # joins keyed (page_id, x) may reuse a page_id partitioning; a page is a
    # bounded unit, so partitioning by page alone cannot concentrate skew
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not CO_PARTITION).lower())
    cur = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if cur > MAX_ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_ARROW_ROWS))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def keyed_pages(spark: SparkSession, d: str) -> DataFrame:
    """pages + site (host) + category (language segment): the SWDE-style keys."""
    return table(spark, d, "pages").withColumn("site", site_of("url")).withColumn(
        "category", category_of("url"))


def keyed_nodes(spark: SparkSession, d: str, materialize: bool = True) -> DataFrame:
    """Node table of the harness pages. Parsed once: the Python parse runs a
    single time and the table is checkpointed to the shared folder, because
    every plan reads it several times (roots, matches, text chunks).

    Materialized hash-partitioned by ``page_id``: every later join, window and
    aggregate is keyed by page first, so with co-partitioning on the page key
    only the small side of those joins moves (one shuffle of the node table
    instead of one per join)."""
    pages = keyed_pages(spark, d)
    nodes = explode_dom(pages, keep=["site", "category"])
    if not materialize:
        return nodes
    if not CO_PARTITION:
        return nodes.checkpoint(eager=True)
    # a scan's split holds tens of times its bytes as nodes, which every join sorts:
    # so many pages a partition at any scale, and at least one partition per core. With
    # fewer partitions than a shuffle has, joins would deal out the whole table again;
    # only small tables, whose joins are broadcast, stay below that
    return dealt_by_page(nodes, max(pages.rdd.getNumPartitions(), _partitions(spark, pages.count())))


def _partitions(spark: SparkSession, count: int) -> int:
    """Partitions for the node table of ``count`` pages."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(shuffle, -(-count // FEW_PAGES)), -(-count // PAGES_PER_PARTITION))


def nodes_of(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The node table of the pages in ``keys`` alone, in as few partitions as these need,
    for plans that look at chosen pages only. The keys are hashed in each partition:
    a sort-merge join would sort the whole table to find them."""
    chosen = nodes.join(keys.select("page_id").hint("shuffle_hash"), "page_id", "left_semi")
    return dealt_by_page(chosen, _partitions(nodes.sparkSession, keys.count()))


def dealt_by_page(nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` checkpointed in ``n`` partitions by page, so that later plans know it.
    An adaptive plan does not tell its partitioning: a checkpoint of one is dealt
    out anew by every join and aggregate by page."""
    conf = nodes.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return nodes.repartition(n, "page_id").checkpoint(eager=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def site_programs(pages: DataFrame, rows: list[tuple[str, str]], lang: str = "xpath") -> DataFrame:
    """Programs table: the given (field, program) rows for every site present."""
    lit = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("program")) for f, p in rows])
    return pages.select("site").distinct().select("site", F.explode(lit).alias("p")).select(
        "site", "p.field", "p.program", F.lit(lang).alias("lang"))

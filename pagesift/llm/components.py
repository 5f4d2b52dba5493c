"""Connected components by alternating star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import written


def _mark(e: DataFrame):
    """Size and order-free checksum of an edge table."""
    return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("sum(xxhash64(lo, hi) % 1000003)")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b) that is not itself
    the smallest of its component; ``root`` is that smallest node.

    Each round points every node's larger neighbours to the smallest node it
    knows, then does the same for the smaller ones; the edges end as stars."""
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                .distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.selectExpr("hi AS u", "lo AS v").unionByName(e.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").filter("lo <> m").selectExpr("lo AS hi", "m AS lo")
                 .unionByName(least.selectExpr("hi", "m AS lo")).distinct())
        e = written(small, "small-star")
        last, mark = mark, _mark(e)
        if tuple(last) == tuple(mark):
            break
    return e.selectExpr("hi AS node", "lo AS root")

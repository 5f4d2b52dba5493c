"""Sampling, prefix dedup, upserts and reshapes."""

from pyspark.sql import functions as F

from pagesift.operators import relational, sampling


def test_prefix_dedup_boundary(spark):
    df = spark.createDataFrame([(1, p) for p in ["/a/b", "/a/b[2]", "/a/bc", "/a/b/c"]],
                               "page_id long, path string")
    kept = sorted(r.path for r in relational.prefix_dedup(df, ["page_id"], "path").collect())
    assert kept == ["/a/b", "/a/b[2]", "/a/bc"]
    raw = sorted(r.path for r in relational.prefix_dedup(df, ["page_id"], "path", raw_prefix=True).collect())
    assert raw == ["/a/b"]


def test_sample_per_group_min_n(spark):
    df = spark.createDataFrame([("s1", i) for i in range(10)] + [("s2", 100)], "site string, page_id long")
    s = sampling.sample_per_group(df, ["site"], 3)
    counts = {r.site: r["count"] for r in s.groupBy("site").count().collect()}
    assert counts == {"s1": 3, "s2": 1}
    seeds, pool = sampling.split_seeds(df, ["site"], 3)
    assert pool.count() == 11 - 4
    assert pool.join(seeds, ["site", "page_id"]).count() == 0


def test_rank_in_group_is_dense_and_complete(spark):
    df = spark.createDataFrame([("s", i) for i in range(500)] + [("t", i) for i in range(7)],
                               "site string, page_id long")
    r = sampling.rank_in_group(df, ["site"], sampling.md5_order(F.col("page_id"), 0), buckets=16)
    got = {(x.site, x.rank) for x in r.collect()}
    assert got == {("s", k) for k in range(1, 501)} | {("t", k) for k in range(1, 8)}


def test_upsert_and_overlay(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    right = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    out = sorted((r.id, r.v, r.side) for r in relational.upsert_by_id(left, right).collect())
    assert out == [(1, "a", 0), (2, "B", 1), (3, "C", 1)]
    m = spark.createDataFrame([({"x": "1", "y": "2"}, {"y": "9", "z": "3"})],
                              "a map<string,string>, b map<string,string>")
    r = m.select(relational.overlay_map(F.col("a"), F.col("b")).alias("m")).first().m
    assert r == {"x": "1", "y": "9", "z": "3"}


def test_long_to_wide_fills_empty(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y", "z"])],
                               "page_id long, field string, values array<string>")
    w = {r.page_id: r for r in relational.long_to_wide(df, ["page_id"], ["a", "b"]).collect()}
    assert w[1].b == [] and w[2].b == ["y", "z"] and w[2].a == []

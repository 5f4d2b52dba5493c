"""Seeded per-group sampling (W1, W2, W3, J6) and skew-safe per-group ranking.

Order is ``md5(key || '#' || seed)`` so any engine can reproduce it (numpy's
draws cannot be matched). A group may hold a third of all rows, so neither
top-n nor ranks use a window over a whole group: rows are first spread over
``salt`` sub-groups (hash of the key), ranked there, and only per-sub-group
summaries (n rows or one count each) meet per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def md5_order(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def _salt(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def top_n_per_group(df: DataFrame, group_cols: list[str], order: Column, n: int,
                    tie: str | None = None, buckets: int = SALT_BUCKETS,
                    rank_col: str = "rn") -> DataFrame:
    """Keep the first ``n`` rows of every group by ``order`` (ascending), with
    their rank. Two phases: top-n per (group, salt), then top-n per group over
    at most ``buckets * n`` candidates."""
    tie_c = [F.col(tie)] if tie else []
    d = df.withColumn("_o", order).withColumn("_s", _salt(F.col("_o"), buckets))
    w1 = Window.partitionBy(*group_cols, "_s").orderBy(F.col("_o"), *tie_c)
    d = d.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(F.col("_o"), *tie_c)
    return d.withColumn(rank_col, F.row_number().over(w2)).filter(
        F.col(rank_col) <= n).drop("_o", "_s", "_r")


def sample_per_group(df: DataFrame, group_cols: list[str], n: int, key: str = "page_id",
                     seed: int | str = 0) -> DataFrame:
    """Exactly min(group size, n) rows per group, seeded, no replacement."""
    return top_n_per_group(df, group_cols, md5_order(F.col(key), seed), n, tie=key)


def split_seeds(df: DataFrame, group_cols: list[str], n: int, key: str = "page_id",
                seed: int | str = 0) -> tuple[DataFrame, DataFrame]:
    """W1 + J6: seeds per group and the evaluation pool without them (anti-join)."""
    seeds = sample_per_group(df, group_cols, n, key, seed)
    # dealt by the whole key: a plan that kept the seeds by group would move every
    # row of a large group to one task
    chosen = seeds.select(*group_cols, key).repartition(*group_cols, key)
    pool = df.join(chosen, group_cols + [key], "left_anti")
    return seeds, pool


def rank_in_group(df: DataFrame, group_cols: list[str], order: Column,
                  buckets: int = SALT_BUCKETS) -> DataFrame:
    """``order`` must be an md5 hex string (see :func:`md5_order`). Dense 1..m rank of each row within its group by ``order`` plus group size
    ``m``, without a window over a whole group: rank inside (group, salt) where
    salt is a range split of the order key, then add the counts of the earlier
    salts (a per-group prefix sum over at most ``buckets`` rows)."""
    d = df.withColumn("_o", order)
    # order-preserving salt: a range split on the first two hex digits of the md5 key
    d = d.withColumn("_s", F.floor(F.conv(F.substring(F.col("_o"), 1, 2), 16, 10).cast("int")
                                   * min(buckets, 256) / 256).cast("int"))
    w = Window.partitionBy(*group_cols, "_s").orderBy("_o")
    d = d.withColumn("_r", F.row_number().over(w))
    counts = d.groupBy(*group_cols, "_s").agg(F.count(F.lit(1)).alias("_c"))
    wp = Window.partitionBy(*group_cols).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_c").over(wp), F.lit(0))).withColumn(
        "m", F.sum("_c").over(Window.partitionBy(*group_cols)))
    # dealt by (group, salt), as the ranked rows are: counts kept by group would draw
    # every row of a large group to one task
    return d.join(counts.repartition(*group_cols, "_s"), group_cols + ["_s"]).withColumn(
        "rank", (F.col("_r") + F.col("_off")).cast("long")).drop("_o", "_s", "_r", "_c", "_off")


def sample_with_replacement(df: DataFrame, group_cols: list[str], n: int, key: str = "page_id",
                            seed: int | str = 0) -> DataFrame:
    """``n`` draws with replacement per group. Draw k picks rank
    ``pmod(int(md5(group#k#seed)[0:8], 16), m) + 1`` of the md5 key order."""
    ranked = rank_in_group(df, group_cols, md5_order(F.col(key), seed))
    groups = ranked.select(*group_cols, "m").distinct()
    gkey = F.concat_ws("#", *[F.col(c).cast("string") for c in group_cols])
    draws = groups.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn(
        "rank", (F.pmod(F.conv(F.substring(F.md5(F.concat(gkey, F.lit("#"), F.col("draw").cast(
            "string"), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("long"), F.col("m")) + 1).cast("long"))
    return draws.repartition(*group_cols, "rank").join(ranked.drop("m"), group_cols + ["rank"])

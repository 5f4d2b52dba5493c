"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_floor(c: Column, width: int) -> Column:
    """Floor to a multiple of ``width``."""
    return (F.floor(c / F.lit(width)) * F.lit(width)).cast("long")


def mean_by_bin(df: DataFrame, value_cols: list[str], bin_col: str) -> DataFrame:
    """A1: mean per bin, truncated to an integer."""
    return df.groupBy(bin_col).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.floor(F.avg(c)).alias(f"mean_{c}") for c in value_cols])


def describe_by_bin(df: DataFrame, bin_col: str, value_col: str, digits: int = 6) -> DataFrame:
    """Count, mean, std, min, 5/50/95 % (interpolated like pandas), max per
    bin. Use :func:`explode_values` first for an array column."""
    x = F.col(value_col).cast("double")
    return df.groupBy(bin_col).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(x), digits).alias("mean"),
        F.round(F.stddev_samp(x), digits).alias("std"),
        F.min(x).alias("min"),
        F.round(F.percentile(x, F.lit(0.05)), digits).alias("p05"),
        F.round(F.percentile(x, F.lit(0.5)), digits).alias("p50"),
        F.round(F.percentile(x, F.lit(0.95)), digits).alias("p95"),
        F.max(x).alias("max"))


def explode_values(df: DataFrame, keys: list[str], array_col: str, out: str) -> DataFrame:
    """A6 input: explode an array column, empty arrays contribute one 0."""
    e = df.select(*keys, F.explode_outer(array_col).alias(out))
    return e.withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def corr_by_group(df: DataFrame, group_cols: list[str], a: str, b: str, digits: int = 6) -> DataFrame:
    """Pearson correlation from centred moments; zero variance gives 0 (not an error)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("cov"),
                                    F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    r = F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide("cov", F.sqrt(F.col("vx") * F.col("vy"))))
    return g.select(*group_cols, "n", F.round(F.coalesce(r, F.lit(0.0)), digits).alias(f"corr_{a}_{b}"))


def ratio(num: Column, den: Column) -> Column:
    """Ratio with null on a zero denominator (no ANSI error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def imperfect(df: DataFrame, rate: str = "match_rate") -> DataFrame:
    """Rows whose rate is below one."""
    return df.filter(F.col(rate) < 1)


def in_grid(df: DataFrame, **bounds) -> DataFrame:
    """Rows inside all given bounds, ``column=(least, most)``; null is no bound."""
    for c, (least, most) in bounds.items():
        if least is not None:
            df = df.filter(F.col(c) >= least)
        if most is not None:
            df = df.filter(F.col(c) <= most)
    return df


def compression_by_group(df: DataFrame, group_cols: list[str], raw: str,
                         targets: list[str], digits: int = 6) -> DataFrame:
    """Mean of each target column over the mean raw size, long form."""
    g = df.groupBy(*group_cols).agg(F.avg(raw).alias("_raw"), *[F.avg(t).alias(t) for t in targets])
    wide = g.select(*group_cols, *[F.round(ratio(F.col(t), F.col("_raw")), digits).alias(t)
                                   for t in targets])
    return wide.unpivot(group_cols, targets, "target", "ratio")


def failure_rates(df: DataFrame, group_cols: list[str], failed: Column) -> DataFrame:
    """Failed count and rate per group, sorted by rate desc."""
    g = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("total"),
                                    F.count_if(failed).alias("failed_count"))
    return g.withColumn("failed_rate", ratio(F.col("failed_count"), F.col("total"))).orderBy(
        F.desc("failed_rate"), *group_cols)


def successive_drops(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Difference to the previous value in order (first row: none)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("drop", F.lag(value).over(w) - F.col(value))

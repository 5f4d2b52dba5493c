"""Keyed merges and reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import py_strip

def _empty() -> Column:
    return F.array().cast("array<string>")


def upsert_by_id(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Right replaces left rows with the same id; left-only rows are kept
    first, then all right rows; ``side`` (0 = kept left, 1 = right) carries
    that order. Null ids are an error upstream: check with ``null_ids``."""
    l_only = left.join(right.select(key), key, "left_anti").withColumn("side", F.lit(0))
    r = right.withColumn("side", F.lit(1))
    return l_only.unionByName(r, allowMissingColumns=True)


def null_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isNull())


def merge_operators(left: DataFrame, right: DataFrame, keys: list[str], path: str = "xpath",
                    seq: str = "seq") -> DataFrame:
    """Upsert operator rows by (keys, path): right values win, left order is
    kept, right-only paths are appended after the left ones."""
    l = left.select(*keys, path, F.col(seq).alias("l_seq"),
                    F.struct(*[c for c in left.columns if c not in keys + [path, seq]]).alias("l"))
    r = right.select(*keys, path, F.col(seq).alias("r_seq"),
                     F.struct(*[c for c in right.columns if c not in keys + [path, seq]]).alias("r"))
    j = l.join(r, keys + [path], "full_outer")
    w = Window.partitionBy(*keys).orderBy(
        F.col("l_seq").isNull(), F.coalesce("l_seq", "r_seq"), path)
    out = j.select(*keys, path, F.coalesce("r", "l").alias("v"),
                   F.row_number().over(w).alias(seq))
    return out.select(*keys, path, seq, "v.*")


def overlay_map(a: Column, b: Column) -> Column:
    """Map overlay, right wins."""
    return F.map_zip_with(a, b, lambda k, v1, v2: F.coalesce(v2, v1))


def overlay_truth(ann: DataFrame, gt: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """Ground truth over extracted values: a missing field is added, a
    present one gets the true values; the cue text of the annotation stays."""
    a = ann.select(*keys, field, F.col("values").alias("a_values"), "cue_text")
    g = gt.select(*keys, field, F.col("values").alias("g_values"))
    j = a.join(g, keys + [field], "full_outer")
    return j.select(*keys, field, F.coalesce("g_values", "a_values").alias("values"), "cue_text")


def long_to_wide(df: DataFrame, keys: list[str], fields: list[str], field: str = "field",
                 values: str = "values") -> DataFrame:
    """One column per field, absent becomes []. The field list is given so
    the pivot needs no extra pass to discover it."""
    w = df.groupBy(*keys).pivot(field, fields).agg(F.first(values))
    return w.select(*keys, *[F.coalesce(F.col(f), _empty()).alias(f) for f in fields])


def melt(df: DataFrame, ids: list[str], value_cols: list[str], var: str = "variable",
         val: str = "value") -> DataFrame:
    """A16."""
    return df.unpivot(ids, value_cols, var, val)


def proper_ancestor_paths(path: Column) -> Column:
    """'/a/b/c' -> ['/a', '/a/b'] (step-boundary aware, no trailing slash)."""
    p = F.regexp_replace(path, "/+$", "")
    parts = F.split(F.substring(p, F.lit(2), F.length(p)), "/")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))


def prefix_dedup(df: DataFrame, keys: list[str], path: str = "path",
                 raw_prefix: bool = False) -> DataFrame:
    """Drop paths that have a proper ancestor path in the same key group.

    Equi anti-join on exploded ancestors (never a ``startswith`` theta join,
    which plans as a nested loop). ``raw_prefix=True`` reproduces the plain
    string-prefix behaviour (``/a/b`` also removes ``/a/b[2]`` and ``/a/bc``).
    """
    d = df.select(*keys, path).distinct()
    if raw_prefix:
        pref = d.select(*keys, path, F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(path) - 1, F.lit(1))),
            lambda i: F.substring(F.col(path), 1, i))).alias("anc"))
    else:
        pref = d.select(*keys, path, F.explode(proper_ancestor_paths(F.col(path))).alias("anc"))
    pref = pref.filter(F.col("anc") != F.col(path))
    have = d.select(*keys, F.col(path).alias("anc"))
    covered = pref.join(have, keys + ["anc"], "left_semi").select(*keys, path).distinct()
    return df.join(covered, keys + [path], "left_anti")


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def unique_merge(a: Column, b: Column) -> Column:
    """Ordered union-distinct of two lists."""
    return F.array_distinct(F.concat(F.coalesce(a, _empty()), F.coalesce(b, _empty())))


def keep_positions(arr: Column, removed: Column) -> Column:
    """Drop the 0-based positions listed in ``removed``."""
    return F.filter(arr, lambda x, i: ~F.array_contains(removed, i))


def drop_meta_keys(m: Column, keys: tuple = ("_thought",)) -> Column:
    """P13."""
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def compact_values(*cols: Column) -> Column:
    """Collapse value columns to one array without nulls."""
    return F.array_compact(F.array(*cols))


def clean_values(values: Column) -> Column:
    """Keep non-blank stripped values."""
    return F.filter(F.transform(values, py_strip), lambda x: x != "")


def zip_lists(*cols: Column) -> Column:
    """Positional zip of parallel lists (shorter ones padded with null)."""
    return F.arrays_zip(*cols)

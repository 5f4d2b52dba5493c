"""Readers for the SWDE-style corpus layout.

Layout::

    {root}/{category}/{category}-{site}({pages})/{page_id}.htm       raw pages
    {root}/groundtruth/{category}/{category}-{site}-{attribute}.txt  ragged TSV truth
    {root}/{category}/{category}-{site}({pages}).json                expanded truth
    {questions}/{category}_{site}.txt                                question text

Every reader is one Spark scan (``wholetext`` for small per-file documents)
with keys parsed from ``_metadata.file_path``; nothing is listed or looped on
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.text import normalize_text

PAGE_PATH = r"/([a-z]+)/([a-z]+)-([^/(]+)\((\d+)\)/([^/]+)\.htm$"


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(category, site, page_id, pages, path, html, page_key), one row per file.

    ``page_id`` is the file's name and repeats from site to site; ``page_key`` is
    unique: tree operators take it as ``explode_dom(pages, id_col="page_key")``."""
    df = spark.read.text(f"{root.rstrip('/')}/*/*/*.htm", wholetext=True).select(
        F.col("value").alias("html"), F.col("_metadata.file_path").alias("path"))
    p = F.col("path")
    return df.select(
        F.regexp_extract(p, PAGE_PATH, 1).alias("category"),
        F.regexp_extract(p, PAGE_PATH, 3).alias("site"),
        F.regexp_extract(p, PAGE_PATH, 5).alias("page_id"),
        F.regexp_extract(p, PAGE_PATH, 4).cast("int").alias("pages"),
        "path", "html").withColumn("page_key", page_key("category", "site", "page_id"))


def categories(pages: DataFrame) -> DataFrame:
    """Lower-case category names (not the ground-truth folder)."""
    return pages.select("category").distinct().filter(
        F.col("category").rlike("^[a-z]+$") & (F.col("category") != "groundtruth"))


def sites(pages: DataFrame) -> DataFrame:
    """S3: sites with their declared page counts."""
    return pages.select("category", "site", "pages").distinct()


def page_key(*cols) -> F.Column:
    """P10: ``category_site_pageid``."""
    return F.concat_ws("_", *cols)


def split_key(key: F.Column) -> list:
    """Composite id back to its parts."""
    parts = F.split(key, "_")
    return [F.element_at(parts, 1).alias("category"), F.element_at(parts, 2).alias("site"),
            F.element_at(parts, -1).alias("page_id")]


def read_ground_truth(spark: SparkSession, root: str, normalize: bool = False) -> DataFrame:
    """S4 (+ S5 when ``normalize``): long truth ``(category, site, page_id,
    field, values)`` from the ragged TSV files; 2 header lines skipped, blank
    lines dropped, rows whose first value is ``<NULL>`` dropped."""
    df = spark.read.text(
        f"{root.rstrip('/')}/groundtruth/*/*.txt", wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    df = df.select(
        F.regexp_extract("path", r"/([a-z]+)-([^/]+)-([^/-]+)\.txt$", 1).alias("category"),
        F.regexp_extract("path", r"/([a-z]+)-([^/]+)-([^/-]+)\.txt$", 2).alias("site"),
        F.regexp_extract("path", r"/([a-z]+)-([^/]+)-([^/-]+)\.txt$", 3).alias("field"),
        F.posexplode(F.split("value", r"\r?\n")).alias("ln", "line"))
    df = df.filter((F.col("ln") >= 2) & (F.trim("line") != ""))
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), "\t")
    df = df.select("category", "site", "field", F.element_at(parts, 1).alias("page_id"),
                   F.slice(parts, 3, F.size(parts)).alias("values"))
    df = df.filter(F.coalesce(F.get("values", F.lit(0)), F.lit("")) != "<NULL>")
    if normalize:
        df = normalize_values(df, ["category", "site", "page_id", "field"], "values")
    return df


def normalize_values(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    e = df.select(*keys, F.posexplode(col).alias("_p", "_v")).withColumn("_v", normalize_text("_v"))
    return e.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))),
                                            lambda x: x._v).alias(col))


def truth_maps(long_truth: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """S5 wide form: one row per page with ``attributes MAP<field, values>``;
    with ``fields`` (category, site, field) every known field of the site is
    present, missing ones as [] (J1's fill)."""
    t = long_truth
    if fields is not None:
        pages = t.select("category", "site", "page_id").distinct()
        grid = pages.join(fields, ["category", "site"])
        t = grid.join(t, ["category", "site", "page_id", "field"], "left").withColumn(
            "values", F.coalesce("values", F.array().cast("array<string>")))
    return t.groupBy("category", "site", "page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("attributes"))


def read_expanded_truth(spark: SparkSession, root: str) -> DataFrame:
    """``{page_id: {field: [values]}}`` files -> long truth; empty value
    lists and keys starting with '.' dropped, a trailing ':' stripped."""
    df = spark.read.text(f"{root.rstrip('/')}/*/*.json", wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    pat = r"/([a-z]+)/([a-z]+)-([^/(]+)\((\d+)\)\.json$"
    m = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.ArrayType(T.StringType()))))
    df = df.select(F.regexp_extract("path", pat, 1).alias("category"),
                   F.regexp_extract("path", pat, 3).alias("site"),
                   F.regexp_extract("path", pat, 4).cast("int").alias("pages"),
                   F.explode(m).alias("page_id", "fields"))
    df = df.select("category", "site", "pages", "page_id", F.explode("fields").alias("field", "values"))
    df = df.filter((F.size("values") > 0) & ~F.col("field").startswith("."))
    return df.withColumn("field", F.when(F.col("field").endswith(":"), F.trim(
        F.regexp_replace("field", ":$", ""))).otherwise(F.col("field")))


def site_queries(long_truth: DataFrame) -> DataFrame:
    """The query text built from the sorted distinct fields of each site (its
    wording is a fixed value)."""
    g = long_truth.groupBy("category", "site").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return g.select("category", "site", "fields", F.concat(
        F.lit("Please extract the following fields: "),
        F.array_join(F.transform("fields", lambda f: F.concat(
            F.lit("`"), f, F.lit("` of the "), F.col("category"))), ", ")).alias("query"))


def read_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Question text per (category, site); field names from backticks,
    or from the keys of a fenced JSON object."""
    df = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True).select(
        F.col("value").alias("query"), F.col("_metadata.file_path").alias("path"))
    fence = F.regexp_extract("query", r"(?s)```(?:json)?(.*?)```", 1)
    json_keys = F.map_keys(F.from_json(fence, T.MapType(T.StringType(), T.ArrayType(T.StringType()))))
    ticks = F.regexp_extract_all("query", F.lit(r"`([^`]+)`"), 1)
    return df.select(
        F.regexp_extract("path", r"/([a-z]+)_([^/]+)\.txt$", 1).alias("category"),
        F.regexp_extract("path", r"/([a-z]+)_([^/]+)\.txt$", 2).alias("site"), "query",
        F.when(fence != "", json_keys).otherwise(ticks).alias("fields"))


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema (never inferred)."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path)


TOKEN_STATS_SCHEMA = ("idx int, category string, site string, page_id int, file_path string, "
                      "attributes string, raw_tokens int, cleaned_tokens int")


def attach_html(rows: DataFrame, pages: DataFrame, keys=("category", "site", "page_id")) -> DataFrame:
    """Re-attach raw HTML to saved rows by key."""
    return rows.join(pages.select(*keys, "html"), list(keys))


def snippet_ids(df: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """Keep given ids, else md5 of the HTML."""
    if id_col not in df.columns:
        return df.withColumn(id_col, F.md5(html_col))
    return df.withColumn(id_col, F.coalesce(F.col(id_col), F.md5(html_col)))

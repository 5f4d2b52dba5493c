"""Tables inside pages.

The nested-table forest is flat: ``tables(page_id, node_id, parent_table_id,
level, xpath, title, content)``. A table's parent is its nearest table
ancestor, read off ``anc_ids`` aligned with the tags of ``tag_path`` - no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import py_strip
from pagesift.operators.clean import serialize
from pagesift.operators.dom import string_value, under_targets
from pagesift.operators.textsearch import text_matches


def _table_ancestry(nodes: DataFrame, tag: str = "table") -> DataFrame:
    """tables (or other containers ``tag``) with parent_table_id (-1 for outermost) and level (1 = outermost)."""
    tags = F.split(F.substring(F.col("tag_path"), F.lit(2), F.length("tag_path")), "/")
    pairs = F.arrays_zip(F.slice(tags, 1, F.size(tags) - 1).alias("t"),
                         F.slice("anc_ids", 1, F.size("anc_ids") - 1).alias("a"))
    anc_tables = F.transform(F.filter(pairs, lambda p: p.t == tag), lambda p: p.a)
    return nodes.filter(F.col("tag") == tag).withColumn("_at", anc_tables).select(
        "*", F.coalesce(F.try_element_at(F.col("_at"), F.lit(-1)), F.lit(-1)).alias("parent_table_id"),
        (F.size("_at") + 1).alias("level")).drop("_at")


def _string_value(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, node_id) -> concatenated subtree text (bs4 get_text)."""
    return string_value(nodes, targets.select("page_id", "node_id"))


def table_titles(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """Caption text; else the node just before the table: text right
    before it (previous sibling's tail or the parent's own text), else the
    previous element's text; else null."""
    tb = tables.select("page_id", "node_id", "parent_id", "child_ord")
    cap = nodes.filter(F.col("tag") == "caption").select(
        "page_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("cap_id"),
        F.col("end_id").alias("cap_end"), "child_ord")
    w = Window.partitionBy("page_id", "node_id").orderBy("child_ord")
    cap = cap.join(tb.select("page_id", "node_id"), ["page_id", "node_id"], "left_semi").withColumn(
        "_r", F.row_number().over(w)).filter("_r = 1")
    cap_text = _string_value(nodes, cap.select("page_id", F.col("cap_id").alias("node_id"),
                                                F.col("cap_end").alias("end_id"))).select(
        "page_id", F.col("node_id").alias("cap_id"), F.col("sv").alias("caption"))
    cap = cap.join(cap_text, ["page_id", "cap_id"]).select("page_id", "node_id", "caption")
    prev = nodes.select("page_id", F.col("parent_id").alias("p_parent"),
                        (F.col("child_ord") + 1).alias("p_next"), F.col("node_id").alias("prev_id"),
                        F.col("end_id").alias("prev_end"), F.col("tail").alias("prev_tail"))
    par = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("text").alias("parent_text"))
    t = tb.join(prev, (tb["page_id"] == prev["page_id"]) & (tb["parent_id"] == prev["p_parent"])
                & (tb["child_ord"] == prev["p_next"]), "left").drop(prev["page_id"])
    t = t.join(par, ["page_id", "parent_id"], "left")
    pv = _string_value(nodes, t.filter(F.col("prev_id").isNotNull()).select(
        "page_id", F.col("prev_id").alias("node_id"), F.col("prev_end").alias("end_id"))).select(
        "page_id", F.col("node_id").alias("prev_id"), F.col("sv").alias("prev_text"))
    t = t.join(pv, ["page_id", "prev_id"], "left")
    before = F.when(F.col("prev_id").isNotNull(), F.col("prev_tail")).otherwise(F.col("parent_text"))
    title = (F.when(before.isNotNull(), py_strip(before))
             .when(F.col("prev_id").isNotNull(), py_strip(F.coalesce("prev_text", F.lit("")))))
    t = t.select("page_id", "node_id", title.alias("sibling_title")).join(cap, ["page_id", "node_id"], "left")
    return t.select("page_id", "node_id", F.coalesce(py_strip(F.col("caption")),
                                                     F.col("sibling_title")).alias("title"))


def table_content(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """Serialized HTML of each table's subtree (interval join + T8)."""
    sub = under_targets(nodes, tables.select("page_id", "node_id")).withColumnRenamed(
        "target_id", "tid")
    # serialize per (page, table): the table key rides in page_id's place
    keyed = sub.withColumn("page_id", F.struct(F.col("page_id").alias("p"), F.col("tid").alias("t")))
    s = serialize(keyed.withColumn("tail", F.when(F.col("node_id") == F.col("tid"), F.lit(None))
                                   .otherwise(F.col("tail"))))
    return s.select(F.col("page_id.p").alias("page_id"), F.col("page_id.t").alias("node_id"),
                    F.col("html").alias("content"))


def table_forest(nodes: DataFrame, with_content: bool = True, tag: str = "table") -> DataFrame:
    """T24 + T25 + T26 (+ content): one row per table with its forest links;
    another container, such as ``ul``, can stand for the table."""
    t = _table_ancestry(nodes, tag)
    out = t.select("page_id", "node_id", "end_id", "parent_table_id", "level", "xpath").join(
        table_titles(nodes, t), ["page_id", "node_id"], "left")
    if with_content:
        out = out.join(table_content(nodes, t), ["page_id", "node_id"], "left")
    return out


def outermost_tables(forest: DataFrame) -> DataFrame:
    """T24."""
    return forest.filter(F.col("level") == 1)


def table_measures(forest: DataFrame) -> DataFrame:
    """A9 per page: depth, width (leaf tables), max_width (always 1 for a
    non-empty forest, kept for compatibility), count (= width), plus the
    real maximum number of child tables."""
    kids = forest.groupBy("page_id", F.col("parent_table_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n_children"))
    f = forest.join(kids, ["page_id", "node_id"], "left").fillna(0, ["n_children"])
    return f.groupBy("page_id").agg(
        F.max("level").alias("depth"), F.count_if(F.col("n_children") == 0).alias("width"),
        F.lit(1).alias("max_width"), F.count_if(F.col("n_children") == 0).alias("count"),
        F.max("n_children").alias("max_children"), F.count(F.lit(1)).alias("n_tables"))


def triage_tables(nodes: DataFrame, forest: DataFrame, ann: DataFrame) -> DataFrame:
    """A table with no text, or none of the page's annotated values,
    becomes a ``prune`` operation; otherwise ``extract``."""
    sv = _string_value(nodes, forest.select("page_id", "node_id", "end_id"))
    vals = ann.select("page_id", F.explode("values").alias("t_norm")).filter(F.col("t_norm") != "").distinct()
    f = forest.select("page_id", "node_id", "xpath").join(sv, ["page_id", "node_id"], "left")
    hit = text_matches(f.select("page_id", "node_id", F.col("sv").alias("norm")), vals, ["page_id"]).distinct()
    hit = hit.withColumn("has_value", F.lit(True))
    f = f.join(hit, ["page_id", "node_id"], "left")
    op = F.when(py_strip(F.coalesce("sv", F.lit(""))) == "", "prune").when(
        F.col("has_value").isNull(), "prune").otherwise("extract")
    return f.select("page_id", "node_id", "xpath", op.alias("operator_type"))


def table_correlation(measures: DataFrame, rates: DataFrame, group_cols: list[str],
                      cols=("depth", "width", "max_width", "count")) -> DataFrame:
    """Per group, correlation of each table measure with the match rate
    (zero variance -> 0)."""
    from pagesift.operators.stats import corr_by_group
    d = measures.join(rates, "page_id")
    out = None
    for c in cols:
        r = corr_by_group(d, group_cols, c, "match_rate").withColumnRenamed(
            f"corr_{c}_match_rate", "corr").withColumn("measure", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return out

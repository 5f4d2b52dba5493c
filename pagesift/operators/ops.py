"""Fragment operations, scoring helpers and small table jobs
(X13-X15, X18, X20, X21, U8, W13-W15, F19, F22, A14, A18, O7, E12, T2, T3, Z10, Z11).

Operations are rows ``ops(page_id, seq, xpath, operator_type, data)`` with
``data MAP<field, STRUCT<value ARRAY<STRING>, cue_text STRING>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import TEXT_VISUAL_PRIORITY, html_unescape, non_empty, normalize_text, py_strip
from pagesift.operators.dom import chunks, under_targets, within
from pagesift.operators.relational import proper_ancestor_paths
from pagesift.operators.textsearch import one_line, text_matches


# ---- traversal orders (T2, T3) ----------------------------------------------
def pre_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("page_id", "node_id")


def post_order(nodes: DataFrame) -> DataFrame:
    """Children before parents: by subtree end, deeper first on ties."""
    return nodes.orderBy("page_id", "end_id", F.desc("node_id"))


def breadth_first(nodes: DataFrame, stop: Column | None = None) -> DataFrame:
    """Level order; with ``stop`` the walk does not descend below a matching
    node (cut-off = anti-join on "has a matching proper ancestor")."""
    n = nodes
    if stop is not None:
        n = within(nodes, nodes.filter(stop).select("page_id", "node_id"), keep_inside=False, strict=True)
    return n.orderBy("page_id", "depth", "node_id")


# ---- X13: per-field operator lists ------------------------------------------
def field_operators(ops: DataFrame) -> DataFrame:
    """For each field with values in any operation of a page: every operation
    becomes ``extract`` (it holds the field) or ``prune``; trailing prunes
    after the last extract are dropped."""
    fields = ops.select("page_id", F.explode("data").alias("field", "d")).filter(
        F.size(F.coalesce("d.value", F.array())) > 0).select("page_id", "field").distinct()
    j = ops.join(fields, "page_id")
    has = F.size(F.coalesce(F.col("data")[F.col("field")]["value"], F.array())) > 0
    j = j.withColumn("operator_type", F.when(has, "extract").otherwise("prune")).withColumn(
        "values", F.when(has, F.col("data")[F.col("field")]["value"]))
    w = Window.partitionBy("page_id", "field")
    j = j.withColumn("_last", F.max(F.when(has, F.col("seq"))).over(w))
    return j.filter(F.col("seq") <= F.col("_last")).select(
        "page_id", "field", "seq", "xpath", "operator_type", "values")


def extract_chunks(nodes: DataFrame, fops: DataFrame) -> DataFrame:
    """The text chunks that each extract operation of a (page, field) sees: those under
    its fragment and under no earlier one, which are gone when it looks. Columns:
    page_id, field, seq, owner, chunk_seq, text."""
    roots = nodes.select("page_id", "xpath", "node_id").join(
        fops.select("page_id", "field", "seq", "xpath", "operator_type"), ["page_id", "xpath"])
    ck = chunks(nodes.join(roots.select("page_id").distinct(), "page_id", "left_semi"))
    under = under_targets(ck, roots.select("page_id", "node_id")).join(
        roots.select("page_id", "field", "seq", "operator_type", F.col("node_id").alias("target_id")), ["page_id", "target_id"])
    own = under.groupBy("page_id", "field", "owner", F.col("chunk.seq").alias("chunk_seq")).agg(
        F.min(F.struct("seq", "operator_type")).alias("op"), F.first("chunk.text").alias("text"))
    return own.filter(F.col("op.operator_type") == "extract").select(
        "page_id", "field", F.col("op.seq").alias("seq"), "owner", "chunk_seq", "text")


# ---- X20: predictions of a field's operations ----------------------------------
def field_predictions(nodes: DataFrame, ranked: DataFrame) -> DataFrame:
    """The values of each (page, field)'s extract operation, widened to their full
    texts (W14) in what the field's operations leave of the page, in the operation's
    order. A value that no text there holds stays as it is. Columns: page_id, field,
    values."""
    g = ["page_id", "field"]
    want = ranked.filter(F.col("operator_type") == "extract").select(*g, F.posexplode("values").alias("pos", "target"))
    ck = extract_chunks(nodes, ranked).select(*g, "chunk_seq", "text", one_space(F.col("text")).alias("norm")).filter(F.length("text") > 0)
    j = text_matches(ck, want.select(*g, "target", F.col("target").alias("t_norm")).distinct(), g)
    j = j.withColumn("score", F.length("target") / F.length("text"))
    w = Window.partitionBy(*g, "target").orderBy(F.desc("score"), "chunk_seq")
    best = j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*g, "target", "text")
    return want.join(best, [*g, "target"], "left").groupBy(*g).agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "pos", F.coalesce("text", "target").alias("v")))), lambda x: x.v).alias("values"))


# ---- X14 / W13 / F22: rank competing extract operations ----------------------
def rank_extracts(nodes: DataFrame, fops: DataFrame) -> DataFrame:
    """Score each extract operation of a (page, field): 0.5 * tag visual
    priority + 0.5 * text tightness of the nearest chunks (X4) for its values,
    searched under its fragment with all earlier fragments removed; keep the
    first best (W13) and the prunes before it."""
    ex = fops.filter(F.col("operator_type") == "extract")
    owners = nodes.select("page_id", F.col("node_id").alias("owner"), F.col("tag").alias("otag"))
    own = extract_chunks(nodes, fops).select(
        "page_id", "field", "seq", "owner", F.length("text").alias("n_chars"),
        one_line(normalize_text(F.col("text"))).alias("norm")).filter(F.col("norm") != "")
    vals = ex.select("page_id", "field", "seq", F.explode("values").alias("target")).distinct().withColumn(
        "t_norm", one_line(normalize_text(F.col("target")))).filter(F.col("t_norm") != "")
    m = text_matches(own, vals, ["page_id", "field", "seq"], both_ways=True).join(owners, ["page_id", "owner"])
    m = m.withColumn("gap", F.col("n_chars") - F.length("target"))
    wv = Window.partitionBy("page_id", "field", "seq", "target")
    m = m.withColumn("_g", F.min(F.abs("gap")).over(wv)).filter(F.abs("gap") == F.col("_g"))
    prio = F.array(*[F.lit(t) for t in TEXT_VISUAL_PRIORITY])
    pos = F.array_position(prio, F.col("otag"))
    p = F.when(pos > 0, pos - 1).otherwise(F.lit(1))
    n = len(TEXT_VISUAL_PRIORITY)
    m = m.withColumn("el", (F.lit(n) - p) / F.lit(n)).withColumn(
        "tx", F.lit(1.0) - F.col("gap") / F.col("n_chars"))
    sc = m.groupBy("page_id", "field", "seq").agg(
        (F.sum("el") / (F.count(F.lit(1)) + F.lit(1e-8))).alias("el"),
        (F.sum("tx") / (F.count(F.lit(1)) + F.lit(1e-8))).alias("tx"))
    scored = ex.select("page_id", "field", "seq").join(sc, ["page_id", "field", "seq"], "left").select(
        "page_id", "field", "seq", F.coalesce(F.col("el") * 0.5 + F.col("tx") * 0.5, F.lit(0.0)).alias("score"))
    wb = Window.partitionBy("page_id", "field").orderBy(F.desc("score"), "seq")
    best = scored.withColumn("_r", F.row_number().over(wb)).filter("_r = 1").select(
        "page_id", "field", F.col("seq").alias("best_seq"))
    out = fops.join(best, ["page_id", "field"]).filter(F.col("seq") <= F.col("best_seq"))
    return out.withColumn("operator_type", F.when(F.col("seq") == F.col("best_seq"), "extract")
                          .otherwise("prune")).drop("best_seq")


# ---- X15: classify fragments -------------------------------------------------
def classify_fragments(ops: DataFrame) -> DataFrame:
    """Non-empty data -> extract, else prune; prunes that are ancestors of an
    extract are dropped (boundary-aware prefix semi-join)."""
    o = ops.withColumn("operator_type", F.when(F.size(F.map_filter(
        F.coalesce("data", F.create_map().cast("map<string,struct<value:array<string>,cue_text:string>>")),
        lambda k, v: F.size(F.coalesce(v.value, F.array())) > 0)) > 0, "extract").otherwise("prune"))
    anc = o.filter(F.col("operator_type") == "extract").select(
        "page_id", F.explode(proper_ancestor_paths(F.col("xpath"))).alias("xpath")).distinct()
    prunes = o.filter(F.col("operator_type") == "prune").join(anc, ["page_id", "xpath"], "left_anti")
    return o.filter(F.col("operator_type") == "extract").unionByName(prunes)


def one_space(c: Column) -> Column:
    """Unescaped twice, stripped, runs of spaces as one (the text W14 searches)."""
    return F.regexp_replace(py_strip(html_unescape(html_unescape(c))), "  +", " ")


# ---- W14 / X20: widen a value to its containing text ---------------------------
def full_texts(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (page_id, target): the text chunk containing it with the best
    ``1 - extra/len`` (first in document order on ties); the target itself
    when none contains it."""
    pages = targets.select("page_id").distinct()
    ck = chunks(nodes.join(pages, "page_id", "left_semi")).select("page_id", "chunk.seq", "chunk.text")
    ck = ck.withColumn("norm", one_space(F.col("text"))).filter(F.length("text") > 0)
    j = text_matches(ck, targets.select("page_id", "target", F.col("target").alias("t_norm")).distinct(), ["page_id"])
    j = j.withColumn("score", F.lit(1.0) - (F.length("text") - F.length("target")) / F.length("text"))
    w = Window.partitionBy("page_id", "target").orderBy(F.desc("score"), "seq")
    best = j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("page_id", "target", "text")
    return targets.join(best, ["page_id", "target"], "left").select(
        "page_id", "target", F.coalesce("text", "target").alias("full_text"))


# ---- W15: deepest text node containing a target ------------------------------
def deepest_text_node(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, target) -> owner node of the deepest body text containing
    the (double-unescaped, whitespace-collapsed) target; last in document
    order on ties."""
    body = nodes.filter(F.col("tag_path").startswith("/html/body"))
    ck = chunks(body.join(targets.select("page_id").distinct(), "page_id", "left_semi"))
    clean = lambda c: py_strip(F.regexp_replace(html_unescape(html_unescape(c)), r"\s+", " "))
    ck = non_empty(ck.select("page_id", "owner", F.col("chunk.seq").alias("seq"), F.size("anc_ids").alias("depth"), "chunk"),
                   ["page_id", "owner", "seq", "depth"], clean(F.col("chunk.text")), "norm")
    t = targets.withColumn("t_norm", F.regexp_replace(html_unescape(html_unescape(F.col("target"))), r"\s+", " "))
    j = text_matches(ck, t.select("page_id", "target", "t_norm").distinct(), ["page_id"])
    w = Window.partitionBy("page_id", "target").orderBy(F.desc("depth"), F.desc("seq"))
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "page_id", "target", F.col("owner").alias("node_id"))


# ---- F19 / X21 / Z2: do values survive a transformation ----------------------
def values_kept(html_pages: DataFrame, ann: DataFrame) -> DataFrame:
    """Per page: all annotated values (or their unescaped form) still in the
    HTML, plus matched / total counts."""
    v = ann.select("page_id", F.explode(F.array_distinct(F.transform("values", py_strip))).alias("v")).withColumn("uv", html_unescape(F.col("v")))
    j = v.join(html_pages, "page_id").withColumn(
        "hit", F.contains("html", "v") | F.contains("html", "uv"))
    return j.groupBy("page_id").agg(F.bool_and("hit").alias("kept_all"),
                                    F.count_if("hit").alias("match_count"), F.count(F.lit(1)).alias("total"))


# ---- X18: batch-inference prompt rows ----------------------------------------
def prompt_rows(snippets: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, field): the snippets (html, target values, target and cue
    paths) as one ordered text block for a batch-inference table."""
    item = F.concat(F.lit("## Snippet "), F.col("page_id").cast("string"), F.lit("\n"), F.col("html"),
                    F.lit("\nTargets: "), F.to_json("values"),
                    F.lit("\nTarget paths: "), F.to_json("target_xpaths"),
                    F.lit("\nCue paths: "), F.to_json("cue_xpaths"))
    g = snippets.groupBy(*keys, "field").agg(F.sort_array(F.collect_list(F.struct("page_id", item.alias("s")))).alias("xs"))
    return g.select(*keys, "field", F.array_join(F.transform("xs", lambda x: x.s), "\n\n").alias("prompt"))


# ---- U8 / X16: union of alternative programs ---------------------------------
def union_programs(programs: DataFrame, keys: list[str], lang_col: str | None = None) -> DataFrame:
    """One program per (keys, field) from its alternatives: ``a | b`` (css: ``a, b``)."""
    sep = F.when(F.col(lang_col) == "css", F.lit(", ")).otherwise(F.lit(" | ")) if lang_col else F.lit(" | ")
    g = programs.groupBy(*keys, "field", *([lang_col] if lang_col else [])).agg(
        F.array_sort(F.collect_set("program")).alias("alts"))
    return g.withColumn("program", F.array_join("alts", " | ")).withColumn(
        "program", F.when(sep == ", ", F.array_join("alts", ", ")).otherwise(F.col("program")))


def limit_tries(tried: DataFrame, max_rounds: int = 3) -> DataFrame:
    """At most the first try plus ``max_rounds`` refinements."""
    return tried.filter(F.col("try_seq") <= max_rounds + 1)


# ---- A14: label counts per ground-truth file ----------------------------------
def label_counts(gt_rows: DataFrame) -> DataFrame:
    """(file_name, col1) -> max/min of the numeric count column, max desc."""
    x = F.expr("try_cast(col1 as double)")
    return gt_rows.groupBy("file_name").agg(F.max(x).alias("max_col1"), F.min(x).alias("min_col1")).orderBy(
        F.desc("max_col1"), "file_name")


# ---- A18: tokens removed vs remaining per composition -------------------------
def tokens_before_after(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragment tokens, is_rest) -> tokens before (all) and after (rest)."""
    return sizes.groupBy(*keys).agg(F.sum("html_tokens").alias("tokens_before"),
                                    F.sum(F.when(F.col("is_rest"), F.col("html_tokens"))).alias("tokens_after"))


# ---- Z11: representative page and its context ---------------------------------
def representative_pages(stats_rows: DataFrame, group_cols: list[str], size_col: str) -> DataFrame:
    """O2: the largest page per group (ties by page id)."""
    from pagesift.operators.sampling import top_n_per_group
    return top_n_per_group(stats_rows, group_cols, -F.col(size_col), 1, tie="page_id")

"""Pruning and condensing pages around paths.

A node is inside a removed subtree iff the root is among its ``anc_ids``, so
every removal is an equi-join on ``page_id`` with the page's root set plus an
``arrays_overlap`` - linear in nodes x depth, no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.operators.dom import within
from pagesift.operators.relational import prefix_dedup
from pagesift.operators.clean import _tag_tokens, sanitize, serialize
from pagesift.functions.text import token_count


def _inside(nodes: DataFrame, roots: DataFrame, how: str, strict: bool = False) -> DataFrame:
    """Semi (inside) / anti (outside) selection of subtrees via ancestor sets."""
    return within(nodes, roots.select("page_id", "node_id"), how == "left_semi", strict)


def paths_to_nodes(nodes: DataFrame, paths: DataFrame, path_col: str = "xpath") -> DataFrame:
    """Resolve positional paths (``nodes.xpath`` form) to node rows: equi-join."""
    return nodes.join(paths.select("page_id", F.col(path_col).alias("xpath")).distinct(),
                      ["page_id", "xpath"], "left_semi")


def prune_paths(nodes: DataFrame, paths: DataFrame, path_col: str = "xpath",
                leave_stub: bool = False) -> DataFrame:
    """Clear the subtrees at the given paths (prefix-deduplicated first,
    J11). ``leave_stub`` keeps the root with text "..." (the table variant)."""
    p = prefix_dedup(paths.select("page_id", F.col(path_col).alias("path")), ["page_id"], "path")
    roots = paths_to_nodes(nodes, p, "path")
    if not leave_stub:
        return _inside(nodes, roots, "left_anti")
    kept = _inside(nodes, roots, "left_anti", strict=True)
    stub = roots.select("page_id", "node_id").withColumn("_stub", F.lit(True))
    k = kept.join(stub, ["page_id", "node_id"], "left")
    return k.withColumn("text", F.when(F.col("_stub"), F.lit("...")).otherwise(F.col("text"))).withColumn(
        "text_slots", F.when(F.col("_stub"), F.array(F.struct(
            F.lit(1).alias("idx"), F.lit("...").alias("text"), F.col("start_seq").alias("seq"),
            F.lit(True).alias("brk"), F.lit(True).alias("vis")))).otherwise(F.col("text_slots"))).drop("_stub")


def classify_condense(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """``role`` of every node relative to the include nodes:
    spine (ancestor-or-self of an include), inside (below an include),
    stub (child of a spine node, neither of the above), dropped (the rest)."""
    inc = nodes.join(includes.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    spine = inc.select("page_id", F.explode("anc_ids").alias("node_id")).distinct().withColumn(
        "_spine", F.lit(True))
    inside = _inside(nodes.select("page_id", "node_id", "anc_ids"), inc, "left_semi",
                     strict=True).select("page_id", "node_id").withColumn("_inside", F.lit(True))
    sp_parent = spine.select("page_id", F.col("node_id").alias("parent_id"),
                             F.col("_spine").alias("_parent_spine"))
    n = (nodes.join(spine, ["page_id", "node_id"], "left")
         .join(inside, ["page_id", "node_id"], "left")
         .join(sp_parent, ["page_id", "parent_id"], "left"))
    role = (F.when(F.col("_spine"), "spine").when(F.col("_inside"), "inside")
            .when(F.col("_parent_spine"), "stub").otherwise("dropped"))
    return n.withColumn("role", role).drop("_spine", "_inside", "_parent_spine")


def condense(nodes: DataFrame, includes: DataFrame) -> DataFrame:
    """T20 (Algorithm 2): keep include nodes, their ancestors and contents;
    siblings of the kept spine become "..." stubs (children removed, text and
    tail replaced by "..." when present); everything else goes."""
    return _dotted(classify_condense(nodes, includes).filter(F.col("role") != "dropped"))


def _dotted(c: DataFrame) -> DataFrame:
    """Stubs (by ``role``) with "..." for text and tail and nothing inside."""
    stub = F.col("role") == "stub"
    dots = lambda col: F.when(stub & F.col(col).isNotNull(), F.lit("...")).otherwise(F.col(col))
    return c.withColumn("text", dots("text")).withColumn("tail", dots("tail")).withColumn(
        "text_slots", F.when(stub, F.filter("text_slots", lambda s: s.idx < 0)).otherwise(
            F.col("text_slots")))


def delete_matches(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """Remove the subtrees of matched nodes (e.g. nodes selected by trim
    rules applied with ``apply_programs``)."""
    return _inside(nodes, nodes.join(matched.select("page_id", "node_id").distinct(),
                                     ["page_id", "node_id"], "left_semi"), "left_anti")


def remove_children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Drop everything strictly below the given nodes."""
    p = nodes.join(parents.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    return _inside(nodes, p, "left_anti", strict=True)


def replace_with_text(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target loses its children and gets their joined text (F7);
    ``tr`` targets do this per ``td`` child, ``ul``/``ol`` per ``li``, tables
    stay untouched, a childless target is only stripped."""
    from pagesift.operators.dom import text_content
    t = nodes.join(targets.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    t = t.filter(F.col("tag") != "table")
    per_child = nodes.alias("c").join(
        t.filter(F.col("tag").isin("tr", "ul", "ol")).select(
            "page_id", F.col("node_id").alias("p_id"), F.col("tag").alias("p_tag")).alias("p"),
        (F.col("c.page_id") == F.col("p.page_id")) & (F.col("c.parent_id") == F.col("p.p_id"))
        & (((F.col("p.p_tag") == "tr") & (F.col("c.tag") == "td"))
           | ((F.col("p.p_tag") != "tr") & (F.col("c.tag") == "li")))).select("c.*")
    flat = t.filter(~F.col("tag").isin("tr", "ul", "ol")).unionByName(per_child)
    tc = text_content(nodes, flat.select("page_id", "node_id", "end_id"), [])
    kept = remove_children(nodes, flat)
    return kept.join(tc, ["page_id", "node_id"], "left").withColumn(
        "text", F.coalesce(F.col("text_content"), F.col("text"))).withColumn(
        "text_slots", F.when(F.col("text_content").isNotNull(), F.array(F.struct(
            F.lit(1).alias("idx"), F.col("text_content").alias("text"), F.col("start_seq").alias("seq"),
            F.lit(True).alias("brk"), F.lit(True).alias("vis")))).otherwise(F.col("text_slots"))).drop(
        "text_content")


def subtree_tokens(nodes: DataFrame, tok=token_count) -> DataFrame:
    """Serialized size of every subtree (tags + text + tails of all nodes in
    it, the root's tail included) and the root alone without children."""
    own = nodes.select("page_id", "node_id", "anc_ids", (
        _tag_tokens(F.col("tag"), F.col("attrs"), tok) + tok(F.coalesce("text", F.lit("")))
        + tok(F.coalesce("tail", F.lit("")))).alias("own"))
    ex = own.select("page_id", F.explode("anc_ids").alias("node_id"), "own")
    tot = ex.groupBy("page_id", "node_id").agg(F.sum("own").alias("sub_tokens"))
    return own.drop("anc_ids").join(tot, ["page_id", "node_id"])


def budget_keep(child_ord, cum_before, req):
    """W9 rule: keep a child while the tokens of the children before it fit
    the budget; the first child that overflows is kept too (so the first
    child always stays)."""
    return (child_ord == 1) | (cum_before <= req)


def prune_by_budget(nodes: DataFrame, max_tokens: int, tok=token_count) -> DataFrame:
    """Keep the left part of the page within ``max_tokens``.

    From the root down, a node over its budget keeps its children while the
    running total before each child fits what is left after its own tokens (the
    first overflowing child is kept too), and the walk goes on in that child.
    Budgets add up along the walk: what is left at a node is ``max_tokens`` less
    the tokens of all nodes before it in document order. So one running total per
    page decides all levels at once: a node goes if it is not its parent's first
    child and more than ``max_tokens`` come before it, or if an ancestor goes."""
    own = (_tag_tokens(F.col("tag"), F.col("attrs"), tok) + tok(F.coalesce("text", F.lit("")))
           + tok(F.coalesce("tail", F.lit(""))))
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    st = nodes.select("page_id", "node_id", "parent_id", "child_ord", own.alias("own")).withColumn(
        "cum_before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    gone = st.filter((F.col("parent_id") >= 0) & ~budget_keep(F.col("child_ord"), F.col("cum_before"), F.lit(max_tokens)))
    return _inside(nodes, gone, "left_anti")


# ---- X8 / X19: condensed snippets ------------------------------------------------
def virtual_tree(nodes: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The members of each (page, keys) group and the lowest common ancestors of
    neighbours in document order, which are all the branching points of the paths
    between members. Columns: page_id, keys, node_id, parent (the nearest ancestor
    in the tree, null for its root), is_member."""
    g = ["page_id", *keys]
    m = members.select(*g, "node_id").distinct().join(nodes.select("page_id", "node_id", "anc_ids"), ["page_id", "node_id"])
    prev = F.lag("anc_ids").over(Window.partitionBy(*g).orderBy("node_id"))
    both = m.withColumn("_prev", prev)
    # ancestors shared with the member before: a common prefix of the two lists
    lca = F.array_max(F.array_intersect("anc_ids", "_prev"))
    rows = both.select(*g, F.explode(F.array_compact(F.array(
        F.struct(F.col("node_id"), F.lit(True).alias("is_member")),
        F.when(F.col("_prev").isNotNull(), F.struct(lca.alias("node_id"), F.lit(False).alias("is_member")))))).alias("v"))
    tree = rows.select(*g, "v.*").groupBy(*g, "node_id").agg(F.max("is_member").alias("is_member"))
    ids = tree.groupBy(*g).agg(F.collect_set("node_id").alias("_ids"))
    out = tree.join(nodes.select("page_id", "node_id", "anc_ids"), ["page_id", "node_id"]).join(ids, g)
    above = F.array_max(F.array_intersect(F.slice("anc_ids", 1, F.size("anc_ids") - 1), "_ids"))
    return out.select(*g, "node_id", above.alias("parent"), "is_member")


def snippet_nodes(nodes: DataFrame, includes: DataFrame, keys: list[str]) -> DataFrame:
    """T20 per (page, keys) group of include nodes: the kept nodes with ``role``
    (spine, inside, stub); a node comes once for each group that keeps it.

    The spine are the ancestors of the group's virtual tree: between its root and
    its members this is the union of the members' pairwise paths."""
    g = ["page_id", *keys]
    inc = includes.select(*g, "node_id").distinct().join(nodes.select("page_id", "node_id", "anc_ids"), ["page_id", "node_id"])
    sets = inc.groupBy(*g).agg(F.collect_set("node_id").alias("_inc"),
                               F.array_distinct(F.flatten(F.collect_list("anc_ids"))).alias("_spine"))
    n = nodes.join(sets, "page_id")
    strict = F.slice("anc_ids", 1, F.size("anc_ids") - 1)
    role = (F.when(F.array_contains("_spine", F.col("node_id")), "spine").when(F.arrays_overlap(strict, F.col("_inc")), "inside")
            .when(F.array_contains("_spine", F.col("parent_id")), "stub"))
    return n.withColumn("role", role).filter("role IS NOT NULL").drop("_inc", "_spine")


def condensed_snippets(nodes: DataFrame, targets: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """One condensed snippet per (page, field) with targets: their nodes and the
    cue's (X19: none, without cues), with ancestors and contents; siblings of the
    spine as "..." stubs; light-sanitized. ``targets`` and ``cues``: (page_id, field,
    node_id). Columns: page_id, field, n_targets, n_cues, n_nodes, html."""
    g = ["page_id", "field"]
    t = targets.select(*g, "node_id").distinct()
    c = t.limit(0) if cues is None else cues.select(*g, "node_id").distinct().join(t.select(*g).distinct(), g, "left_semi")
    kept = _dotted(snippet_nodes(nodes, t.unionByName(c), ["field"]))
    # a group takes the page's place: sanitizing and serializing are keyed by it
    keyed = kept.withColumn("page_id", F.struct("page_id", "field")).drop("field", "role")
    html = serialize(sanitize(keyed, "light").checkpoint(eager=True)).select("page_id.*", "html")
    n = kept.groupBy(*g).agg(F.count("*").alias("n_nodes"))
    count = lambda df, name: df.groupBy(*g).agg(F.count("*").alias(name))
    return (html.join(n, g).join(count(t, "n_targets"), g).join(count(c, "n_cues"), g, "left").fillna(0, ["n_cues"])
            .select(*g, "n_targets", "n_cues", "n_nodes", "html"))

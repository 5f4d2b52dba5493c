"""Sanitizing and serializing pages as node-table operations.

Sanitizing removes elements in a post-order walk: comments, interactive
and invisible elements always; in deep mode also images and elements that
have no text, no tail and no remaining children. That fixpoint has a closed
relational form used here:

    a node survives  <=>  its tag is not removed, no ancestor's tag is removed,
                          and some text chunk (own text or tail) below it
                          reaches it along a path of non-removed tags.

So one explode of each text-bearing node's ancestor list plus a ``distinct``
replaces the recursive walk. ``display:none`` elements stay but lose their
content (their descendants go).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.htmltree import COMMENT
from pagesift.functions.text import py_strip, token_count

# ---- fixed values: removal tag sets ---------------------------------------
INTERACTIVE_ELEMENTS = [
    "script", "style", "noscript", "svg", "iframe", "video", "audio", "source", "track", "link",
    "meta", "object", "param", "input", "label", "select", "textarea", "button", "fieldset",
    "legend", "datalist", "output", "option", "optgroup", "col", "colgroup", "map", "area",
    "base", "embed",
]
INVISIBLE_ELEMENTS = ["head", "title"]
# --------------------------------------------------------------------------

MODES = {
    # removal tags, keep-emptiness rule, attribute allow-list (None = drop all)
    "deep": dict(extra=["img"], empty=True, attrs=None),
    "light": dict(extra=[], empty=False, attrs=["class", "id"]),
    "paper": dict(extra=[], empty=True, attrs=None),
    "soup": dict(extra=[], empty=True, attrs=["class", "id", "title", "alt", "href", "src"]),
}


def _removed_tags(mode: str) -> list[str]:
    return INTERACTIVE_ELEMENTS + INVISIBLE_ELEMENTS + MODES[mode]["extra"] + ["comment()"]


def _tags_of_path(tag_path: Column) -> Column:
    return F.split(F.substring(tag_path, F.lit(2), F.length(tag_path)), "/")


def classify(nodes: DataFrame, mode: str = "deep") -> DataFrame:
    """T4-T7 classification: adds ``reason`` in (comment, interactive,
    invisible, img, empty, inside_removed, hidden_content, kept)."""
    rm = _removed_tags(mode)
    tags = _tags_of_path(F.col("tag_path"))
    # 0-based index of the deepest removed tag among ancestors-or-self (-1: none)
    deepest = lambda arr: F.coalesce(F.array_max(F.transform(
        arr, lambda t, i: F.when(t.isin(*rm), i).otherwise(F.lit(-1)))), F.lit(-1))
    low = deepest(tags)
    low_anc = deepest(F.slice(tags, 1, F.size(tags) - 1))
    n = nodes.withColumn("_low", low).withColumn("_low_anc", low_anc)
    hidden = F.coalesce(F.col("attrs")["style"].rlike(r"display\s*:\s*none"), F.lit(False))
    n = n.withColumn("_hidden", hidden)
    if MODES[mode]["empty"]:
        own = F.coalesce(py_strip(F.col("text")), F.lit("")) != ""
        tail = F.coalesce(py_strip(F.col("tail")), F.lit("")) != ""
        src = n.filter((own & (F.col("tag") != COMMENT)) | tail).select(
            "page_id", "anc_ids", "_low", "_low_anc", own.alias("_own"), tail.alias("_tail"),
            (F.col("tag") != COMMENT).alias("_el"))
        # chain = ancestors-or-self (by depth index) strictly below the deepest
        # removed ancestor; own text reaches the node itself only if it is kept,
        # a tail reaches from the parent up when the node itself is removed
        size = F.size("anc_ids")
        self_rm = F.col("_low") == size - 1
        s0 = F.col("_low_anc") + 1
        chain = lambda end: F.slice("anc_ids", s0 + 1, F.greatest(end - s0 + 1, F.lit(0)))
        own_chain = F.when(F.col("_own") & F.col("_el") & ~self_rm, chain(size - 1))
        tail_chain = F.when(F.col("_tail"), chain(F.when(self_rm, size - 2).otherwise(size - 1)))
        empty = F.array().cast("array<int>")
        sup = src.select("page_id", F.explode(F.array_union(
            F.coalesce(own_chain, empty), F.coalesce(tail_chain, empty))).alias("node_id"))
        sup = sup.distinct().withColumn("_sup", F.lit(True))
        n = n.join(sup, ["page_id", "node_id"], "left").fillna(False, ["_sup"])
    else:
        n = n.withColumn("_sup", F.lit(True))
    tag = F.col("tag")
    reason = (F.when(tag == COMMENT, "comment")
              .when(tag.isin(*INTERACTIVE_ELEMENTS), "interactive")
              .when(tag.isin(*INVISIBLE_ELEMENTS), "invisible")
              .when(tag.isin(*MODES[mode]["extra"]), tag)
              .when(F.col("_low_anc") >= 0, "inside_removed")
              .when(~F.col("_sup"), "empty")
              .otherwise("kept"))
    return n.withColumn("reason", reason).drop("_low", "_low_anc", "_sup")


def hidden_below(nodes: DataFrame) -> DataFrame:
    """Nodes with a ``display:none`` proper ancestor (their content is cleared)."""
    from pagesift.operators.dom import within
    h = nodes.filter(F.coalesce(F.col("attrs")["style"].rlike(r"display\s*:\s*none"), F.lit(False)))
    return within(nodes.select("page_id", "node_id", "anc_ids"), h.select("page_id", "node_id"),
                  keep_inside=True, strict=True).select("page_id", "node_id")


def sanitize(nodes: DataFrame, mode: str = "deep") -> DataFrame:
    """T4 (deep), T5 (light), T6 (soup), T7 (paper): the kept nodes with
    filtered attributes; ``display:none`` elements keep no content."""
    c = classify(nodes, mode).filter(F.col("reason") == "kept")
    c = c.join(hidden_below(nodes), ["page_id", "node_id"], "left_anti")
    allow = MODES[mode]["attrs"]
    if allow is None:
        attrs = F.create_map().cast("map<string,string>")
    else:
        attrs = F.map_filter("attrs", lambda k, v: k.isin(*allow))
        if mode == "soup":
            attrs = F.map_filter(attrs, lambda k, v: ~((k == "href") & v.startswith("javascript:")))
            attrs = F.when(F.col("tag") == "img", F.map_filter(attrs, lambda k, v: k != "src")).otherwise(attrs)
    blank = F.col("_hidden")
    return c.withColumn("attrs", attrs).withColumn(
        "text", F.when(blank, F.lit(None)).otherwise(F.col("text"))).withColumn(
        "text_slots", F.when(blank, F.filter("text_slots", lambda s: s.idx < 0)).otherwise(
            F.col("text_slots"))).drop("_hidden")


def _tag_tokens(tag: Column, attrs: Column, tok) -> Column:
    open_tag = F.concat(F.lit("<"), tag, F.array_join(F.transform(
        F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e.key, F.lit('="'), e.value, F.lit('"'))), ""),
        F.lit(">"))
    close = F.concat(F.lit("</"), tag, F.lit(">"))
    return tok(open_tag) + tok(close)


def serialized_tokens(kept: DataFrame, tok=token_count) -> DataFrame:
    """Z1 cleaned size: tokens of the serialized kept tree, summed per page.

    Additive for a word/punctuation tokenizer, so no string is built: tag
    tokens + own text tokens + tail tokens of every kept node."""
    return kept.groupBy("page_id").agg(F.sum(
        _tag_tokens(F.col("tag"), F.col("attrs"), tok)
        + tok(F.coalesce(F.col("text"), F.lit(""))) + tok(F.coalesce(F.col("tail"), F.lit("")))
    ).alias("cleaned_tokens"))


def serialize(nodes: DataFrame) -> DataFrame:
    """One HTML string per page from (possibly filtered) nodes, in document
    order: open tag, text, children, close tag, tail. Void tags get no close."""
    from pagesift.functions.htmltree import VOID_TAGS
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                                        F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    is_c = F.col("tag") == COMMENT
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(
        F.lit(" "), e.key, F.lit('="'), F.replace(e.value, F.lit('"'), F.lit("&quot;")), F.lit('"'))), "")
    open_t = F.when(is_c, F.concat(F.lit("<!--"), F.coalesce("text", F.lit("")), F.lit("-->"))).otherwise(
        F.concat(F.lit("<"), F.col("tag"), attrs, F.lit(">"),
                 F.coalesce(esc(F.col("text")), F.lit(""))))
    close_t = F.when(is_c | F.col("tag").isin(*sorted(VOID_TAGS)), F.lit("")).otherwise(
        F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    pieces = nodes.select("page_id", F.explode(F.array(
        F.struct(F.col("node_id").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), open_t.alias("s")),
        F.struct(F.col("end_id").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).alias("c"),
                 F.concat(close_t, F.coalesce(esc(F.col("tail")), F.lit(""))).alias("s")))).alias("p"))
    return pieces.groupBy("page_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("p")), lambda x: x.s), "").alias("html"))

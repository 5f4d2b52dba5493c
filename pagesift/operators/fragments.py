"""Fragment splitting of pages by token weight.

The greedy split is sequential inside a page (each removal changes the
weights), so it runs as one function per page over that
page's sanitized node rows; scale comes from page parallelism. Token counts
per node are computed JVM-side first and only small integer columns travel
to Python, as a stream of pages.
"""

from __future__ import annotations

import math
from collections import namedtuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.htmltree import INLINE_TAGS
from pagesift.functions.text import py_strip, token_count
from pagesift.operators.clean import _tag_tokens
from pagesift.operators.dom import chunks, render_lines
from pagesift.operators.pagewise import map_groups

# ---- fixed values: container tags for the element weight (T15) ----------
CONTAINER_ELEMENTS = ["table", "ul", "ol", "section", "article"]
# --------------------------------------------------------------------------

FRAGMENT_SCHEMA = ("page_id {key}, seq int, xpath string, text_tokens long, html_tokens long, "
                   "weight double, is_rest boolean")
REMOVAL_SCHEMA = "page_id {key}, times int, removed_tokens array<long>"


def _key_type(df: DataFrame) -> str:
    return df.schema["page_id"].dataType.simpleString()


def token_rows(nodes: DataFrame, tok=token_count) -> DataFrame:
    """T14 inputs per element: own stripped text tokens and the tokens of the
    bare element string ``<tag k='v'></tag>``."""
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(
        e.key, F.lit("='"), e.value, F.lit("'"))), " ")
    el = F.concat(F.lit("<"), F.col("tag"), F.lit(" "), attrs, F.lit("></"), F.col("tag"), F.lit(">"))
    return nodes.filter(F.col("tag") != "#comment").select(
        "page_id", "node_id", "parent_id", "child_ord", "depth", "tag", "xpath",
        F.coalesce(F.length(F.col("attrs")["class"]) > 0, F.lit(False)).alias("has_class"),
        tok(py_strip(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("own_text"),
        tok(el).cast("long").alias("el_tokens"),
        # serialized size: the tag as it stands, its text, the text after it; and of the empty tag
        (_tag_tokens(F.col("tag"), F.col("attrs"), tok) + tok(F.coalesce("text", F.lit("")))).cast("long").alias("ser"),
        tok(F.coalesce("tail", F.lit(""))).cast("long").alias("tail_tokens"),
        _tag_tokens(F.col("tag"), F.create_map().cast("map<string,string>"), tok).cast("long").alias("bare")).withColumn(
        "tag_weight", tag_weight(F.col("tag"), F.col("has_class")))


_NODE = ("node_id", "parent_id", "child_ord", "depth", "xpath", "own_text", "el_tokens", "ser", "tail_tokens", "bare",
         "tag_weight")
_Node = namedtuple("_Node", _NODE)


class _Tree:
    """Token tree of one page (node ids -> children, subtree sums)."""

    def __init__(self, page: dict | pd.DataFrame):
        """``page``: the columns of :func:`token_rows` for one page."""
        rows = sorted(map(_Node, *[list(page[c]) for c in _NODE]), key=lambda r: (r.depth, r.child_ord))
        self.rows = {r.node_id: r for r in rows}
        self.kids = {}
        for r in rows:
            self.kids.setdefault(r.parent_id, []).append(r.node_id)
        self.root = self.kids.get(-1, [None])[0]
        self.text, self.html, self.ser, self.parent, self.log = {}, {}, {}, {}, []
        order = []
        stack = [self.root] if self.root is not None else []
        while stack:
            n = stack.pop()
            order.append(n)
            for c in self.kids.get(n, []):
                self.parent[c] = n
                stack.append(c)
        for n in reversed(order):
            r = self.rows[n]
            cs = self.kids.get(n, [])
            self.text[n] = r.own_text + sum(self.text[c] for c in cs)
            self.html[n] = r.own_text + r.el_tokens + sum(self.html[c] for c in cs)
            self.ser[n] = r.ser + r.tail_tokens + sum(self.ser[c] for c in cs)

    def remove(self, n):
        """Cut a subtree; every ancestor shrinks by its text and its html. In the
        serialized page its empty tag and the text after it stay; returns by how much
        that shrinks."""
        above = [self.parent.pop(n)]
        place = self.kids[above[0]].index(n)
        del self.kids[above[0]][place]
        while above[-1] in self.parent:
            above.append(self.parent[above[-1]])
        drop = self.ser[n] - self.rows[n].tail_tokens - self.rows[n].bare
        for size, less in ((self.text, self.text[n]), (self.html, self.html[n]), (self.ser, drop)):
            for a in above:
                size[a] -= less
        self.log.append((n, place, above, drop))
        return drop

    def restore(self):
        """Undo all removals, the last first."""
        while self.log:
            n, place, above, drop = self.log.pop()
            for size, more in ((self.text, self.text[n]), (self.html, self.html[n]), (self.ser, drop)):
                for a in above:
                    size[a] += more
            self.kids[above[0]].insert(place, n)
            self.parent[n] = above[0]

    def heavy_descent(self, small_enough):
        """Nodes on the way down along the child of most text (the earliest of
        equals), to the first with at most ``small_enough`` tokens."""
        n = self.root
        while kids := [c for c in self.kids.get(n, ()) if self.text[c] > 0]:
            n = max(kids, key=self.text.__getitem__)
            yield n
            if self.text[n] <= small_enough:
                return

    def depth_of(self, n):
        return self.rows[n].depth + 1   # the token tree counts the root as depth 1

    def stats(self):
        max_depth, max_width, stack = 1, 1, [self.root]
        while stack:
            n = stack.pop()
            cs = self.kids.get(n, [])
            max_depth = max(max_depth, self.depth_of(n))
            max_width = max(max_width, len(cs) or 1)
            stack.extend(cs)
        return max_depth, max_width


def tag_weight(tag: Column, has_class: Column) -> Column:
    """The element's own part of its weight (fixed values)."""
    plain, classed = F.lit(0.6), F.when(tag == "div", 0.8).otherwise(0.6)
    for tags, without, with_ in ((CONTAINER_ELEMENTS, 0.9, 1.0), (sorted(INLINE_TAGS), 0.4, 0.7)):
        plain = F.when(tag.isin(*tags), without).otherwise(plain)
        classed = F.when(tag.isin(*tags), with_).otherwise(classed)
    return F.when(has_class, classed).otherwise(plain)


def _heaviest(tr: "_Tree", max_depth, max_width, total, max_text_tokens):
    """The heaviest node; ties go to the earliest child's pick, then the
    node itself (iterative post-order, no recursion limit on deep pages)."""
    best = {}
    stack = [(tr.root, False)]
    while stack:
        n, done = stack.pop()
        kids = tr.kids.get(n, [])
        if not done:
            stack.append((n, True))
            stack.extend((c, False) for c in reversed(kids))
            continue
        r = tr.rows[n]
        w = 0.0  # outside the text bounds
        if max_text_tokens // 8 <= tr.text[n] <= max_text_tokens:
            w = (tr.depth_of(n) / max_depth + (math.tanh(tr.text[n] / total) if total else 0.0)
                 + len(kids) / max_width + r.tag_weight)
        top = None
        for c in kids:
            cand = best.pop(c)
            if top is None or cand[0] > top[0]:
                top = cand
        if top is None or w > top[0]:
            top = (w, n)
        best[n] = top
    return best[tr.root]


def _fragments(tr: "_Tree", until_html_tokens: int, max_text_tokens: int):
    """(path, text tokens, html tokens, weight, drop of the serialized size) of each
    fragment; the last row is the rest, with a null weight and the size left."""
    out = []
    if tr.root is None:
        return out
    while tr.html[tr.root] >= until_html_tokens and tr.text[tr.root] > 0:
        max_depth, max_width = tr.stats()
        total = tr.text[tr.root]

        w, n = _heaviest(tr, max_depth, max_width, total, max_text_tokens)
        if tr.depth_of(n) <= 1 or w == 0:
            break
        out.append((tr.rows[n].xpath, tr.text[n], tr.html[n], w, tr.remove(n)))
    out.append((tr.rows[tr.root].xpath, tr.text[tr.root], tr.html[tr.root], None, tr.ser[tr.root]))
    return out


def split_fragments(nodes: DataFrame, until_html_tokens: int = 16384,
                    max_text_tokens: int = 16384, tok=token_count) -> DataFrame:
    """T16 + T18: greedy fragment paths per page, heaviest first, plus the
    remaining ``/html`` row (``is_rest``)."""
    rows = token_rows(nodes, tok)

    def fn(key, page):
        return [(*key, seq, x, int(text), int(html), w, w is None)
                for seq, (x, text, html, w, _) in enumerate(_fragments(_Tree(page), until_html_tokens, max_text_tokens), 1)]

    return map_groups(rows, ["page_id"], fn, FRAGMENT_SCHEMA.format(key=_key_type(rows)), [
        "page_id", pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()])


SWEEP_SCHEMA = ("page_id {key}, fragment_count long, fragment_tokens array<long>, final_tokens long, "
                "until_html_tokens int, max_text_tokens int")


def sweep_fragments(nodes: DataFrame, grid: list[tuple[int, int]], tok=token_count) -> DataFrame:
    """Z8 + W12: the split for every (until_html_tokens, max_text_tokens) of ``grid``
    in one pass: a page's tree is built once and restored between the grid
    points. ``fragment_tokens`` are the drops of the serialized size after each
    removal, ``final_tokens`` what is left."""
    rows = token_rows(nodes, tok)

    def fn(key, page):
        tree, out = _Tree(page), []
        for until, most in grid if tree.root is not None else []:
            *frs, rest = _fragments(tree, until, most)
            tree.restore()
            out.append((*key, len(frs), [int(f[4]) for f in frs], int(rest[4]), until, most))
        return out

    return map_groups(rows, ["page_id"], fn, SWEEP_SCHEMA.format(key=_key_type(rows)), [
        "page_id", pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()])


def remove_until(nodes: DataFrame, token_below: int = 1024, until: int = 4096,
                 tok=token_count) -> DataFrame:
    """Repeatedly remove the node found by descending into the
    child with most text tokens until it is at most ``token_below``; stop when
    the page has at most ``until`` text tokens. Returns removal count and the
    removed sizes followed by the remaining size."""
    rows = token_rows(nodes, tok)

    def fn(key, page):
        tr = _Tree(page)
        sizes, rest = [], []
        if tr.root is not None:
            while tr.text[tr.root] > until and (way := list(tr.heavy_descent(token_below))):
                sizes.append(int(tr.text[way[-1]]))
                tr.remove(way[-1])
            rest = [int(tr.text[tr.root])]
        return [(*key, len(sizes), sizes + rest)]

    return map_groups(rows, ["page_id"], fn, REMOVAL_SCHEMA.format(key=_key_type(rows)), [
        "page_id", pa.int32(), pa.list_(pa.int64())])


def fragment_texts(nodes: DataFrame, frags: DataFrame) -> DataFrame:
    """Each fragment's text as rendered lines.

    Fragments are taken out in order of ``seq``, so a text chunk belongs to the
    first fragment around it and otherwise to the rest row: no text repeats and
    none is lost. A fragment whose text was all taken before it has an empty
    text. One page's fragments form one small map."""
    roots = nodes.select("page_id", "node_id", "xpath").join(
        frags.filter(~F.col("is_rest")).select("page_id", "xpath", "seq"), ["page_id", "xpath"])
    taken = roots.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", "seq"))).alias("_taken"))
    rest = frags.filter("is_rest").select("page_id", F.col("seq").alias("_rest"))
    own = chunks(nodes).join(rest, "page_id").join(taken, "page_id", "left")
    first = F.array_min(F.transform("anc_ids", lambda a: F.try_element_at("_taken", a)))
    text = own.groupBy("page_id", F.coalesce(first, F.col("_rest")).alias("seq")).agg(
        render_lines(F.collect_list("chunk")).alias("text"))
    return frags.join(text, ["page_id", "seq"], "left").withColumn("text", F.coalesce("text", F.lit("")))

"""DOM as a table.

``explode_dom`` turns each page into rows of ``nodes`` once; everything else is
joins, windows and aggregates over that table, always keyed by ``page_id`` so
interval (subtree) joins plan as hash/sort-merge joins with a range residual
and never as nested loops.

nodes schema::

    page_id, node_id INT (pre-order), end_id INT (last id in subtree),
    parent_id INT (-1 at the root), depth INT, child_ord INT, tag STRING,
    sib_idx INT, sib_n INT (rank / count among same-tag siblings),
    xpath STRING (index only if sib_n > 1), tag_path STRING (no indices),
    sib_path ARRAY<INT> (sib_idx of every ancestor-or-self),
    anc_ids ARRAY<INT> (node ids root..self), attrs MAP<STRING,STRING>,
    text STRING, tail STRING,
    text_slots ARRAY<STRUCT<idx INT, text STRING, seq INT, brk BOOLEAN, vis BOOLEAN>>,
    start_seq INT (document position of the element among text chunks)
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.htmltree import COMMENT, INLINE_TAGS, build_rows

SLOT_TYPE = T.StructType([
    T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("seq", T.IntegerType()), T.StructField("brk", T.BooleanType()),
    T.StructField("vis", T.BooleanType())])

NODE_FIELDS = [
    T.StructField("node_id", T.IntegerType()), T.StructField("end_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()), T.StructField("depth", T.IntegerType()),
    T.StructField("child_ord", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("sib_idx", T.IntegerType()), T.StructField("sib_n", T.IntegerType()),
    T.StructField("xpath", T.StringType()), T.StructField("tag_path", T.StringType()),
    T.StructField("sib_path", T.ArrayType(T.IntegerType())),
    T.StructField("anc_ids", T.ArrayType(T.IntegerType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("tail", T.StringType()),
    T.StructField("text_slots", T.ArrayType(SLOT_TYPE)),
    T.StructField("start_seq", T.IntegerType()),
]

_PA_SLOT = pa.struct([("idx", pa.int32()), ("text", pa.string()), ("seq", pa.int32()),
                      ("brk", pa.bool_()), ("vis", pa.bool_())])
_PA_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(),
             pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.map_(pa.string(), pa.string()), pa.string(),
             pa.string(), pa.list_(_PA_SLOT), pa.int32()]


def explode_dom(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                keep: list[str] | None = None, pages_per_batch: int = 64,
                min_partitions: int | None = None) -> DataFrame:
    """Pages -> nodes, one row per element or comment, via ``mapInArrow``.

    Partition-local (no shuffle); work scales with the number of pages.
    ``keep`` columns (small keys such as ``site``) are repeated on each node.
    A scan with fewer splits than ``min_partitions`` (default: the cluster's
    parallelism) is spread round-robin first so parsing uses every core; a
    large scan already has enough splits and is left alone.
    """
    keep = list(keep or [])
    src = pages.select(id_col, html_col, *keep)
    want = min_partitions or pages.sparkSession.sparkContext.defaultParallelism
    if src.rdd.getNumPartitions() < want:
        src = src.repartition(want)
    key_fields = [src.schema[c] for c in [id_col] + keep]
    out_schema = T.StructType(
        [T.StructField("page_id" if f.name == id_col else f.name, f.dataType) for f in key_fields]
        + NODE_FIELDS)
    key_names = [id_col] + keep
    out_names = out_schema.fieldNames()

    def run(batches):
        for rb in batches:
            cols = {k: rb.column(k).to_pylist() for k in key_names}
            htmls = rb.column(html_col).to_pylist()
            acc = [[] for _ in out_names]
            n_keys = len(key_names)
            done = 0
            for i, h in enumerate(htmls):
                keys = [cols[k][i] for k in key_names]
                for r in build_rows(h):
                    for j, v in enumerate(keys):
                        acc[j].append(v)
                    r[12] = list(r[12].items())
                    r[15] = [dict(idx=a, text=b, seq=c, brk=d, vis=e) for a, b, c, d, e in r[15]]
                    for j, v in enumerate(r):
                        acc[n_keys + j].append(v)
                done += 1
                if done % pages_per_batch == 0 or i == len(htmls) - 1:
                    if acc[0]:
                        arrays = [pa.array(acc[j], type=rb.schema.field(key_names[j]).type)
                                  for j in range(n_keys)]
                        arrays += [pa.array(acc[n_keys + j], type=t) for j, t in enumerate(_PA_TYPES)]
                        yield pa.RecordBatch.from_arrays(arrays, names=out_names)
                    acc = [[] for _ in out_names]

    return src.mapInArrow(run, out_schema)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tag") != COMMENT)


def texts(nodes: DataFrame) -> DataFrame:
    """Text chunks (own text and child tails) in document order: X4/F6/F7 input.

    Columns: page_id, node_id (owner), idx (XPath text() index), text, seq, brk, vis.
    """
    return (nodes.select("page_id", "node_id", F.explode("text_slots").alias("s"))
            .select("page_id", "node_id", "s.idx", "s.text", "s.seq", "s.brk", "s.vis"))


def render_lines(chunks: Column) -> Column:
    """F6 on an array of slot structs: document order, newline at block edges,
    collapse spaces, strip lines, drop blank lines, join by newline."""
    srt = F.array_sort(chunks, lambda a, b: F.when(a.seq < b.seq, -1)
                       .when(a.seq > b.seq, 1).otherwise(0))
    raw = F.array_join(F.transform(
        F.filter(srt, lambda x: x.vis),
        lambda x: F.concat(F.when(x.brk, F.lit("\n")).otherwise(F.lit("")),
                           F.regexp_replace(x.text, r"[ \t\r\n\f]+", " "))), "")
    lines = F.transform(F.split(raw, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def target_sets(targets: DataFrame) -> DataFrame:
    """Per page, the set of target node ids (bounded by the page's size)."""
    return targets.select("page_id", "node_id").groupBy("page_id").agg(
        F.collect_set("node_id").alias("_tids"))


def under_targets(items: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """Pair each item (a row with ``page_id`` and its ``anc_ids``) with every
    target node that is an ancestor-or-self of it (a proper ancestor when
    ``strict``), as ``target_id``.

    Subtree membership is read off ``anc_ids``: one equi-join on page_id with
    the page's target set and an ``array_intersect``, so the work is linear in
    items x depth - never the (targets x nodes) pairs a range join enumerates.
    """
    anc = F.slice("anc_ids", 1, F.size("anc_ids") - 1) if strict else F.col("anc_ids")
    j = items.join(target_sets(targets), "page_id")
    return j.withColumn("target_id", F.explode(F.array_intersect(anc, F.col("_tids")))).drop("_tids")


def within(nodes: DataFrame, roots: DataFrame, keep_inside: bool, strict: bool = False) -> DataFrame:
    """Nodes inside (``keep_inside``) or outside the subtrees of ``roots``
    (page_id, node_id); ``strict`` excludes the roots themselves."""
    anc = F.slice("anc_ids", 1, F.size("anc_ids") - 1) if strict else F.col("anc_ids")
    j = nodes.join(target_sets(roots), "page_id", "left")
    hit = F.coalesce(F.arrays_overlap(anc, F.col("_tids")), F.lit(False))
    return j.filter(hit if keep_inside else ~hit).drop("_tids")


def chunks(nodes: DataFrame) -> DataFrame:
    """Text chunks with their owner's ancestors (input of subtree text)."""
    return nodes.select("page_id", F.col("node_id").alias("owner"), "anc_ids",
                        F.explode("text_slots").alias("chunk"))


def _subtree_chunks(nodes: DataFrame, targets: DataFrame, key_cols: list[str]) -> DataFrame:
    """(page_id, node_id, keys..., chunks ARRAY) for every target, [] when none."""
    cols = ["page_id", "node_id"] + [c for c in key_cols if c not in ("page_id", "node_id")]
    tg = targets.select(*cols)
    pairs = under_targets(chunks(nodes.join(tg.select("page_id").distinct(), "page_id", "left_semi")),
                          tg).select("page_id", F.col("target_id").alias("node_id"), "chunk")
    agg = pairs.groupBy("page_id", "node_id").agg(F.collect_list("chunk").alias("chunks"))
    return tg.join(agg, ["page_id", "node_id"], "left").withColumn(
        "chunks", F.coalesce("chunks", F.array().cast(T.ArrayType(SLOT_TYPE))))


def subtree_text(nodes: DataFrame, targets: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rendered text of each target node's subtree (X1 element results, F6/F7)."""
    return _subtree_chunks(nodes, targets, key_cols).withColumn(
        "rendered", render_lines(F.col("chunks"))).drop("chunks")


def string_value(nodes: DataFrame, targets: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
    """XPath string-value / bs4 get_text: all subtree text, no separators."""
    c = _subtree_chunks(nodes, targets, key_cols or [])
    return c.withColumn("sv", F.array_join(F.transform(F.sort_array(F.transform(
        "chunks", lambda x: F.struct(x.seq.alias("seq"), x.text.alias("text")))), lambda x: x.text), "")
    ).drop("chunks")


def text_content(nodes: DataFrame, targets: DataFrame, key_cols: list[str]) -> DataFrame:
    """stripped non-empty chunks of the subtree joined by one space."""
    c = _subtree_chunks(nodes, targets, key_cols)
    srt = F.sort_array(F.transform("chunks", lambda x: F.struct(x.seq.alias("seq"), x.text.alias("text"))))
    return c.withColumn("text_content", F.array_join(F.filter(
        F.transform(srt, lambda x: F.regexp_replace(x.text, r"(?U)^\s+|\s+$", "")),
        lambda s: s != ""), " ")).drop("chunks")


def ancestors(nodes: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Explode each node to its ancestors-or-self: (page_id, node_id, anc_id, anc_depth).

    One narrow explode (rows x depth); joins back to nodes on (page_id, anc_id)
    are equi-joins. Used for subtree aggregates and path assembly.
    """
    cols = cols or []
    return nodes.select("page_id", "node_id", *cols,
                        F.posexplode("anc_ids").alias("anc_depth", "anc_id"))


def sibling_ordinals(nodes: DataFrame) -> DataFrame:
    """W6/A12 relationally: same-tag rank and count per parent (window)."""
    w = Window.partitionBy("page_id", "parent_id", "tag")
    return (nodes.withColumn("w_sib_idx", F.row_number().over(w.orderBy("child_ord")))
            .withColumn("w_sib_n", F.count(F.lit(1)).over(w)))


def subtree_stats(nodes: DataFrame, token_fn=None) -> DataFrame:
    """Per node subtree sums and maxima via ancestor explode + groupBy.

    Returns page_id, node_id, n_desc, text_tokens (own), sub_text_tokens,
    sub_html_tokens, max_depth, n_leaves, width (children count), and the
    subtree's largest own text, element size and width.
    """
    from pagesift.functions.text import token_count
    tok = token_fn or token_count
    own = nodes.select(
        "page_id", "node_id", "anc_ids", "depth", "parent_id",
        tok(F.array_join(F.transform("text_slots", lambda s: s.text), " ")).alias("text_tokens"),
        (tok(F.array_join(F.transform("text_slots", lambda s: s.text), " "))
         + F.lit(2) + F.size(F.map_keys("attrs")) * 2).alias("html_tokens"))
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("width"))
    base = own.join(kids, ["page_id", "node_id"], "left").fillna(0, ["width"])
    ex = base.select("page_id", F.explode("anc_ids").alias("anc"), "depth", "text_tokens",
                     "html_tokens", "width", (F.col("width") == 0).alias("is_leaf"))
    agg = ex.groupBy("page_id", F.col("anc").alias("node_id")).agg(
        (F.count(F.lit(1)) - 1).alias("n_desc"),
        F.sum("text_tokens").alias("sub_text_tokens"),
        F.sum("html_tokens").alias("sub_html_tokens"),
        F.max("depth").alias("max_depth"),
        F.count_if("is_leaf").alias("n_leaves"),
        F.max("text_tokens").alias("max_text_tokens"), F.max("html_tokens").alias("max_html_tokens"),
        F.max("width").alias("max_width"))
    return base.drop("anc_ids").join(agg, ["page_id", "node_id"])


def is_block(tag: Column) -> Column:
    return ~tag.isin(*sorted(INLINE_TAGS)) | (tag == "br")


def common_ancestor(nodes: DataFrame, members: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Lowest common ancestor of each group of member nodes
    (default group: the page). The deepest depth at which every member's
    ancestor list holds one and the same id; one explode + aggregate."""
    g = ["page_id"] + [c for c in (group or []) if c != "page_id"]
    m = members.select(*g, "node_id").distinct().join(
        nodes.select("page_id", "node_id", "anc_ids"), ["page_id", "node_id"])
    size = m.groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
    ex = m.select(*g, F.posexplode("anc_ids").alias("d", "anc"))
    per = ex.groupBy(*g, "d").agg(F.count(F.lit(1)).alias("c"), F.min("anc").alias("lo"),
                                  F.max("anc").alias("hi"))
    per = per.join(size, g).filter((F.col("c") == F.col("n")) & (F.col("lo") == F.col("hi")))
    return per.groupBy(*g).agg(F.max_by("lo", "d").alias("lca_id"))

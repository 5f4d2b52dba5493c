"""Line dedup over overlapping three-line windows.

A document's non-blank lines (trimmed for comparison) form overlapping windows of
three consecutive lines; a document with one or two such lines has one window of
them all. Windows that come more than once anywhere are found by one aggregate;
every line covered by an occurrence that is not a window's first is removed. The
first occurrence is the smallest (doc_id, text hash, position), so the earliest
copy of each line stays. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import let, prepare, scratch, table, unused_name, written

WINDOW = 3
_BLANK = " \t\r\x0b\f"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANK))


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _non_blank() -> Column:
    return F.filter(F.transform(_lines(), _trim), lambda x: x != "")


def windows(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, th, pos, width): the windows of each document; ``pos`` counts
    non-blank lines. The two keys are independent 64-bit hashes of the lines."""
    hashed = F.transform(_non_blank(), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(WINDOW), x).alias("b")))

    def of(h):
        full = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.struct(
            F.xxhash64(*[F.get(h, i + k)["a"] for k in range(WINDOW)]).alias("k1"),
            F.xxhash64(*[F.get(h, i + k)["b"] for k in range(WINDOW)]).alias("k2"),
            i.alias("pos"), F.lit(WINDOW).alias("width")))
        short = F.array(F.struct(F.xxhash64(F.size(h), h["a"]).alias("k1"), F.xxhash64(F.size(h), h["b"]).alias("k2"),
                                 F.lit(0).alias("pos"), F.size(h).alias("width")))
        return F.when(F.size(h) >= WINDOW, full).when(F.size(h) > 0, short)

    return docs.filter("text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
        F.explode(let(hashed, of)).alias("w")).select("w.k1", "w.k2", "doc_id", "th", "w.pos", "w.width")


def later_occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, covered): positions, among non-blank lines, to remove."""
    w = windows(docs)
    place = F.struct("doc_id", "th", "pos")
    # written: the join below then reads a plain table, whose hot keys Spark can split
    repeated = written(w.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                       .filter("n > 1").select("k1", "k2", "first"), "repeated-windows")
    # never broadcast, here and below: both tables grow with the documents, so the plan
    # is the same and the disk in proportion at every size
    later = w.join(repeated.hint("merge"), ["k1", "k2"]).filter(~place.eqNullSafe(F.col("first")))
    covered = F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("width") - 1))
    later = written(later.select("doc_id", "th", covered.alias("at")).distinct(), "covered-lines")
    # a document's own line numbers: no larger than the document itself
    return later.groupBy("doc_id", "th").agg(F.collect_list("at").alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents, with all their columns, ``text`` without repeated lines, and
    _n_lines and _n_removed (non-blank lines before, lines removed; with more
    underscores where a column has that name).

    Blank lines stay. A null text stays null with counts 0; an empty one is
    unchanged. Rows that repeat an id and text are one document and come out
    alike; null ids sort first; an empty table gives no rows. A document whose
    lines all came before keeps its row, with an empty text."""
    with scratch(docs.sparkSession) as keep:
        cover = keep(written(later_occurrences(docs), "covered"))
    n_lines, n_removed = unused_name(docs, "_n_lines"), unused_name(docs, "_n_removed")
    cover = cover.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "covered")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("th"))
    rows = rows.join(cover.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")

    def rest(lines):
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        filled = F.filter(at, lambda i: _trim(F.get(lines, i)) != "")
        gone = let(filled, lambda nb: F.transform("covered", lambda i: F.get(nb, i)))
        return F.array_join(F.transform(F.array_except(at, gone), lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(let(_lines(), rest))
    out = [(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns]
    return rows.select(*out, F.coalesce(F.size(_non_blank()), F.lit(0)).cast("long").alias(n_lines),
                       F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias(n_removed))


def op8_line_dedup(spark, sf_dir):
    """Documents without lines of repeated three-line windows."""
    prepare(spark)
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


OP8_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS idx FROM l WHERE text IS NOT NULL),
t AS (SELECT doc_id, idx, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS x FROM u),
nb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos,
       count(*) OVER (PARTITION BY doc_id) AS n FROM t WHERE x <> ''),
w AS (SELECT doc_id, pos, n, [x, lead(x) OVER d, lead(x, 2) OVER d] AS k FROM nb
      WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT doc_id, pos, k, least(n, 3) AS width FROM w WHERE pos = 0 OR pos + 3 <= n),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM v),
c AS (SELECT DISTINCT doc_id, pos + unnest(range(0, width)) AS pos FROM f WHERE r > 1),
g AS (SELECT nb.doc_id, nb.idx FROM nb JOIN c USING (doc_id, pos)),
s AS (SELECT u.doc_id, array_to_string(coalesce(list(u.line ORDER BY u.idx) FILTER (WHERE g.idx IS NULL), []), chr(10)) AS text,
      count(g.idx) AS n_removed FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.idx = u.idx GROUP BY u.doc_id)
SELECT l.doc_id, coalesce((SELECT count(*) FROM nb WHERE nb.doc_id = l.doc_id), 0) AS n_lines,
       coalesce(s.n_removed, 0) AS n_removed, CASE WHEN l.text IS NULL THEN NULL ELSE s.text END AS text
FROM l LEFT JOIN s ON s.doc_id = l.doc_id"""

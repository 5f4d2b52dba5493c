"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search. Items are partitioned by the power
of two above their shingle count; an item's sketch holds its smallest hash values,
as many as its partition's largest size needs so that any document containing the
threshold share of the item must hold at least one of them. Documents of any
length probe the sketches with all their shingles, so short items are found inside
long documents. Candidates are verified by exact containment of shingles.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import broadcast_if_small, prepare, shingle_hashes, table, written, scratch, unused_name

SHINGLE = 5
PERCENT = 80
# rows up to which sketches, item sets or candidates are broadcast
MAX_BROADCAST = 100_000


def plain_words(text: Column | str) -> Column:
    """Lower-cased runs of letters, marks and digits; punctuation separates."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+", -1), lambda w: w != "")


def item_sets(items: DataFrame) -> DataFrame:
    """(item, item_id, width, sh, n): the distinct shingles of each item. Items of
    fewer than five words have one shingle, of all their words."""
    w = items.select("item_id", plain_words("text").alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    by_width = F.array().cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        by_width = F.when(F.col("width") == k, shingle_hashes(F.col("w"), k, False)).otherwise(by_width)
    return (w.withColumn("sh", F.array_distinct(by_width)).withColumn("n", F.size("sh"))
            .select("item_id", "width", "sh", "n").distinct()
            .withColumn("item", F.xxhash64("item_id", "width", "sh")))


def sketches(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item, h): the smallest shingle hashes of each item, by size partition."""
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    missing = F.floor(largest * F.lit(100 - percent) / 100).cast("int")
    ranked = F.array_sort(F.transform("sh", lambda h: F.struct(F.xxhash64(h).alias("rank"), h.alias("h"))))
    return sets.select("item", F.explode(F.slice(ranked, F.lit(1), missing + 1)).alias("s")).select("item", "s.h")


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per (document, item) with at least ``percent`` of the item's distinct
    shingles in the document: doc_id, th (hash of the text), item_id, n_item,
    n_common.

    Null and empty texts and items without words match nothing; repeated rows
    give one result; null ids are ids like others; empty tables give no rows;
    other columns are ignored."""
    sets = written(item_sets(items), "item-sets")
    widths = sorted(r.width for r in sets.select("width").distinct().collect())  # at most five numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    def doc_shingles():
        w = plain_words("text")
        return F.flatten(F.array(*[shingle_hashes(w, k, False) for k in widths]))

    if not widths:
        widths = [SHINGLE]
    index = broadcast_if_small(written(sketches(sets, percent), "sketches"), MAX_BROADCAST)
    hits = (rows.select("doc_id", "th", F.explode(doc_shingles()).alias("h")).join(index, "h")
            .select("doc_id", "th", "item").distinct())
    hits = written(hits, "leak-candidates")
    key = hits.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct()
    held = rows.join(broadcast_if_small(key, MAX_BROADCAST),
                     F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi")
    held = held.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", doc_shingles().alias("have"))
    pairs = hits.join(broadcast_if_small(sets, MAX_BROADCAST), "item").withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t")
    found = held.join(pairs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    return (found.withColumn("n_common", F.size(F.array_intersect("sh", "have")))
            .filter(100 * F.col("n_common") >= percent * F.col("n"))
            .select("doc_id", "th", "item_id", F.col("n").cast("long").alias("n_item"),
                    F.col("n_common").cast("long").alias("n_common")))


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that contain no test item."""
    d, t = unused_name(docs, "_d"), unused_name(docs, "_t")
    with scratch(docs.sparkSession) as keep:
        bad = keep(written(find_leaks(docs, items, percent).select(
            F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "contaminated"))
    return docs.join(broadcast_if_small(bad, MAX_BROADCAST),
                     F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)),
                     "left_anti")


def op2_decontamination(spark, sf_dir):
    """Benchmark items found in documents."""
    prepare(spark)
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


_GRAMS = r"""list_transform(range(1, len(w) - least(5, n) + 2), lambda i: array_to_string(w[i:i + least(5, n) - 1], ' '))"""
OP2_SQL = rf"""
WITH b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, least(5, len(w)) AS width, w FROM b WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, width, unnest({_GRAMS}) AS g FROM i),
ic AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}]+') AS w FROM documents),
dw AS (SELECT doc_id, w, width AS n FROM d, (SELECT DISTINCT width FROM i)),
dg AS (SELECT DISTINCT doc_id, n AS width, unnest({_GRAMS}) AS g FROM dw WHERE len(w) >= n),
m AS (SELECT doc_id, item_id, count(*) AS n_common FROM dg JOIN ig USING (g, width) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_common FROM m JOIN ic USING (item_id) WHERE 100 * n_common >= 80 * n_item"""

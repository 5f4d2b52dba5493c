"""Queries over the harness tables, each paired with DuckDB SQL computing the
same result from the raw tables (``ORACLE``). Every query reads whole tables.

On ``pages`` the ground truth an annotator would give is taken from the markup
itself (title text, nav link texts, the ad block's words), so predicted values
from DOM programs can be scored against it and the oracle can recompute both
sides with regular expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.text import TOKEN_PATTERN, html_unescape, normalize_text, token_count
from pagesift.operators import clean, metrics, relational, sampling, stats
from pagesift.operators.dom import sibling_ordinals
from pagesift.operators.xpath import apply_programs
from pagesift.plans.common import keyed_nodes, keyed_pages, prepare, site_programs, table

# ---------------------------------------------------------------- SQL helpers
_ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
        ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _u(x: str) -> str:
    """One HTML unescape pass for the entities present in the harness pages,
    including the legacy ``&amp`` without a semicolon."""
    for a, b in _ENT:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '&amp([^;]|$)', '&\\1', 'g')"


def _norm(x: str) -> str:
    """parse-unescape + normalize_text (second unescape, 2+ spaces, strip)."""
    return f"regexp_replace(regexp_replace({_u(_u(x))}, ' {{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def _render(x: str) -> str:
    """element rendering of a one-chunk element: whitespace runs to one space."""
    return _norm(f"regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g')")


_SITE = "regexp_extract(url, '://([^/]+)', 1)"
_CAT = "regexp_extract(url, '/(en|fr|de|es)/', 1)"
_TOK = TOKEN_PATTERN.replace("\t", "\\t").replace("\n", "\\n").replace("\x0b", "\\x0B").replace(
    "\f", "\\f").replace("\r", "\\r")


def _tokens_sql(x: str) -> str:
    return f"coalesce(len(regexp_extract_all({x}, '{_TOK}')), 0)"


# page-level truth and predictions, shared by the metric oracles
_PAGE_LISTS = f"""
pl AS (
  SELECT page_id, {_SITE} AS site, {_CAT} AS category,
         [{_render("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}] AS pred_title,
         [{_norm("regexp_extract(html, '<title>(.*?)</title>', 1)")}] AS truth_title,
         list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1),
                        '<a href="[^"]*">([^<]*)</a>', 1), lambda x: {_norm('x')}) AS nav,
         list_filter(string_split({_render("regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1)")}, ' '),
                     lambda x: x <> '') AS ad_words
  FROM pages)"""


# ------------------------------------------------------------------- queries
def _h1_nav_predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = keyed_pages(spark, d)
    nodes = keyed_nodes(spark, d)
    progs = site_programs(pages, [("title", "//h1"), ("nav", "//nav//a/text()")])
    pred = apply_programs(nodes, progs, ["site"], ["field"])
    return pages, pred


def _truth(pages: DataFrame) -> DataFrame:
    """title text and the ad block's words as ground truth (long form)."""
    # displayed text: unescaped once as the parser would, then normalized
    title = normalize_text(html_unescape(F.regexp_extract("html", "<title>(.*?)</title>", 1)))
    ad = normalize_text(html_unescape(F.regexp_replace(
        F.regexp_extract("html", '<div class="ad">(.*?)</div>', 1), r"[ \t\r\n\f]+", " ")))
    return pages.select("page_id", "site", "category", F.explode(F.array(
        F.struct(F.lit("title").alias("field"), F.array(title).alias("values")),
        F.struct(F.lit("nav").alias("field"),
                 F.filter(F.split(ad, " "), lambda x: x != "").alias("values")))).alias("t")).select(
        "page_id", "site", "category", "t.field", "t.values")


def q_xpath_h1(spark, d):
    """T1 + X1 (absolute path, equi-join fast path) + J3 + F1."""
    prepare(spark)
    pages = keyed_pages(spark, d)
    progs = site_programs(pages, [("title", "/html/body/article/h1")])
    res = apply_programs(keyed_nodes(spark, d), progs, ["site"], ["field"])
    return res.select("page_id", F.explode("values").alias("value"))


def q_links_by_page(spark, d):
    """X1 ``//a/@href``: descendant axis + attribute terminal, document order."""
    prepare(spark)
    pages = keyed_pages(spark, d)
    progs = site_programs(pages, [("links", "//a/@href")])
    res = apply_programs(keyed_nodes(spark, d), progs, ["site"], ["field"])
    return res.select("page_id", F.posexplode("values").alias("pos", "href"))


def q_nav_positional(spark, d):
    """Positional path of nav links; li ordinal by window."""
    prepare(spark)
    nodes = keyed_nodes(spark, d)
    li = sibling_ordinals(nodes.filter(F.col("tag_path") == "/html/body/nav/ul/li")).select(
        "page_id", F.col("node_id").alias("li_id"), F.col("w_sib_idx").alias("li_pos"))
    a = nodes.filter(F.col("tag_path") == "/html/body/nav/ul/li/a").select(
        "page_id", "xpath", F.col("parent_id").alias("li_id"),
        normalize_text(F.coalesce(F.get("text_slots", F.lit(0)).text, F.lit(""))).alias("text"))
    return a.join(li, ["page_id", "li_id"]).select("page_id", "xpath", "li_pos", "text")


def q_tag_histogram(spark, d):
    """T1 + A12: element counts by tag, with the ``b`` that HTML5 re-creates."""
    prepare(spark)
    return keyed_nodes(spark, d).filter(F.col("tag") != "#comment").groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"))


def q_sanitize_counts(spark, d):
    """T4 (deep): nodes per removal reason, per page."""
    prepare(spark)
    c = clean.classify(keyed_nodes(spark, d), "deep")
    return c.groupBy("page_id").agg(
        F.count_if(F.col("reason") == "comment").alias("n_comment"),
        F.count_if(F.col("reason") == "interactive").alias("n_interactive"),
        F.count_if(F.col("reason") == "invisible").alias("n_invisible"),
        F.count_if(F.col("reason") == "empty").alias("n_empty"),
        F.count_if(F.col("reason") == "kept").alias("n_kept"))


def q_site_sample_md5(spark, d):
    """Three seed pages per site by md5 order."""
    prepare(spark)
    p = keyed_pages(spark, d).select("site", "page_id")
    return sampling.sample_per_group(p, ["site"], 3, "page_id", 0).select("site", "page_id", "rn")


def q_sample_with_replacement(spark, d):
    """Five draws with replacement per site."""
    prepare(spark)
    p = keyed_pages(spark, d).select("site", "page_id")
    return sampling.sample_with_replacement(p, ["site"], 5, "page_id", 0).select(
        "site", "draw", "page_id")


def q_resume_anti(spark, d):
    """Evaluation pool = pages not chosen as seeds (anti-join)."""
    prepare(spark)
    p = keyed_pages(spark, d).select("site", "page_id")
    _, pool = sampling.split_seeds(p, ["site"], 3, "page_id", 0)
    return pool


def _doc_tokens(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", "lang", "n_chars", token_count("text").alias("tokens"),
        stats.bin_floor(F.col("n_chars"), 4000).alias("bin"))


def q_token_bins(spark, d):
    """F9 + P8 + A1: mean token count per 4000-character bin."""
    prepare(spark)
    return stats.mean_by_bin(_doc_tokens(spark, d), ["tokens", "n_chars"], "bin")


def q_describe_bins(spark, d):
    """describe() of token counts per bin."""
    prepare(spark)
    return stats.describe_by_bin(_doc_tokens(spark, d), "bin", "tokens")


def q_corr_by_lang(spark, d):
    """Correlation of size and tokens per language (zero variance -> 0)."""
    prepare(spark)
    return stats.corr_by_group(_doc_tokens(spark, d), ["lang"], "n_chars", "tokens")


def q_eval_grouping_sets(spark, d):
    """E1 + E2 + J4 + E5 + A8: program predictions vs truth, per site and overall."""
    prepare(spark)
    pages, pred = _h1_nav_predictions(spark, d)
    truth = _truth(pages)
    counts = metrics.eval_objects(pred.select("page_id", "site", "field", "values"),
                                  truth.drop("category"), ["page_id", "site"])
    counts = counts.join(pages.select("page_id", "category"), "page_id")
    return metrics.site_report(counts, ["category", "site"], digits=6)


def _pairs(spark, d):
    """Per page: predicted labels = nav link texts (program), truth = ad words."""
    pages, pred = _h1_nav_predictions(spark, d)
    p = pred.filter(F.col("field") == "nav").select("page_id", F.col("values").alias("pred"))
    t = _truth(pages).filter(F.col("field") == "nav").select("page_id", F.col("values").alias("truth"))
    return p.join(t, "page_id")


def q_eval_sets(spark, d):
    """E7 + E8: set-based micro metrics."""
    prepare(spark)
    r = metrics.set_micro(_pairs(spark, d))
    return r.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in (
        "precision", "recall", "f1", "label_accuracy")])


def q_eval_exact(spark, d):
    """Exact-set accuracy (h1 words vs title words)."""
    prepare(spark)
    pages, pred = _h1_nav_predictions(spark, d)
    p = pred.filter(F.col("field") == "title").select(
        "page_id", F.flatten(F.transform("values", lambda v: F.split(v, " "))).alias("pred"))
    t = _truth(pages).filter(F.col("field") == "title").select(
        "page_id", F.flatten(F.transform("values", lambda v: F.split(v, " "))).alias("truth"))
    r = metrics.exact_set_accuracy(p.join(t, "page_id"))
    return r.select(F.round("exact_accuracy", 6).alias("exact_accuracy"), "n_samples")


def q_eval_samples(spark, d):
    """Sample-averaged precision / recall, undefined samples skipped."""
    prepare(spark)
    r = metrics.sample_averages(_pairs(spark, d))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def q_eval_per_label(spark, d):
    """Binarized per-label counts and scores (unknown predictions ignored)."""
    prepare(spark)
    per, _ = metrics.multilabel_report(_pairs(spark, d), ["page_id"])
    return per.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in (
        "precision", "recall", "f1")])


def q_missing_surplus(spark, d):
    """Missing and surplus values per page."""
    prepare(spark)
    pr = _pairs(spark, d)
    miss, sur = metrics.missing_surplus(F.col("pred"), F.col("truth"))
    return pr.select("page_id", F.array_join(F.array_sort(miss), "|").alias("missing"),
                     F.array_join(F.array_sort(sur), "|").alias("surplus"))


def q_melt_metrics(spark, d):
    """The per-site report in long form."""
    rep = q_eval_grouping_sets(spark, d)
    return relational.melt(rep, ["category", "site"], ["accuracy", "precision", "recall", "f1"],
                           "metric", "value")


def q_prefix_dedup(spark, d):
    """Drop URL paths that have a proper ancestor path on the same site."""
    prepare(spark)
    p = keyed_pages(spark, d).select(
        "site", F.regexp_extract("url", "://[^/]+(/[^?#]*)", 1).alias("path")).distinct()
    return relational.prefix_dedup(p, ["site"], "path")


def q_upsert_by_id(spark, d):
    """Each even turn is replaced by the assistant turn that follows it."""
    prepare(spark)
    c = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 2).cast("string")).alias("pair_id"),
                                                "turn", "role", "text")
    left = c.filter(F.col("turn") % 2 == 0).select("pair_id", "role", "text")
    right = c.filter((F.col("turn") % 2 == 1) & (F.col("role") == "assistant")).select("pair_id", "role", "text")
    return relational.upsert_by_id(left, right, "pair_id")


def _conv_lists(c: DataFrame) -> DataFrame:
    return c.groupBy("conv_id", F.col("role").alias("field")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("values"),
        F.min("turn").cast("string").alias("cue_text"))


def q_gt_overlay(spark, d):
    """Later user turns (as truth) overlay the user's turns (as annotation)."""
    prepare(spark)
    c = table(spark, d, "conversations")
    ann = _conv_lists(c)
    gt = _conv_lists(c.filter((F.col("role") == "user") & (F.col("turn") >= 2))).drop("cue_text")
    out = relational.overlay_truth(ann, gt, ["conv_id"])
    return out.select("conv_id", "field", F.array_join("values", "\u241e").alias("values"), "cue_text")


def q_gt_long_to_wide(spark, d):
    """One column per role, absent roles become empty lists."""
    prepare(spark)
    c = table(spark, d, "conversations")
    w = relational.long_to_wide(_conv_lists(c).drop("cue_text"), ["conv_id"],
                                ["assistant", "system", "user"])
    return w.select("conv_id", *[F.size(x).alias(f"n_{x}") for x in ("assistant", "system", "user")],
                    *[F.array_join(x, "\u241e").alias(x) for x in ("assistant", "system", "user")])


QUERIES = {
    "xpath_h1": q_xpath_h1,
    "links_by_page": q_links_by_page,
    "nav_positional": q_nav_positional,
    "tag_histogram": q_tag_histogram,
    "sanitize_counts": q_sanitize_counts,
    "site_sample_md5": q_site_sample_md5,
    "sample_with_replacement": q_sample_with_replacement,
    "resume_anti": q_resume_anti,
    "token_bins": q_token_bins,
    "describe_bins": q_describe_bins,
    "corr_by_lang": q_corr_by_lang,
    "eval_grouping_sets": q_eval_grouping_sets,
    "eval_sets": q_eval_sets,
    "eval_exact": q_eval_exact,
    "eval_samples": q_eval_samples,
    "eval_per_label": q_eval_per_label,
    "missing_surplus": q_missing_surplus,
    "melt_metrics": q_melt_metrics,
    "prefix_dedup": q_prefix_dedup,
    "upsert_by_id": q_upsert_by_id,
    "gt_overlay": q_gt_overlay,
    "gt_long_to_wide": q_gt_long_to_wide,
}

# --------------------------------------------------------------- oracle SQL
# the harness's b elements are never closed: each later block with text opens all that
# are still open again, at most three of a kind
REBUILT_B = """
marks AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>.*', 0), '<p>|<b>|<footer>', 0) AS ts FROM pages),
mark AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM marks),
opened AS (SELECT page_id, t, coalesce(sum((t = '<b>')::INT) OVER (
             PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM mark),
nb AS (SELECT page_id, sum(CASE WHEN t = '<b>' THEN 1 ELSE least(k, 3) END)::BIGINT AS n_b,
              count(*) FILTER (t = '<p>') AS n_p FROM opened GROUP BY page_id)
"""
_SEEDS = f"""
seeds AS (
  SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY md5(CAST(page_id AS VARCHAR) || '#0'), page_id) AS rn
  FROM (SELECT page_id, {_SITE} AS site FROM pages))"""

_EVAL_ROWS = f"""WITH {_PAGE_LISTS},
f AS (
  SELECT page_id, site, category, pred_title AS pred, truth_title AS truth FROM pl
  UNION ALL
  SELECT page_id, site, category, nav AS pred, ad_words AS truth FROM pl),
c AS (
  SELECT page_id, site, category,
         len(list_filter(pred, lambda x: list_contains(truth, x))) AS tp,
         len(pred) - len(list_filter(pred, lambda x: list_contains(truth, x))) AS fp,
         len(list_filter(truth, lambda x: NOT list_contains(pred, x))) AS fn
  FROM f),
g AS (
  SELECT CASE WHEN grouping(category, site) > 0 THEN 'overall' ELSE category END AS category,
         CASE WHEN grouping(category, site) > 0 THEN 'overall' ELSE site END AS site,
         CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn
  FROM c GROUP BY GROUPING SETS ((category, site), ())),
r AS (
  SELECT category, site, tp, fp, fn,
         round(tp / (tp + fp + fn + 1e-6), 6) AS accuracy,
         round(tp / (tp + fp + 1e-6), 6) AS precision,
         round(tp / (tp + fn + 1e-6), 6) AS recall,
         round(2 * (tp / (tp + fp + 1e-6)) * (tp / (tp + fn + 1e-6))
               / ((tp / (tp + fp + 1e-6)) + (tp / (tp + fn + 1e-6)) + 1e-6), 6) AS f1
  FROM g)"""

_PAIRS = f"""WITH {_PAGE_LISTS},
s AS (
  SELECT page_id, list_distinct(nav) AS p, list_distinct(ad_words) AS g FROM pl),
k AS (
  SELECT page_id, len(list_filter(p, lambda x: list_contains(g, x))) AS tp,
         len(list_filter(p, lambda x: NOT list_contains(g, x))) AS fp,
         len(list_filter(g, lambda x: NOT list_contains(p, x))) AS fn
  FROM s)"""

_DOCS = f"""WITH dt AS (
  SELECT doc_id, lang, n_chars, {_tokens_sql('text')} AS tokens,
         CAST(floor(n_chars / 4000) * 4000 AS BIGINT) AS bin
  FROM documents)"""

_CONV = """cl AS (
  SELECT conv_id, role AS field, list(text ORDER BY turn) AS vals, CAST(min(turn) AS VARCHAR) AS cue_text
  FROM conversations GROUP BY conv_id, role)"""

ORACLE = {
    "xpath_h1": f"""
SELECT page_id, value FROM (
  SELECT page_id, {_render("regexp_extract(html, '<h1>(.*?)</h1>', 1)")} AS value FROM pages)
WHERE value <> ''""",
    "links_by_page": f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, href FROM (
  SELECT page_id, i, {_norm('l[i]')} AS href FROM (
    SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (
      SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)))
WHERE href <> ''""",
    "nav_positional": f"""
SELECT page_id,
       '/html/body/nav/ul/li' || CASE WHEN len(l) > 1 THEN '[' || i || ']' ELSE '' END || '/a' AS xpath,
       CAST(i AS INTEGER) AS li_pos, {_norm('l[i]')} AS text
FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (
  SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1),
                                     '<li><a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages))""",
    "tag_histogram": f"""
WITH {REBUILT_B}
SELECT tag, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '<script></script>', 'g'),
                                   '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
WHERE tag <> 'b' GROUP BY tag
UNION ALL SELECT 'b', sum(n_b)::BIGINT FROM nb HAVING sum(n_b) > 0""",
    "sanitize_counts": "WITH " + REBUILT_B + """
SELECT page_id,
  len(regexp_extract_all(html, '<!--', 0)) AS n_comment,
  len(regexp_extract_all(html, '<(script|style|noscript|svg|iframe|video|audio|source|track|link|meta|object|param|input|label|select|textarea|button|fieldset|legend|datalist|output|option|optgroup|col|colgroup|map|area|base|embed)[\\s>/]', 0)) AS n_interactive,
  len(regexp_extract_all(html, '<(head|title)[\\s>]', 0)) AS n_invisible,
  len(regexp_extract_all(html, '<br[\\s>/]', 0)) AS n_empty,
  len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'g'),
      '<(html|body|nav|ul|li|a|div|article|h1|p|footer)[\\s>]', 0)) + n_b AS n_kept
FROM pages JOIN nb USING (page_id)""",
    "site_sample_md5": f"WITH {_SEEDS} SELECT site, page_id, CAST(rn AS INTEGER) AS rn FROM seeds WHERE rn <= 3",
    "sample_with_replacement": f"""
WITH r AS (
  SELECT site, page_id,
         row_number() OVER (PARTITION BY site ORDER BY md5(CAST(page_id AS VARCHAR) || '#0')) AS rk,
         count(*) OVER (PARTITION BY site) AS m
  FROM (SELECT page_id, {_SITE} AS site FROM pages)),
g AS (SELECT DISTINCT site, m FROM r),
dr AS (SELECT site, m, unnest(generate_series(1, 5)) AS draw FROM g),
p AS (SELECT site, draw, (('0x' || substr(md5(site || '#' || CAST(draw AS VARCHAR) || '#0'), 1, 8))::BIGINT % m) + 1 AS rk FROM dr)
SELECT p.site, CAST(p.draw AS INTEGER) AS draw, r.page_id FROM p JOIN r ON p.site = r.site AND p.rk = r.rk""",
    "resume_anti": f"""
WITH {_SEEDS}
SELECT site, page_id FROM (SELECT page_id, {_SITE} AS site FROM pages) a
WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.site = a.site AND s.page_id = a.page_id AND s.rn <= 3)""",
    "token_bins": f"""{_DOCS}
SELECT bin, count(*) AS n, CAST(floor(avg(tokens)) AS BIGINT) AS mean_tokens,
       CAST(floor(avg(n_chars)) AS BIGINT) AS mean_n_chars
FROM dt GROUP BY bin""",
    "describe_bins": f"""{_DOCS}
SELECT bin, count(*) AS count, round(avg(tokens), 6) AS mean, round(stddev_samp(tokens), 6) AS std,
       CAST(min(tokens) AS DOUBLE) AS min, round(quantile_cont(tokens, 0.05), 6) AS p05,
       round(quantile_cont(tokens, 0.5), 6) AS p50, round(quantile_cont(tokens, 0.95), 6) AS p95,
       CAST(max(tokens) AS DOUBLE) AS max
FROM dt GROUP BY bin""",
    "corr_by_lang": f"""{_DOCS},
s AS (SELECT lang, count(*) AS n, sum(n_chars::DOUBLE) AS sx, sum(tokens::DOUBLE) AS sy,
             sum(n_chars::DOUBLE * n_chars) AS sxx, sum(tokens::DOUBLE * tokens) AS syy,
             sum(n_chars::DOUBLE * tokens) AS sxy FROM dt GROUP BY lang)
SELECT lang, n, round(CASE WHEN (sxx - sx * sx / n) <= 0 OR (syy - sy * sy / n) <= 0 THEN 0.0
                      ELSE (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END, 6)
       AS corr_n_chars_tokens FROM s""",
    "eval_grouping_sets": _EVAL_ROWS + "\nSELECT * FROM r",
    "melt_metrics": _EVAL_ROWS + """
SELECT category, site, metric, value FROM r
UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1))""",
    "eval_sets": _PAIRS + """,
t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM k)
SELECT tp, fp, fn,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(CASE WHEN coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0) = 0 THEN 0.0
        ELSE 2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0)
             / (coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0)) END, 6) AS f1,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS label_accuracy
FROM t""",
    "eval_exact": f"""WITH {_PAGE_LISTS}
SELECT round(avg(CASE WHEN list_sort(list_distinct(string_split(pred_title[1], ' ')))
                          = list_sort(list_distinct(string_split(truth_title[1], ' '))) THEN 1.0 ELSE 0.0 END), 6)
       AS exact_accuracy, count(*) AS n_samples
FROM pl""",
    "eval_samples": _PAIRS + """
SELECT round(avg(tp / nullif(tp + fp, 0)), 6) AS sample_precision,
       round(avg(tp / nullif(tp + fn, 0)), 6) AS sample_recall FROM k""",
    "eval_per_label": f"""WITH {_PAGE_LISTS},
t AS (SELECT DISTINCT page_id, unnest(ad_words) AS label FROM pl),
labels AS (SELECT DISTINCT label FROM t),
p AS (SELECT DISTINCT page_id, label FROM (SELECT page_id, unnest(nav) AS label FROM pl)
      WHERE label IN (SELECT label FROM labels)),
j AS (SELECT coalesce(t.page_id, p.page_id) AS page_id, coalesce(t.label, p.label) AS label,
             CASE WHEN t.label IS NULL THEN 0 ELSE 1 END AS tv, CASE WHEN p.label IS NULL THEN 0 ELSE 1 END AS pv
      FROM t FULL OUTER JOIN p ON t.page_id = p.page_id AND t.label = p.label),
a AS (SELECT label, CAST(sum(tv * pv) AS BIGINT) AS tp, CAST(sum((1 - tv) * pv) AS BIGINT) AS fp,
             CAST(sum(tv * (1 - pv)) AS BIGINT) AS fn FROM j GROUP BY label)
SELECT label, tp, fp, fn,
  round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(CASE WHEN coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0) = 0 THEN 0.0
        ELSE 2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0)
             / (coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0)) END, 6) AS f1
FROM a""",
    "missing_surplus": f"""WITH {_PAGE_LISTS}
SELECT page_id,
  array_to_string(list_sort(list_distinct(list_filter(ad_words, lambda x: NOT list_contains(nav, x)))), '|') AS missing,
  array_to_string(list_sort(list_distinct(list_filter(nav, lambda x: NOT list_contains(ad_words, x)))), '|') AS surplus
FROM pl""",
    "prefix_dedup": f"""
WITH p AS (SELECT DISTINCT {_SITE} AS site, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT site, path FROM p a
WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.site = a.site AND b.path <> a.path
                  AND starts_with(regexp_replace(a.path, '/+$', ''), b.path || '/'))""",
    "upsert_by_id": """
WITH c AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 2 AS VARCHAR) AS pair_id FROM conversations)
SELECT pair_id, role, text, 0 AS side FROM c l
WHERE turn % 2 = 0 AND NOT EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = l.conv_id AND r.turn = l.turn + 1 AND r.role = 'assistant')
UNION ALL
SELECT pair_id, role, text, 1 AS side FROM c WHERE turn % 2 = 1 AND role = 'assistant'""",
    "gt_overlay": f"""WITH {_CONV},
gt AS (SELECT conv_id, role AS field, list(text ORDER BY turn) AS vals FROM conversations
       WHERE role = 'user' AND turn >= 2 GROUP BY conv_id, role)
SELECT coalesce(cl.conv_id, gt.conv_id) AS conv_id, coalesce(cl.field, gt.field) AS field,
       array_to_string(coalesce(gt.vals, cl.vals), '\u241e') AS values, cl.cue_text
FROM cl FULL OUTER JOIN gt ON cl.conv_id = gt.conv_id AND cl.field = gt.field""",
    "gt_long_to_wide": f"""WITH {_CONV},
w AS (SELECT conv_id,
        coalesce(max(vals) FILTER (WHERE field = 'assistant'), []) AS assistant,
        coalesce(max(vals) FILTER (WHERE field = 'system'), []) AS system,
        coalesce(max(vals) FILTER (WHERE field = 'user'), []) AS "user"
      FROM cl GROUP BY conv_id)
SELECT conv_id, CAST(len(assistant) AS INTEGER) AS n_assistant, CAST(len(system) AS INTEGER) AS n_system,
       CAST(len("user") AS INTEGER) AS n_user,
       array_to_string(assistant, '\u241e') AS assistant, array_to_string(system, '\u241e') AS system,
       array_to_string("user", '\u241e') AS "user"
FROM w""",
}

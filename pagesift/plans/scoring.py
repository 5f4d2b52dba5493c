"""Metric summaries and small reports over the harness tables (E3, E11, E13, A5, P6,
P7, A10, A11, T28, X12), each with its SQL twin where one can be written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.operators import induce, metrics, stats, tables
from pagesift.operators.dom import subtree_stats
from pagesift.plans.common import keyed_nodes, keyed_pages, prepare
from pagesift.plans.harness import _CAT, _PAGE_LISTS, _SITE, _pairs, _tokens_sql
from pagesift.plans.pipeline import harness_annotations
from pagesift.plans.refinement import _seeded


def q_eval_label_summary(spark, d):
    """Micro, macro and subset accuracy over all labels."""
    prepare(spark)
    _, s = metrics.multilabel_report(_pairs(spark, d), ["page_id"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def q_eval_evaluator(spark, d):
    """The evaluator's form of the scores over all pages."""
    prepare(spark)
    tp, fp, fn = metrics.membership_counts(F.col("pred"), F.col("truth"))
    t = _pairs(spark, d).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    s = metrics.evaluator_scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return t.select("tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in s.items()])


def q_predictions_json(spark, d):
    """Prediction and truth of each page as JSON objects."""
    prepare(spark)
    rows = _pairs(spark, d).withColumn("field", F.lit("nav"))
    return metrics.predictions_json(rows, ["page_id"])


def q_group_counts(spark, d):
    """A5: how many (category, site) groups and sites there are."""
    prepare(spark)
    p = keyed_pages(spark, d)
    return p.agg(F.count_distinct(F.struct("category", "site")).alias("n_groups"), F.count_distinct("site").alias("n_sites"))


def q_imperfect_pages(spark, d):
    """P6 + P7: pages of at least 500 raw tokens whose match rate is below one."""
    prepare(spark)
    from pagesift.functions.text import token_count
    tp, _, fn = metrics.membership_counts(F.col("pred"), F.col("truth"))
    rows = _pairs(spark, d).select("page_id", stats.ratio(tp, tp + fn).alias("match_rate"))
    size = keyed_pages(spark, d).select("page_id", token_count("html").alias("raw_tokens"))
    rows = rows.join(size, "page_id")
    return stats.imperfect(stats.in_grid(rows, raw_tokens=(500, None)), "match_rate").select(
        "page_id", F.round("match_rate", 6).alias("match_rate"), "raw_tokens")


def q_subtree_stats(spark, d):
    """A10 + A11: sums and maxima of every page's tree, at its root."""
    prepare(spark)
    s = subtree_stats(keyed_nodes(spark, d).filter("tag <> '#comment'"))
    return s.filter("parent_id = -1").select("page_id", "n_desc", "sub_text_tokens", "max_depth", "n_leaves", "max_text_tokens", "max_width")


def q_list_triage(spark, d):
    """Each page's lists triaged by the annotated values they hold."""
    prepare(spark)
    nodes = keyed_nodes(spark, d)
    forest = tables.table_forest(nodes, with_content=False, tag="ul")
    ann = harness_annotations(keyed_pages(spark, d)).filter("field = 'nav'")
    return tables.triage_tables(nodes, forest, ann).select("page_id", "xpath", "operator_type")


def q_best_by_coverage(spark, d):
    """Per (site, field) the candidate that finds something on most pages."""
    prepare(spark)
    from pagesift.operators.xpath import apply_programs
    nodes, ann, seeds = _seeded(spark, d)
    progs = induce.seed_programs(induce.candidate_programs(nodes, ann, induce.EXTRACT), seeds, ["site"]).select(
        "site", "field", "program").distinct().checkpoint(eager=True)
    res = apply_programs(nodes, progs, ["site"], ["field"], "program", None)
    return induce.best_by_seed_coverage(res, ["site"]).select("site", "field", "program", "n_pages")


SCORING_QUERIES = {
    "eval_label_summary": q_eval_label_summary,
    "eval_evaluator": q_eval_evaluator,
    "predictions_json": q_predictions_json,
    "group_counts": q_group_counts,
    "imperfect_pages": q_imperfect_pages,
    "subtree_stats": q_subtree_stats,
    "list_triage": q_list_triage,
    "best_by_coverage": q_best_by_coverage,
}

_COUNTS = f"""WITH {_PAGE_LISTS},
k AS (SELECT page_id, len(list_filter(nav, lambda x: list_contains(ad_words, x))) AS tp,
             len(list_filter(nav, lambda x: NOT list_contains(ad_words, x))) AS fp,
             len(list_filter(ad_words, lambda x: NOT list_contains(nav, x))) AS fn FROM pl)"""

SCORING_ORACLE = {
    "eval_label_summary": f"""WITH {_PAGE_LISTS},
t AS (SELECT DISTINCT page_id, unnest(ad_words) AS label FROM pl),
p AS (SELECT DISTINCT page_id, label FROM (SELECT page_id, unnest(nav) AS label FROM pl)
      WHERE label IN (SELECT label FROM t)),
j AS (SELECT coalesce(t.page_id, p.page_id) AS page_id, coalesce(t.label, p.label) AS label,
             (t.label IS NOT NULL)::INT AS tv, (p.label IS NOT NULL)::INT AS pv
      FROM t FULL OUTER JOIN p ON t.page_id = p.page_id AND t.label = p.label),
a AS (SELECT sum(tv * pv) AS tp, sum((1 - tv) * pv) AS fp, sum(tv * (1 - pv)) AS fn FROM j GROUP BY label),
s AS (SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM a),
m AS (SELECT sum(tp) / (sum(tp) + sum(fp)) AS mp, sum(tp) / (sum(tp) + sum(fn)) AS mr, avg(p) AS ap, avg(r) AS ar,
             avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) AS af FROM s),
b AS (SELECT count(DISTINCT page_id) AS bad FROM j WHERE tv <> pv)
SELECT round(mp, 6) AS micro_precision, round(mr, 6) AS micro_recall, round(2 * mp * mr / (mp + mr), 6) AS micro_f1,
       round(ap, 6) AS macro_precision, round(ar, 6) AS macro_recall, round(af, 6) AS macro_f1,
       round(1.0 - bad / (SELECT count(*) FROM pl), 6)::DOUBLE AS subset_accuracy FROM m, b""",
    "eval_evaluator": _COUNTS + """,
t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM k)
SELECT tp, fp, fn, round(tp / (tp + fp + 1e-8), 6) AS precision, round(tp / (tp + fn + 1e-8), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn + 1e-8), 6) AS f1 FROM t""",
    "group_counts": f"""
SELECT count(DISTINCT {_CAT} || '/' || {_SITE}) AS n_groups, count(DISTINCT {_SITE}) AS n_sites FROM pages""",
    "predictions_json": f"""WITH {_PAGE_LISTS}
SELECT page_id, CAST(to_json({{'nav': nav}}) AS VARCHAR) AS prediction, CAST(to_json({{'nav': ad_words}}) AS VARCHAR) AS ground_truth
FROM pl""",
    "list_triage": """
SELECT page_id, '/html/body/nav/ul' AS xpath, 'extract' AS operator_type FROM pages WHERE html LIKE '%<ul>%'""",
}
# match rate: found truths among all truths
SCORING_ORACLE["imperfect_pages"] = _COUNTS + f"""
SELECT k.page_id, round(tp / nullif(tp + fn, 0), 6) AS match_rate, {_tokens_sql('html')} AS raw_tokens
FROM k JOIN pages ON pages.page_id = k.page_id
WHERE tp / nullif(tp + fn, 0) < 1 AND {_tokens_sql('html')} >= 500"""

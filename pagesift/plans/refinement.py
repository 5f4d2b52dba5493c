"""Programs from seed compositions and feedback rounds, condensed snippets, budget
pruning (J16, X16, X8, X10, W5, W9, T13) over the harness ``pages``.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions.text import token_count
from pagesift.operators import clean, induce, prune, sampling
from pagesift.plans.common import keyed_nodes, keyed_pages, prepare
from pagesift.plans.pipeline import harness_annotations

N_SEEDS = 3


def _seeded(spark, d):
    """Nodes and annotations of the seed pages, and (page_id, site, pos)."""
    pages = keyed_pages(spark, d)
    seeds, _ = sampling.split_seeds(pages.select("page_id", "site"), ["site"], N_SEEDS)
    order = Window.partitionBy("site").orderBy(F.md5(F.concat(F.col("page_id").cast("string"), F.lit("#0"))), "page_id")
    seeds = seeds.select("page_id", "site").withColumn("pos", F.row_number().over(order) - 1).checkpoint(eager=True)
    ids = seeds.select("page_id")
    nodes = keyed_nodes(spark, d).join(ids, "page_id", "left_semi")
    return nodes, harness_annotations(pages).join(ids, "page_id", "left_semi").checkpoint(eager=True), seeds


def q_seed_compositions(spark, d):
    """J16 + X16 + X11: the best program of every single seed, pair and triple per
    (site, field), scored on all seeds of the site."""
    prepare(spark)
    nodes, ann, seeds = _seeded(spark, d)
    cands = induce.candidate_programs(nodes, ann, induce.EXTRACT)
    progs = induce.seed_programs(cands, seeds, ["site"], N_SEEDS).checkpoint(eager=True)
    scored = induce.score_programs(nodes, progs.select("site", "field", "program").distinct(), ann, ["site"])
    rows = progs.drop("last").join(scored, ["site", "field", "program"])
    best = Window.partitionBy("site", "field", "composition").orderBy(F.desc("f1"), F.desc("n_extracted"), "program")
    return (rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
            .select("site", "field", "composition", "program", "tp", "fp", "fn", "n_extracted"))


def q_program_feedback(spark, d):
    """X9 + X10 + W5 + O7: programs refined by feedback for at most three rounds, then
    the feedback-based choice per (site, field), with the round it came from."""
    prepare(spark)
    nodes, ann, seeds = _seeded(spark, d)
    tried, fb = induce.refine(nodes, seeds, ann, ["site"])
    return induce.select_best(tried, fb, ["site"]).select("site", "field", "program", "try_seq", "bad", "empty", "n_fb")


def q_condensed_snippets(spark, d):
    """Each seed page condensed around the nodes of each field's values, with the
    title as the cue of the other fields."""
    prepare(spark)
    nodes, ann, _ = _seeded(spark, d)
    found = induce.matched_chunks(nodes, ann).checkpoint(eager=True)
    cue = found.filter("field = 'title'").select("page_id", "node_id")
    cues = found.select("page_id", "field").distinct().filter("field <> 'title'").join(cue, "page_id")
    out = prune.condensed_snippets(nodes, found, cues)
    return out.select("page_id", "field", "n_targets", "n_cues", "n_nodes", token_count(F.col("html")).alias("html_tokens"))


def q_budget_prune(spark, d):
    """Every light-sanitized page cut to 256 tokens, what is left of it."""
    prepare(spark)
    nodes = clean.sanitize(keyed_nodes(spark, d), "light").checkpoint(eager=True)
    kept = prune.prune_by_budget(nodes, 256)
    size = clean.serialized_tokens(kept)
    return kept.groupBy("page_id").agg(F.count("*").alias("n_kept"), F.max("node_id").alias("last_node")).join(size, "page_id")


REFINEMENT_QUERIES = {
    "seed_compositions": q_seed_compositions,
    "program_feedback": q_program_feedback,
    "condensed_snippets": q_condensed_snippets,
    "budget_prune": q_budget_prune,
}

# the harness's seeds with what each field's values are on them
_SEEDS = r"""
WITH s AS (
  SELECT page_id, site, html, row_number() OVER (PARTITION BY site ORDER BY md5(CAST(page_id AS VARCHAR) || '#0'), page_id) - 1 AS pos
  FROM (SELECT page_id, html, regexp_extract(url, '://([^/]+)', 1) AS site FROM pages)),
v AS (
  SELECT site, pos, unnest([
    {'field': 'title', 'program': '/html/body/article/h1',
     'n': CASE WHEN regexp_extract(html, '(?s)<title>(.*?)</title>', 1) <> '' THEN 1 ELSE 0 END},
    {'field': 'nav', 'program': '/html/body/nav/ul/li/a',
     'n': len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1))},
    {'field': 'ad', 'program': '/html/body/div',
     'n': CASE WHEN regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) <> '' THEN 1 ELSE 0 END}]) AS f
  FROM s WHERE pos < 3),
n AS (SELECT site, pos, f.field AS field, f.program AS program, f.n AS n FROM v),
t AS (SELECT site, field, program, CAST(sum(n) AS BIGINT) AS tp FROM n GROUP BY ALL)
"""
REFINEMENT_ORACLE = {
    # every composition of seeds that have the field gives the program that finds all
    "seed_compositions": _SEEDS + r""",
c AS (SELECT unnest([[0], [1], [2], [0, 1], [0, 2], [1, 2], [0, 1, 2]]) AS c),
h AS (SELECT site, field, list(pos) FILTER (n > 0) AS have FROM n GROUP BY ALL)
SELECT t.site, t.field, array_to_string(c, '+') AS composition, t.program, t.tp, 0::BIGINT AS fp, 0::BIGINT AS fn,
       t.tp AS n_extracted
FROM t JOIN h ON h.site = t.site AND h.field = t.field JOIN c ON list_has_all(h.have, c)""",
    # the first program has no feedback, so no round follows and it wins
    "program_feedback": _SEEDS + r"""
SELECT site, field, program, 1 AS try_seq, 0 AS bad, 0 AS empty, 0::BIGINT AS n_fb FROM t WHERE tp > 0""",
}

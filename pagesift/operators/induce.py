"""Wrapper induction: candidate programs from annotated seeds, scoring and
selection (X4-X12, X16, W4, W5, W7, W8, A13, F11, F18).

Annotations arrive as a table ``(page_id, field, values)`` - ground truth or
any batch-inference output. Candidates come from the static generator (text
search over the seed pages' text chunks), are scored on the seeds by applying
them with :func:`pagesift.operators.xpath.apply_programs`, and the best per
(site, field) is chosen with a window. All steps are joins, windows and
aggregates keyed by page or (site, field).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.text import non_empty, normalize_text
from pagesift.functions.xpath_steps import aligned, last_test, strip_positions
from pagesift.operators.dom import texts
from pagesift.operators.metrics import guarded_f1, membership_counts
from pagesift.operators.textsearch import one_line, text_matches
from pagesift.operators.xpath import apply_programs

# generator profiles
INFER = dict(text_suffix=True, short=True, with_id=True, with_class=True)
EXTRACT = dict(text_suffix=False, short=False, with_id=False, with_class=False)


def predicate_text(attrs: Column, with_id: bool, with_class: bool) -> Column:
    """``[@id="x"]`` wins over ``[@class="y"]``; empty when neither applies."""
    out = F.lit("")
    if with_class:
        out = F.when(attrs["class"].isNotNull(),
                     F.concat(F.lit('[@class="'), attrs["class"], F.lit('"]'))).otherwise(out)
    if with_id:
        out = F.when(attrs["id"].isNotNull(),
                     F.concat(F.lit('[@id="'), attrs["id"], F.lit('"]'))).otherwise(out)
    return out


def node_steps(nodes: DataFrame, with_id: bool = True, with_class: bool = True) -> DataFrame:
    """One path step per element: tag, predicate, and an index when more
    than one sibling shares tag and predicate."""
    el = nodes.filter(F.col("tag") != "#comment").select(
        "page_id", "node_id", "parent_id", "child_ord", "tag",
        predicate_text(F.col("attrs"), with_id, with_class).alias("pred"),
        F.col("attrs")["id"].isNotNull().alias("has_id"))
    w = Window.partitionBy("page_id", "parent_id", "tag", "pred")
    el = el.withColumn("k", F.row_number().over(w.orderBy("child_ord"))).withColumn(
        "n", F.count(F.lit(1)).over(w))
    step = F.when(F.col("parent_id") < 0, F.col("tag")).otherwise(F.concat(
        F.col("tag"), F.col("pred"),
        F.when(F.col("n") > 1, F.concat(F.lit("["), F.col("k"), F.lit("]"))).otherwise(F.lit(""))))
    return el.select("page_id", "node_id", step.alias("step"),
                     (F.col("has_id") & (F.col("parent_id") >= 0)).alias("has_id"))


def node_xpaths(nodes: DataFrame, targets: DataFrame, short: bool = True, with_id: bool = True,
                with_class: bool = True) -> DataFrame:
    """X5 for the target nodes ``(page_id, node_id)``: explode their ancestors,
    join the step table, assemble in depth order. ``short`` starts the path at
    the nearest ancestor-or-self with an id (``//tag[@id="x"]/...``)."""
    steps = node_steps(nodes.join(targets.select("page_id").distinct(), "page_id", "left_semi"),
                       with_id, with_class)
    t = targets.select("page_id", "node_id").distinct().join(
        nodes.select("page_id", "node_id", "anc_ids"), ["page_id", "node_id"])
    ex = t.select("page_id", "node_id", F.posexplode("anc_ids").alias("d", "anc_id"))
    ex = ex.join(steps.withColumnRenamed("node_id", "anc_id"), ["page_id", "anc_id"])
    g = ex.groupBy("page_id", "node_id").agg(
        F.sort_array(F.collect_list(F.struct("d", "step", "has_id"))).alias("s"))
    start = F.lit(0)
    if short:
        start = F.coalesce(F.array_max(F.transform(
            "s", lambda x: F.when(x.has_id, x.d))), F.lit(0))
    body = F.array_join(F.transform(F.filter("s", lambda x: x.d >= start), lambda x: x.step), "/")
    return g.select("page_id", "node_id", F.concat(
        F.when(start > 0, F.lit("//")).otherwise(F.lit("/")), body).alias("xpath"))


def targets_from_annotations(ann: DataFrame) -> DataFrame:
    """(page_id, field, values) -> (page_id, field, target) with normalized,
    non-empty targets (P3)."""
    values = ann.select("page_id", "field", F.explode("values").alias("value"))
    return non_empty(values, ["page_id", "field"], normalize_text(F.col("value")), "target").distinct()


def matched_chunks(nodes: DataFrame, ann: DataFrame) -> DataFrame:
    """X4 text search: for each (page, field, target) the text chunks that
    contain the target or are contained in it, white space runs counting as one
    space, keeping all at the smallest length gap (W8, F18). Columns: page_id,
    field, target, node_id, idx."""
    tg = targets_from_annotations(ann).withColumn("t_norm", one_line(F.col("target"))).filter(F.col("t_norm") != "")
    pages = tg.select("page_id").distinct()
    tx = texts(nodes.join(pages, "page_id", "left_semi")).withColumn("n_chars", F.length("text"))
    tx = non_empty(tx, ["page_id", "node_id", "idx", "n_chars"], one_line(normalize_text(F.col("text"))), "norm")
    j = text_matches(tx, tg, ["page_id"], both_ways=True)
    j = j.withColumn("score", F.abs(F.col("n_chars") - F.length("target")))
    w = Window.partitionBy("page_id", "field", "target")
    j = j.withColumn("best", F.min("score").over(w)).filter(F.col("score") == F.col("best"))
    return j.select("page_id", "field", "target", "node_id", "idx")


def candidate_programs(nodes: DataFrame, ann: DataFrame, profile: dict | None = None,
                       profiles: list[dict] | None = None, matched: DataFrame | None = None) -> DataFrame:
    """X4 + X5 + X6: programs for the matched chunks under each generator
    profile (node path, plus ``/text()[i]`` in the infer profile). The text
    search runs once for all profiles."""
    profiles = profiles or [profile or INFER]
    j = matched if matched is not None else matched_chunks(nodes, ann)
    out = None
    for prof in profiles:
        xp = node_xpaths(nodes, j.select("page_id", "node_id"), prof["short"], prof["with_id"],
                         prof["with_class"])
        c = j.join(xp, ["page_id", "node_id"])
        prog = F.col("xpath")
        if prof["text_suffix"]:
            prog = F.concat(prog, F.when(F.col("idx") > 1, F.concat(
                F.lit("/text()["), F.col("idx"), F.lit("]"))).otherwise(F.lit("/text()")))
        c = c.select("page_id", "field", "target", prog.alias("program"))
        out = c if out is None else out.unionByName(c)
    return out


def generalize(programs: DataFrame) -> DataFrame:
    """Index-free variant of each positional candidate (``li[2]`` -> ``li``),
    so one program can cover a repeated field (U8-style widening)."""
    return programs.unionByName(programs.withColumn("program", strip_positions(F.col("program"))))


# ---- J16 / X16: programs from single seeds, pairs and triples -------------------
def compositions(n: int = 3) -> list[tuple[int, ...]]:
    """Seed combinations: singles, pairs and so on up to all ``n``."""
    return [c for k in range(1, n + 1) for c in combinations(range(n), k)]


def seed_programs(cands: DataFrame, seeds: DataFrame, keys: list[str], n_seeds: int = 3) -> DataFrame:
    """J16 + X16: one program per (keys, field, last tag, composition) of seeds.

    ``cands``: (page_id, field, program); ``seeds``: (page_id, keys, pos), pos from
    0. A seed's programs that end in the same tag are aligned to one; so the work
    grows with the seeds' values, not with pairs of them. Then each composition's
    programs are aligned; a composition without a common program is left out.
    Columns: keys, field, last, composition (``0+2``), program."""
    own = (cands.select("page_id", "field", "program").distinct().join(seeds.select("page_id", *keys, "pos"), "page_id")
           .withColumn("last", last_test(F.col("program")))
           .groupBy(*keys, "field", "last", "pos").agg(F.sort_array(F.collect_set("program")).alias("ps"))
           .withColumn("program", aligned(F.col("ps"))).filter("program IS NOT NULL"))
    rows = own.groupBy(*keys, "field", "last").agg(F.map_from_entries(F.collect_list(F.struct("pos", "program"))).alias("of"))
    each = F.array(*[F.struct(F.lit("+".join(map(str, c))).alias("composition"),
                              F.array(*[F.try_element_at("of", F.lit(p)) for p in c]).alias("ps")) for c in compositions(n_seeds)])
    rows = rows.select(*keys, "field", "last", F.explode(each).alias("c")).select(*keys, "field", "last", "c.*")
    rows = rows.filter(~F.exists("ps", lambda p: p.isNull()))
    return rows.withColumn("program", aligned(F.col("ps"))).filter("program IS NOT NULL").drop("ps")


def score_programs(nodes: DataFrame, cands: DataFrame, ann: DataFrame, keys: list[str]) -> DataFrame:
    """A13 + E1 + E6: apply every candidate to the seed pages of its site and
    total tp/fp/fn and extracted values per (keys, field, program)."""
    res = apply_programs(nodes, cands.select(*keys, "field", "program").distinct(), keys,
                         ["field"], "program", None)
    truth = ann.select("page_id", "field", F.col("values").alias("truth"))
    r = res.join(truth, ["page_id", "field"], "left")
    tp, fp, fn = membership_counts(F.col("values"), F.col("truth"))
    agg = r.groupBy(*keys, "field", "program").agg(
        F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"),
        F.sum(F.size("values")).alias("n_extracted"), F.max(F.col("invalid").cast("int")).alias("invalid"))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + F.lit(1e-6))
    rc = F.col("tp") / (F.col("tp") + F.col("fn") + F.lit(1e-6))
    return agg.withColumn("f1", guarded_f1(p, rc))


def best_by_f1(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, field) highest f1, then most extracted, then program."""
    w = Window.partitionBy(*keys, "field").orderBy(F.desc("f1"), F.desc("n_extracted"), "program")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def best_by_seed_coverage(scored_pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by the number of seed pages with at least one extracted value."""
    g = scored_pages.groupBy(*keys, "field", "program").agg(
        F.count_if(F.size("values") > 0).alias("n_pages"))
    w = Window.partitionBy(*keys, "field").orderBy(F.desc("n_pages"), "program")
    return g.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def refine(nodes: DataFrame, seeds: DataFrame, ann: DataFrame, keys: list[str], rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Programs derived from the feedback on the last ones, at most
    ``rounds`` times; each round looks only at what the one before it brought.

    First come the programs of a site's first seed that has the field. A program that
    misses values on a seed is aligned with the paths of these values there; one that
    only adds values gives way to the paths with ids and classes of that seed. A
    program that was tried before is not tried again. ``seeds``: (page_id, keys, pos).
    Returns (tried: keys, field, program, try_seq; feedback rows with keys)."""
    matched = matched_chunks(nodes, ann).checkpoint(eager=True)
    of = lambda profile: candidate_programs(nodes, ann, profiles=[profile], matched=matched).checkpoint(eager=True)
    plain, exact = of(EXTRACT), of(INFER)
    single = seed_programs(plain, seeds, keys).filter(~F.contains("composition", F.lit("+")))
    first = F.min("composition").over(Window.partitionBy(*keys, "field"))
    new = single.withColumn("_first", first).filter("composition = _first").select(*keys, "field", "program").distinct()
    tried = fbs = None
    for r in range(rounds + 1):
        new = new.withColumn("try_seq", F.lit(r + 1)).checkpoint(eager=True)
        res = apply_programs(nodes, new.drop("try_seq"), keys, ["field"], "program", None)
        fb = feedback(res, ann).join(seeds.select("page_id", *keys), "page_id").checkpoint(eager=True)
        tried = new if tried is None else tried.unionByName(new)
        fbs = fb if fbs is None else fbs.unionByName(fb)
        if r == rounds or fb.isEmpty():
            break
        g = [*keys, "field", "program", "page_id"]
        missed = (fb.select(*g, F.explode("missing").alias("v")).withColumn("target", normalize_text(F.col("v")))
                  .join(plain.select("page_id", "field", "target", F.col("program").alias("path")), ["page_id", "field", "target"])
                  .withColumn("same", last_test(F.col("program")) == last_test(F.col("path"))))
        wider = missed.filter("same").groupBy(*g).agg(F.sort_array(F.collect_set("path")).alias("paths")).select(
            *keys, "field", aligned(F.concat(F.array("program"), "paths")).alias("program"))
        other = missed.filter("NOT same").select(*keys, "field", F.col("path").alias("program"))
        narrow = fb.filter(F.size("missing") == 0).select(*keys, "field", "page_id").join(
            exact.select("page_id", "field", "program"), ["page_id", "field"]).select(*keys, "field", "program")
        new = (wider.unionByName(other).unionByName(narrow).filter("program IS NOT NULL").distinct()
               .join(tried.select(*keys, "field", "program"), [*keys, "field", "program"], "left_anti"))
    return tried, fbs


def feedback(results: DataFrame, ann: DataFrame) -> DataFrame:
    """One row per (page, field, program) that misses or adds values, only
    for pages annotated with values for the field; ``invalid`` programs too."""
    truth = ann.filter(F.size("values") > 0).select("page_id", "field", F.col("values").alias("truth"))
    r = results.join(truth, ["page_id", "field"])
    missing = F.array_except(F.col("truth"), F.col("values"))
    surplus = F.array_except(F.col("values"), F.col("truth"))
    r = r.withColumn("missing", missing).withColumn("surplus", surplus)
    msg = F.concat_ws(", ",
                      F.when(F.size("missing") > 0, F.concat(F.lit("Missing: "), F.to_json("missing"))),
                      F.when(F.size("surplus") > 0, F.concat(F.lit("Surplus: "), F.to_json("surplus"))),
                      F.when(F.col("invalid"), F.concat(F.lit("Invalid XPath: "), F.col("program"))))
    return r.filter((F.size("missing") > 0) | (F.size("surplus") > 0)).select(
        "page_id", "field", "program", F.col("values").alias("extracted"), "truth", "missing",
        "surplus", "invalid", msg.alias("message"))


def select_best(tried: DataFrame, fb: DataFrame, keys: list[str]) -> DataFrame:
    """W5 / X10 over all tried programs ``(keys, field, program, try_seq)``:
    drop programs with an invalid feedback; a single survivor wins; then drop
    programs with a feedback row that extracted nothing; then fewest values
    in feedback rows (no feedback = 0) wins, ties by try order. Fallback: the
    first valid, else the first tried."""
    f = fb.groupBy("field", "program", *[k for k in keys if k in fb.columns]).agg(
        F.max(F.col("invalid").cast("int")).alias("bad"),
        F.max((F.size("extracted") == 0).cast("int")).alias("empty"),
        F.sum(F.size("extracted")).alias("n_fb"))
    t = tried.join(f, [c for c in ["field", "program"] + keys if c in f.columns], "left").fillna(
        0, ["bad", "empty", "n_fb"])
    w = Window.partitionBy(*keys, "field")
    t = t.withColumn("n_valid", F.sum(1 - F.col("bad")).over(w)).withColumn(
        "n_full", F.sum(((F.col("bad") == 0) & (F.col("empty") == 0)).cast("int")).over(w))
    order = Window.partitionBy(*keys, "field").orderBy(
        F.col("bad"),
        F.when(F.col("n_valid") <= 1, F.lit(0)).otherwise(F.col("empty")),
        F.when((F.col("n_valid") <= 1) | (F.col("n_full") == 0), F.lit(0)).otherwise(F.col("n_fb")),
        F.col("try_seq"), F.col("program"))
    return t.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop(
        "rank", "n_valid", "n_full")

"""Seed compositions, feedback rounds, snippets, budget prune, sweep, salted joins,
table functions."""

import random

import pytest
from pyspark.sql import functions as F

from pagesift.functions import udtfs
from pagesift.functions.xpath_steps import align, align_all, format_steps, parse_steps, without_positions
from pagesift.operators import clean, fragments, induce, prune
from pagesift.operators.dom import explode_dom, texts
from pagesift.operators.xpath import apply_programs


def test_steps_respect_quotes():
    p = '//div[@id="a/[1]"]/li[2][@class=\'x]\']/text()[2]'
    assert format_steps(parse_steps(p)) == p
    assert without_positions(p) == '//div[@id="a/[1]"]/li[@class=\'x]\']/text()[2]'
    assert parse_steps("/a | /b") is None and parse_steps("/a[1") is None and without_positions("/a | /b[2]") == "/a | /b[2]"


def test_alignment():
    assert align("/html/body/div[1]/p", "/html/body/div[2]/p") == "/html/body/div/p"
    assert align("/html/body/div[1]/p[3]", "/html/body/div[1]/section/p[3]") == "/html/body/div[1]//p[3]"
    assert align("/html/head/title", "/html/body/h1") is None
    assert align_all(["/a/b[1]/c", "/a/b[2]/c", "/a/d/c"]) == "/a//c"
    assert align('//ul[@id="x"]/li[1]/text()', '//ul[@id="x"]/li[4]/text()') == '//ul[@id="x"]/li/text()'


def test_aligned_programs_cover_both(spark):
    """On random trees the aligned program selects what either program selects."""
    r = random.Random(4)
    tags = ["div", "section", "span"]

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}x{r.randrange(99)}</{t}>" for t in r.choices(tags, k=r.randint(1, 3))) if depth else ""

    pages = spark.createDataFrame([(i, "s", f"<html><body>{tree(4)}</body></html>") for i in range(4)],
                                  "page_id long, site string, html string")
    nodes = explode_dom(pages, keep=["site"]).checkpoint(eager=True)
    paths = sorted({n.xpath for n in nodes.filter("depth > 2").select("xpath").collect()})
    pairs = [(a, b, align(a, b)) for a, b in (r.sample(paths, 2) for _ in range(60))]
    pairs = [p for p in pairs if p[2]]
    assert len(pairs) > 10
    progs = spark.createDataFrame([("s", p) for p in {x for t in pairs for x in t}], "site string, program string")
    res = apply_programs(nodes, progs, ["site"], [], "program", None).collect()
    got = {(x.page_id, x.program): x["values"] for x in res}
    for a, b, c in pairs:
        for page in range(4):
            for v in got.get((page, a), []) + got.get((page, b), []):
                assert v in got[page, c], (a, b, c)


@pytest.fixture
def site(spark):
    """Three seeds: the price sits at another place on each."""
    html = ["<html><body><div><p>Name</p><p class='price'>10</p></div></body></html>",
            "<html><body><div><p>Name</p><p>old</p><p class='price'>20</p></div></body></html>",
            "<html><body><div><section><p>Name</p><p class='price'>30</p></section></div></body></html>"]
    pages = spark.createDataFrame([(i, "s", h) for i, h in enumerate(html)], "page_id long, site string, html string")
    nodes = explode_dom(pages, keep=["site"]).checkpoint(eager=True)
    ann = spark.createDataFrame([(i, "price", [str(10 * (i + 1))]) for i in range(3)], "page_id long, field string, values array<string>")
    seeds = spark.createDataFrame([(i, "s", i) for i in range(3)], "page_id long, site string, pos int")
    return nodes, ann, seeds


def test_seed_compositions(site):
    nodes, ann, seeds = site
    rows = induce.seed_programs(induce.candidate_programs(nodes, ann, induce.EXTRACT), seeds, ["site"]).collect()
    got = {r.composition: r.program for r in rows}
    assert got == {"0": "/html/body/div/p[2]", "1": "/html/body/div/p[3]", "2": "/html/body/div/section/p[2]",
                   "0+1": "/html/body/div/p", "0+2": "/html/body/div//p[2]", "1+2": "/html/body/div//p", "0+1+2": "/html/body/div//p"}


def test_refinement_rounds(site):
    nodes, ann, seeds = site
    tried, fb = induce.refine(nodes, seeds, ann, ["site"])
    rounds = {r.program: r.try_seq for r in tried.collect()}
    assert rounds["/html/body/div/p[2]"] == 1 and max(rounds.values()) <= 4
    # too narrow, then too wide, then by its class
    assert rounds["/html/body/div/p"] == 2 and rounds["/html/body/div//p[2]"] == 2
    assert any('[@class="price"]' in p for p in rounds)
    best = induce.select_best(tried, fb, ["site"]).collect()
    again, fb2 = induce.refine(nodes, seeds, ann, ["site"])
    assert len(best) == 1 and best[0].bad == 0
    assert [r.program for r in induce.select_best(again, fb2, ["site"]).collect()] == [best[0].program]
    assert len(rounds) == tried.count()   # nothing is tried twice


def test_budget_prune_equals_the_walk(spark):
    """Against the walk from the root down, node by node."""
    r = random.Random(9)

    def tree(depth):
        return "".join(f"<div>{'w ' * r.randint(0, 4)}{tree(depth - 1)}</div>{'t ' * r.randint(0, 2)}"
                       for _ in range(r.randint(0, 4))) if depth else ""

    pages = spark.createDataFrame([(i, f"<html><body>{tree(5)}</body></html>") for i in range(12)], "page_id long, html string")
    nodes = explode_dom(pages).checkpoint(eager=True)
    sizes = {(x.page_id, x.node_id): (x.own, x.sub_tokens) for x in prune.subtree_tokens(nodes).collect()}
    rows = nodes.select("page_id", "node_id", "parent_id", "child_ord").collect()
    for budget in (0, 12, 60, 150, 10 ** 6):
        want = set()
        for page in range(12):
            kids = {}
            for x in sorted((x for x in rows if x.page_id == page), key=lambda x: x.child_ord):
                kids.setdefault(x.parent_id, []).append(x.node_id)
            stack = [(kids[-1][0], budget)]
            while stack:
                n, left = stack.pop()
                want.add((page, n))
                own, total = sizes[page, n]
                req, spent = left - own, 0
                for k, c in enumerate(kids.get(n, [])):
                    if total > left and k and spent > req:
                        break
                    stack.append((c, left - own - spent if total > left else 10 ** 9))
                    spent += sizes[page, c][1]
        kept = prune.prune_by_budget(nodes, budget)
        assert {(x.page_id, x.node_id) for x in kept.select("page_id", "node_id").collect()} == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 2


def test_virtual_tree_and_snippets(spark):
    r = random.Random(5)

    def tree(depth):
        return "".join(f"<div>{'v' if r.random() < .3 else ''}{tree(depth - 1)}</div>" for _ in range(r.randint(1, 3))) if depth else ""

    pages = spark.createDataFrame([(i, f"<html><body>{tree(4)}</body></html>") for i in range(6)], "page_id long, html string")
    nodes = explode_dom(pages).checkpoint(eager=True)
    anc = {(x.page_id, x.node_id): x.anc_ids for x in nodes.select("page_id", "node_id", "anc_ids").collect()}
    members = {(p, f): r.sample([n for q, n in anc if q == p], 4) for p in range(6) for f in "ab"}
    m = spark.createDataFrame([(p, f, n) for (p, f), ns in members.items() for n in ns], "page_id long, field string, node_id int")
    tree_rows = prune.virtual_tree(nodes, m, ["field"]).collect()
    kept = prune.snippet_nodes(nodes, m, ["field"]).collect()
    for (p, f), ns in members.items():
        common = lambda a, b: max(set(anc[p, a]) & set(anc[p, b]))
        want = set(ns) | {common(a, b) for a in ns for b in ns}
        got = {x.node_id: x.parent for x in tree_rows if x.page_id == p and x.field == f}
        assert set(got) == want
        assert all(up == max((set(anc[p, n]) - {n}) & want, default=None) for n, up in got.items())
        # between the root of the tree and its members: the union of pairwise paths
        top = min(want)
        paths = {x for a in ns for b in ns for x in set(anc[p, a]) ^ set(anc[p, b])} | {common(a, b) for a in ns for b in ns} | set(ns)
        spine = {x.node_id for x in kept if x.page_id == p and x.field == f and x.role == "spine"}
        assert {n for n in spine if n >= top} == paths and {n for n in spine if n < top} == set(anc[p, top]) - {top}
        for x in kept:
            if x.page_id == p and x.field == f and x.role != "spine":
                inside = bool((set(x.anc_ids) - {x.node_id}) & set(ns))
                assert (x.role == "inside") == inside and (inside or x.parent_id in spine)


def test_condensed_snippets(spark):
    html = ("<html><body><div class='k'><p>name</p><p>42</p></div><div><b>label</b><i>far away</i></div>"
            "<ul><li>noise</li></ul></body></html>")
    nodes = explode_dom(spark.createDataFrame([(1, html)], "page_id long, html string")).checkpoint(eager=True)
    at = {x.xpath: x.node_id for x in nodes.collect()}
    t = spark.createDataFrame([(1, "n", at["/html/body/div[1]/p[2]"])], "page_id long, field string, node_id int")
    c = spark.createDataFrame([(1, "n", at["/html/body/div[2]/b"]), (1, "other", 1)], "page_id long, field string, node_id int")
    with_cue = prune.condensed_snippets(nodes, t, c).collect()
    without = prune.condensed_snippets(nodes, t).collect()
    assert len(with_cue) == len(without) == 1
    assert with_cue[0].n_cues == 1 and without[0].n_cues == 0
    assert "<b>label</b>" in with_cue[0].html and "label" not in without[0].html
    for x in (with_cue[0].html, without[0].html):
        assert '<div class="k">' in x and "42" in x and "<p>...</p>" in x and "noise" not in x and "far away" not in x


def test_sweep_sizes_equal_serialization(spark):
    r = random.Random(6)
    body = lambda: "".join(f"<section class='s{i}'>lead <p>{'word ' * r.randint(5, 60)}</p> tail {i}</section> after "
                           for i in range(r.randint(2, 7)))
    pages = spark.createDataFrame([(i, f"<html><body><div>{body()}</div>{body()}</body></html>") for i in range(4)],
                                  "page_id long, html string")
    nodes = clean.sanitize(explode_dom(pages), "light").checkpoint(eager=True)
    grid = [(20, 64), (100, 128), (60, 512)]
    rows = fragments.sweep_fragments(nodes, grid).collect()
    assert len(rows) == 12 and any(x.fragment_count > 2 for x in rows)
    total = {x.page_id: x.cleaned_tokens for x in clean.serialized_tokens(nodes).collect()}
    for until, most in grid:
        fr = fragments.split_fragments(nodes, until, most).filter("NOT is_rest")
        steps = max(x.fragment_count for x in rows if x.until_html_tokens == until and x.max_text_tokens == most)
        sizes = {p: [n] for p, n in total.items()}
        for k in range(1, steps + 1):
            roots = nodes.join(fr.filter(F.col("seq") <= k).select("page_id", "xpath"), ["page_id", "xpath"]).select("page_id", "node_id")
            left = prune._inside(nodes, roots, "left_anti", strict=True).join(roots.withColumn("gone", F.lit(True)), ["page_id", "node_id"], "left")
            bare = left.withColumn("text", F.when(F.col("gone"), None).otherwise(F.col("text"))).withColumn(
                "attrs", F.when(F.col("gone"), F.create_map().cast("map<string,string>")).otherwise(F.col("attrs")))
            for x in clean.serialized_tokens(bare).collect():
                sizes[x.page_id].append(x.cleaned_tokens)
        for x in rows:
            if x.until_html_tokens == until and x.max_text_tokens == most:
                s = sizes[x.page_id][:x.fragment_count + 1]
                assert x.fragment_tokens == [a - b for a, b in zip(s, s[1:])] and x.final_tokens == s[-1]


def test_hot_site_is_dealt_over_tasks(spark):
    n = 240
    pages = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"s{i}", f"<html><body><h1>t{i}</h1></body></html>") for i in range(n)],
                                  "page_id long, site string, html string")
    nodes = explode_dom(pages, keep=["site"]).checkpoint(eager=True)
    progs = pages.select("site", F.lit("title").alias("field"), F.lit("/html/body/h1").alias("program")).distinct()
    rows = lambda b: sorted((x.page_id, x.site, x.field, tuple(x["values"])) for x in apply_programs(
        nodes, progs, ["site"], ["field"], "program", None, b).collect())
    assert rows(False) == rows(True)
    assert [x[3] for x in rows(False)] == [(f"t{i}",) for i in range(n)]
    from pagesift.operators.xpath import _salted
    dealt, copies, salt = _salted(nodes, progs, ["site"])
    tasks = [x["count"] for x in dealt.filter("node_id = 0").repartition(8, "site", *salt).groupBy(
        F.spark_partition_id()).count().collect()]
    assert salt == ["_salt"] and max(tasks) <= 3 * sorted(tasks)[len(tasks) // 2]
    assert copies.filter("site <> 'hot'").count() == progs.count() - 1   # only the hot site's programs are repeated
    out = apply_programs(nodes, progs, ["site"], ["field"], "program", None, False)
    assert "_salt" in out._jdf.queryExecution().toString() and "_salt" not in out.columns


def test_table_functions(spark):
    pages = spark.createDataFrame([(i, f"<html><body><p>a{i}<b>x</b>y</p>{'<ul><li>one two</li></ul>' * 3}</body></html>") for i in range(5)],
                                  "page_id long, html string")
    nodes = explode_dom(pages).checkpoint(eager=True)
    udtfs.register(spark)
    pages.createOrReplaceTempView("udtf_pages")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    cols = ["page_id", "node_id", "parent_id", "depth", "tag", "xpath"]
    assert rows(spark.sql("SELECT * FROM traverse(TABLE(udtf_pages) PARTITION BY page_id)")) == rows(nodes.select(*cols))
    assert rows(spark.sql("SELECT * FROM itertext(TABLE(udtf_pages) PARTITION BY page_id)")) == rows(
        texts(nodes).select("page_id", "node_id", "idx", "text"))
    light = clean.sanitize(nodes, "light")
    fragments.token_rows(light).createOrReplaceTempView("udtf_tokens")
    got = spark.sql("SELECT * FROM fragments(TABLE(udtf_tokens) PARTITION BY (page_id), 10, 32)")
    assert rows(got) == rows(fragments.split_fragments(light, 10, 32))
    assert got.count() > 5

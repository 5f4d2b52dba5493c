"""Sanitize, condense, prune, tables, structure, fragments on small fixtures."""

import random

from pyspark.sql import functions as F

from pagesift.operators import clean, fragments, prune, structure, tables
from pagesift.operators.structure import kept_children, most_repeated_run

TABLES_NESTED = ("<html><body><h2>Prices</h2><table><caption>Main</caption><tr><td>a"
                 "<table><tr><td>inner</td></tr></table></td></tr></table>"
                 "<p>after</p><table><tr><td>x</td></tr></table></body></html>")


def test_sanitize_deep_removes_empty_and_hidden(explode):
    html = ("<html><head><title>t</title></head><body><div><span></span></div>"
            "<p style='display:none'>secret<b>x</b></p><p class='k'>keep <!-- c --> me</p>"
            "<img src='a.png'></body></html>")
    nodes = explode([html])
    kept = clean.sanitize(nodes, "deep")
    tags = sorted(r.tag for r in kept.collect())
    # empty div/span go, img goes, head/title go, hidden p stays without content
    assert tags == ["body", "html", "p", "p"]
    assert all(not r.attrs for r in kept.collect())
    light = clean.sanitize(nodes, "light")
    assert any(r.attrs == {"class": "k"} for r in light.collect())


def test_condense_roles(explode):
    html = "<html><body><div><p>a</p><p id='t'>target</p></div><ul><li>x</li></ul></body></html>"
    nodes = explode([html])
    inc = nodes.filter(F.col("attrs")["id"] == "t").select("page_id", "node_id")
    roles = {r.xpath: r.role for r in prune.classify_condense(nodes, inc).collect()}
    assert roles["/html/body/div/p[2]"] == "spine"
    assert roles["/html/body/div/p[1]"] == "stub"
    assert roles["/html/body/ul"] == "stub"
    assert roles["/html/body/ul/li"] == "dropped"


def test_prune_paths_and_budget(explode):
    html = "<html><body><div><p>a b c</p><p>d e f</p><p>g h i</p></div></body></html>"
    nodes = explode([html])
    paths = nodes.filter(F.col("tag") == "div").select("page_id", "xpath")
    kept = prune.prune_paths(nodes, paths)
    assert sorted(r.tag for r in kept.collect()) == ["body", "html"]
    full = prune.prune_by_budget(nodes, 10_000)
    assert full.count() == nodes.count()
    small = prune.prune_by_budget(nodes, 30)
    assert 2 < small.count() < nodes.count()


def test_table_forest(explode):
    nodes = explode([TABLES_NESTED])
    f = {r.level: r for r in tables.table_forest(nodes).collect() if r.level == 2}
    inner = f[2]
    rows = tables.table_forest(nodes).collect()
    outer = [r for r in rows if r.level == 1]
    assert len(outer) == 2 and inner.parent_table_id == outer[0].node_id
    titles = sorted(r.title or "" for r in outer)
    assert titles == ["Main", "after"]
    m = tables.table_measures(tables.table_forest(nodes, with_content=False)).first()
    assert (m.depth, m.width, m.max_width, m["count"]) == (2, 2, 1, 2)


def test_repeat_detection_goldens():
    # FIXTURES repeat-detection examples (start index 0 reachable here, Q9)
    seq = [1, 2, 3, 4, 1, 2, 3, 4, 5]
    assert most_repeated_run([str(x) for x in seq], [True] * 9) == [(0, 4), (4, 8)]
    seq2 = [0, 1, 2, 3, 1, 2, 1, 2, 1, 2]
    assert most_repeated_run([str(x) for x in seq2], [True] * 10) == [(4, 6), (6, 8), (8, 10)]
    assert most_repeated_run([str(x) for x in seq], [True] * 9, include_start=False) is None


def test_fold_rules():
    cases = [("ul", [("li", s, False) for s in "abcd"], [0]), ("tr", [("td", s, False) for s in "ab"], [0, 1]),
             ("div", [("div", "x", True)] * 3, [0]), ("div", [], []), ("li", [("p", "x", True)] * 3, [0, 1, 2]),
             ("div", [("p", "y", False), ("p", "x", False), ("p", "x", True), ("p", "x", False)], [0, 1, 2]),
             ("div", [("p", s, True) for s in "abababc"], [0, 1, 6]), ("div", [("p", s, False) for s in "aaa"], [0, 1, 2])]
    for tag, ch, want in cases:
        assert kept_children(tag, *([c[k] for c in ch] for k in range(3))) == want


def test_fold_equals_the_rules_on_serialized_trees():
    """Random trees folded as nested tuples, bottom-up, comparing whole subtrees."""
    r = random.Random(2)

    def grow(depth):
        kids = [grow(depth - 1) for _ in range(r.choice([0, 1, 2, 3, 6]))] if depth else []
        if kids and r.random() < 0.4:
            kids = kids * r.randint(1, 3)
        return (r.choice(["div", "ul", "li", "p", "table", "tr", "td"]), r.choice([None, None, "", "a", "b"]), kids)

    def fold(tree):
        kids = [fold(k) for k in tree[2]]
        tags, cls = [k[0] for k in kids], [k[1] is not None for k in kids]
        return (tree[0], tree[1], [kids[i] for i in kept_children(tree[0], tags, [repr(k) for k in kids], cls)])

    def flat(tree):
        rows = []
        stack = [(tree, -1)]
        while stack:
            (tag, cls, kids), parent = stack.pop()
            rows.append((len(rows), parent, tag, cls))
            stack.extend((k, rows[-1][0]) for k in reversed(kids))
        return rows

    sigs = {}
    for _ in range(150):
        tree = grow(4)
        rows = flat(tree)
        kept, sig = structure.fold_page(*map(list, zip(*rows)))
        want = fold(tree)
        assert [rows[i][2:] for i in kept] == [x[2:] for x in flat(want)]
        assert sigs.setdefault(repr(want), sig[0]) == sig[0]
    assert len(set(sigs.values())) == len(sigs)


def test_many_children_in_seconds():
    r = random.Random(1)
    block = [str(r.randrange(50)) for _ in range(331)]
    sigs = [str(r.randrange(10 ** 6)) for _ in range(1000)] + block * 300 + ["x"]
    assert len(sigs) > 100_000
    runs = most_repeated_run(sigs, [True] * len(sigs))
    assert len(runs) == 300 and runs[-1][1] - runs[-1][0] == 331
    assert len(most_repeated_run(["a"] * 100_000, [False] * 99_999 + [True])) == 100_000
    deep = 20_000
    kept, _ = structure.fold_page(list(range(deep)), list(range(-1, deep - 1)), ["div"] * deep, [None] * deep)
    assert len(kept) == deep


def test_pruning_drops_the_text_of_inner_nodes(explode):
    html = "<html><body>LEAD<div class='a'>INNER<p>kept text</p>BETWEEN</div>TAIL<div class='b'>leaf <b>bold</b> text</div></body></html>"
    nodes = clean.sanitize(explode([html]), "soup")
    out = structure.prune_by_structure(nodes, structure.page_structure(nodes))
    html = clean.serialize(out).first()["html"]
    assert not any(x in html for x in ("LEAD", "INNER", "BETWEEN", "TAIL"))
    assert "kept text" in html and "leaf <b>bold</b> text" in html


def test_structure_fold_collapses_lists(explode):
    html = ("<html><body><div class='w'><ul><li>1</li><li>2</li></ul></div>"
            "<div class='w'><ul><li>3</li></ul></div></body></html>")
    s = structure.page_structure(explode([html]))
    tags = sorted(r.xpath for r in s.collect())
    assert "/html/body/div[2]" not in tags and "/html/body/div[1]/ul/li[2]" not in tags


def test_fragments_and_removal(explode):
    body = "".join(f"<section class='s'><p>{'word ' * 40}</p></section>" for _ in range(6))
    nodes = clean.sanitize(explode([f"<html><body>{body}</body></html>"]), "light")
    fr = fragments.split_fragments(nodes, until_html_tokens=100, max_text_tokens=64).collect()
    assert fr[-1].is_rest if fr else True
    assert sum(1 for r in fr if not r.is_rest) >= 1
    rm = fragments.remove_until(nodes, 50, 100).first()
    assert rm.times >= 1 and rm.removed_tokens[-1] <= 100


def test_budget_rule_golden(spark):
    """FIXTURES budget_tree: children of 5, 5, 5 tokens under budgets 0, 7, 10, 15."""
    from pyspark.sql import Window
    rows = [(req, k, 5) for req in (0, 7, 10, 15) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "req int, child_ord int, tokens int")
    w = Window.partitionBy("req").orderBy("child_ord").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("cum_before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    kept = df.filter(prune.budget_keep(F.col("child_ord"), F.col("cum_before"), F.col("req")))
    got = {r.req: r["count"] for r in kept.groupBy("req").count().collect()}
    assert got == {0: 1, 7: 2, 10: 3, 15: 3}


def test_structure_golden_unclosed_rows(explode):
    """A table with unclosed tr/td rows folds to its first row (implied
    tbody and end tags come from the tree builder)."""
    html = ("<html><body><form><div class='pad_t'><div class='bgcrumbpop'><table>"
            "<tr><td><div>a</div><tr><td><div>b</div><tr><td><div>c</div></table>"
            "</div></div></form></body></html>")
    s = structure.page_structure(explode([html]))
    got = sorted(r.xpath for r in s.collect())
    base = "/html/body/form/div/div/table/tbody"
    assert got == sorted(["/html", "/html/body", "/html/body/form", "/html/body/form/div",
                          "/html/body/form/div/div", "/html/body/form/div/div/table", base,
                          base + "/tr[1]", base + "/tr[1]/td", base + "/tr[1]/td/div"])


def test_string_page_keys(spark):
    """Grouped maps keep the page key type (SWDE ids are strings)."""
    from pagesift.operators.dom import explode_dom
    body = "".join(f"<section class='s'><p>{'word ' * 40}</p></section>" for _ in range(4))
    pages = spark.createDataFrame([("0001", f"<html><body>{body}</body></html>")],
                                  "page_id string, html string")
    nodes = clean.sanitize(explode_dom(pages), "light")
    fr = fragments.split_fragments(nodes, until_html_tokens=100, max_text_tokens=64).collect()
    assert fr and all(r.page_id == "0001" for r in fr)
    assert fragments.remove_until(nodes, 50, 100).first().page_id == "0001"


def test_fragment_texts_lose_and_repeat_nothing(explode):
    inner = "".join(f"<p>in{i} a b c d e f g</p>" for i in range(6))
    nodes = explode([f"<html><body>top<div>left {inner}</div><div><ul><li>one two three four</li></ul>mid</div>end</body></html>"])
    nodes = clean.sanitize(nodes, "deep")
    fr = fragments.split_fragments(nodes, until_html_tokens=20, max_text_tokens=48)
    rows = sorted(fragments.fragment_texts(nodes, fr).collect(), key=lambda r: r.seq)
    assert len(rows) > 1 and rows[-1].is_rest and rows[-1].xpath == "/html"
    words = sorted(" ".join(r.text for r in rows).split())
    want = ["top", "left", "mid", "end", "one", "two", "three", "four"] + [f"in{i}" for i in range(6)] + list("abcdefg") * 6
    assert words == sorted(want)


def test_pages_are_pruned_by_their_own_structure(spark, tmp_path):
    """One site with two layouts: each page keeps what its own structure has."""
    from pagesift.plans.analyses import q_prune_by_structure, q_structure_pruning_stats
    html = ['<html><body><div class="a"><p>first</p></div></body></html>',
            '<html><body><section class="b"><h1>second</h1><p>value</p><script>x</script></section></body></html>']
    spark.createDataFrame([(i, f"http://s.example.com/en/{i}", h) for i, h in enumerate(html)],
                          "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.n_kept for r in q_prune_by_structure(spark, str(tmp_path)).collect()}
    assert got == {0: 4, 1: 5}
    tokens = {r.page_id: r.structure_tokens for r in q_structure_pruning_stats(spark, str(tmp_path)).collect()}
    assert tokens[1] > tokens[0] > 0


def test_page_steps_have_a_task_per_partition_however_small_the_rows(explode, spark):
    """Token rows are a few bytes, but the greedy split takes its time in Python: the
    adaptive reader would merge such small partitions to one task."""
    from pagesift.operators import fragments, structure
    from pagesift.operators.clean import sanitize
    nodes = explode([f"<body><div class='a'><p>{'word ' * n}</p></div><ul><li>x<li>y</ul></body>" for n in range(1, 41)])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    soup = sanitize(nodes, "soup")
    for out in (fragments.split_fragments(nodes, 20, 16), fragments.remove_until(nodes, 4, 4)):
        assert out.rdd.getNumPartitions() >= least
        assert out.select("page_id").distinct().count() == 40
    kept = structure.prune_by_structure(soup, structure.page_structure(nodes))
    assert kept.filter("tag = 'li'").count() == 40


def test_groups_go_on_over_batches():
    import pyarrow as pa

    from pagesift.operators.pagewise import groups
    rows = [(k, i) for i, k in enumerate([None, None, 1, 1, 1, 1, 1, 2, 3, 3])]
    for size in (1, 2, 3, 4, 10):
        batches = [pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in rows[i:i + size]],
                                              pa.schema([("k", pa.int64()), ("v", pa.int64())]))
                   for i in range(0, len(rows), size)] + [pa.RecordBatch.from_pylist([], pa.schema([("k", pa.int64()), ("v", pa.int64())]))]
        assert [(k[0], c[1]) for k, c in groups(iter(batches), 1)] == [(None, [0, 1]), (1, [2, 3, 4, 5, 6]), (2, [7]), (3, [8, 9])]

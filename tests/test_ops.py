"""Fragment operations and text-choice helpers."""

from pyspark.sql import functions as F

from pagesift.operators import ops

DATA_T = "map<string,struct<value:array<string>,cue_text:string>>"


def ops_frame(spark, rows):
    return spark.createDataFrame(rows, f"page_id long, seq int, xpath string, data {DATA_T}")


def test_field_operators_drop_trailing_prunes(spark):
    o = ops_frame(spark, [
        (0, 1, "/html/body/div[1]", {}),
        (0, 2, "/html/body/div[2]", {"title": (["T"], "cue")}),
        (0, 3, "/html/body/div[3]", {}),
    ])
    r = sorted((x.seq, x.operator_type) for x in ops.field_operators(o).collect())
    assert r == [(1, "prune"), (2, "extract")]


def test_classify_fragments_drops_ancestor_prunes(spark):
    o = ops_frame(spark, [
        (0, 1, "/html/body/div", {}),
        (0, 2, "/html/body/div/p", {"x": (["v"], None)}),
        (0, 3, "/html/body/ul", {"x": ([], None)}),
    ])
    r = sorted((x.xpath, x.operator_type) for x in ops.classify_fragments(o).collect())
    assert r == [("/html/body/div/p", "extract"), ("/html/body/ul", "prune")]


def test_full_text_and_deepest_node(spark, explode):
    nodes = explode(["<html><body><div>Price: 10 EUR<p><b>10 EUR only</b></p></div></body></html>"])
    t = spark.createDataFrame([(0, "10 EUR"), (0, "absent")], "page_id long, target string")
    ft = {r.target: r.full_text for r in ops.full_texts(nodes, t).collect()}
    # 1 - 5/11 beats 1 - 7/13: the tighter container wins
    assert ft == {"10 EUR": "10 EUR only", "absent": "absent"}
    deep = ops.deepest_text_node(nodes, t.filter(F.col("target") == "10 EUR")).first()
    tags = {r.node_id: r.tag for r in nodes.collect()}
    assert tags[deep.node_id] == "b"


def test_union_programs(spark):
    p = spark.createDataFrame([("s", "f", "//b"), ("s", "f", "//a"), ("s", "f", "//a")],
                              "site string, field string, program string")
    assert ops.union_programs(p, ["site"]).first().program == "//a | //b"


def test_rank_extracts_prefers_heading(spark, explode):
    nodes = explode(["<html><body><div><span>Title X and more words</span></div><h1>Title X</h1></body></html>"])
    fops = spark.createDataFrame([
        (0, "title", 1, "/html/body/div", "extract", ["Title X"]),
        (0, "title", 2, "/html/body/h1", "extract", ["Title X"])],
        "page_id long, field string, seq int, xpath string, operator_type string, values array<string>")
    r = sorted((x.seq, x.operator_type) for x in ops.rank_extracts(nodes, fops).collect())
    assert r == [(1, "prune"), (2, "extract")]


def representative_input(spark, folder):
    """Two sites whose largest page is not the first, one with equal pages, one page
    under two hosts and one site without values."""
    page = lambda title, links, text: (
        f"<html><head><title>{title}</title></head><body><nav><ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links)
        + f"</ul></nav><article><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in text) + "</article></body></html>")
    rows = [(1, "http://a.example/en/1", page("One", ["x"], ["short"])),
            (2, "http://a.example/en/2", page("Two", ["news", "home"], ["some longer text", "and more of it"])),
            (3, "http://b.example/en/3", page("Three", [], ["the same text"])),
            (4, "http://b.example/en/4", page("Three", [], ["the same text"])),
            (2, "http://c.example/en/2", page("Two", [], [])),
            (6, "http://d.example/en/6", page("", [], ["no value at all"]))]
    rows += [(i, f"http://a.example/en/{i}", page("One", ["x"], [])) for i in range(10, 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def test_representative_pages_and_their_contexts(spark, tmp_path):
    from pagesift.plans.analyses import q_representative_pages
    representative_input(spark, tmp_path)
    rows = {(r.site, r.page_id): r for r in q_representative_pages(spark, str(tmp_path)).collect()}
    # site d has no values; page 2 comes under two hosts and has the nodes of both
    assert set(rows) == {("a.example", 2), ("b.example", 3), ("c.example", 2)}
    three = rows["b.example", 3]
    assert three.lca_xpath == "/html/body/article/h1"
    assert three.context_chars == len("<html><body><article><h1>Three</h1><p>...</p></article></body></html>")


def test_representative_pages_reads_the_node_table_once_a_step(spark, tmp_path, monkeypatch):
    from pagesift.plans import analyses, common
    representative_input(spark, tmp_path)
    read, size = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def nodes_once(s, d):
        nodes = common.keyed_nodes(s, d)
        size.append(nodes.count())
        return nodes.mapInArrow(counted, nodes.schema)

    monkeypatch.setattr(analyses, "_nodes_once", nodes_once)
    analyses.q_representative_pages(spark, str(tmp_path)).collect()
    # sanitizing reads it for the texts, the nodes and the hidden ones; then the chosen pages
    assert size[0] < read.value <= 6 * size[0]

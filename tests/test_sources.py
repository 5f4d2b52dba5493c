"""SWDE-layout readers and resumable sinks on a fixture tree."""

import json
import os
from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from pagesift.sources import sinks, swde


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("swde")
    site = root / "book" / "book-amazon(3)"
    site.mkdir(parents=True)
    for i in range(3):
        (site / f"000{i}.htm").write_text(f"<html><body><h1>Book {i}</h1></body></html>")
    gt = root / "groundtruth" / "book"
    gt.mkdir(parents=True)
    (gt / "book-amazon-title.txt").write_text(
        "book\tamazon\ttitle\nheader line\n0000\t1\tBook 0\n\n0001\t2\tBook 1\tAlt &amp; 1\n"
        "0002\t1\t<NULL>\n")
    (gt / "book-amazon-author.txt").write_text("h1\nh2\n0000\t1\tAnn\n")
    (root / "book" / "book-amazon(3).json").write_text(json.dumps({
        "0000": {"title": ["Book 0"], ".hidden": ["x"], "price:": ["1"], "empty": []}}))
    q = root / "questions"
    q.mkdir()
    (q / "book_amazon.txt").write_text("Give author(`author`) and title(`title`)?")
    (q / "book_ebay.txt").write_text('As JSON\n```json\n{"isbn": ["..."], "title": ["..."]}\n```')
    return str(root)


def test_read_pages(spark, corpus):
    p = swde.read_pages(spark, corpus)
    rows = sorted((r.category, r.site, r.page_id, r.pages) for r in p.collect())
    assert rows == [("book", "amazon", f"000{i}", 3) for i in range(3)]
    assert [r.category for r in swde.categories(p).collect()] == ["book"]


def test_ragged_truth(spark, corpus):
    t = swde.read_ground_truth(spark, corpus, normalize=True)
    got = {(r.field, r.page_id): r["values"] for r in t.collect()}
    assert got == {("title", "0000"): ["Book 0"], ("title", "0001"): ["Book 1", "Alt & 1"],
                   ("author", "0000"): ["Ann"]}
    fields = t.select("category", "site", "field").distinct()
    wide = {r.page_id: r.attributes for r in swde.truth_maps(t, fields).collect()}
    assert wide["0001"]["author"] == []


def test_expanded_truth_and_queries(spark, corpus):
    e = swde.read_expanded_truth(spark, corpus)
    assert sorted(r.field for r in e.collect()) == ["price", "title"]
    q = swde.site_queries(e).first()
    assert q.query == "Please extract the following fields: `price` of the book, `title` of the book"


def test_questions(spark, corpus):
    q = {r.site: r.fields for r in swde.read_questions(spark, os.path.join(corpus, "questions")).collect()}
    assert q["amazon"] == ["author", "title"]
    assert sorted(q["ebay"]) == ["isbn", "title"]


def test_resume_only_runs_pending(spark, corpus, tmp_path):
    todo = swde.read_pages(spark, corpus).select("page_id", "html")
    out = str(tmp_path / "out")
    calls = []

    def run(rows):
        calls.append(rows.count())
        return rows.select("page_id", F.length("html").alias("n"))

    sinks.resume(spark, todo.filter(F.col("page_id") == "0000"), out, ["page_id"], run)
    done = sinks.resume(spark, todo, out, ["page_id"], run)
    assert calls == [1, 2] and done.count() == 3


def test_results_json_sink_drops_html(spark, tmp_path):
    rows = spark.createDataFrame([("book", "amazon", "0000", "<html/>", '{"title": ["A"]}')],
                                 "category string, site string, page_id string, html string, data string")
    out = str(tmp_path / "results")
    sinks.write_results_json(rows, out)
    back = spark.read.json(out)
    assert "html" not in back.columns
    assert back.select("category", "site", "page_id").first().asDict() == {
        "category": "book", "site": "amazon", "page_id": "0000"}


def test_page_keys_are_unique_where_file_names_repeat(spark, tmp_path):
    from pagesift.operators.dom import explode_dom
    for site in ("one", "two"):
        folder = tmp_path / "book" / f"book-{site}(1)"
        folder.mkdir(parents=True)
        (folder / "0000.htm").write_text(f"<html><body><p>{site}</p></body></html>")
    pages = swde.read_pages(spark, str(tmp_path))
    assert pages.select("page_id").distinct().count() == 1
    nodes = explode_dom(pages, id_col="page_key")
    assert {r.page_id for r in nodes.collect()} == {"book_one_0000", "book_two_0000"}
    assert nodes.groupBy("page_id", "node_id").count().filter("count > 1").isEmpty()


def test_node_table_has_a_bounded_number_of_pages_a_partition(spark, tmp_path, monkeypatch):
    from pagesift.plans import common
    rows = [(i, f"http://s.example.com/en/{i}", f"<p>{i}</p>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(common, "PAGES_PER_PARTITION", 5)
    nodes = common.keyed_nodes(spark, str(tmp_path))
    assert nodes.rdd.getNumPartitions() == 40
    assert nodes.filter("tag = 'p'").count() == 200


def test_joins_by_page_do_not_deal_out_the_node_table_again(spark, tmp_path, monkeypatch):
    from pagesift.plans import common
    rows = [(i, f"http://s.example.com/en/{i}", f"<p>{i}</p>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(common, "FEW_PAGES", 5)
    common.prepare(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        nodes = common.keyed_nodes(spark, str(tmp_path))
        assert nodes.rdd.getNumPartitions() == 37
        assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
        plan = StringIO()
        with redirect_stdout(plan):
            nodes.groupBy("page_id").count().explain()
        assert "Exchange" not in plan.getvalue()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

"""Program compile (pure) and set-oriented evaluation."""

import pytest
from pyspark.sql import functions as F

from pagesift.functions.xpath_compile import branch_mode, compile_program

PAGE = ("<html><head><title>Title A</title></head><body>"
        "<div id='main'><ul><li class='x'>one</li><li>two</li><li class='x'>three</li></ul>"
        "<span class='lbl'>Type:</span><span>Book</span><a href='/p%20q'>link</a>"
        "<p class='n'>x&nbsp;y</p></div>"
        "<table><tr><td>c1</td><td>c2</td></tr></table></body></html>")


def test_compile_modes():
    assert branch_mode(compile_program("/html/body/div/ul/li[2]")[0][0]) == "abs"
    assert branch_mode(compile_program("//ul/li[@class='x']")[0][0]) == "pattern"
    assert branch_mode(compile_program("//li[2]/text()")[0][0]) == "pattern"
    assert branch_mode(compile_program("//ul/li[2]/a")[0][0]) == "pattern"
    assert branch_mode(compile_program("//div[2]//span[1]")[0][0]) == "general"
    assert branch_mode(compile_program("//*[@id='main']/ul/li[1]")[0][0]) == "anchor"
    assert branch_mode(compile_program("/html/body/div[@id='main']/ul/li[2]")[0][0]) == "abs"
    assert branch_mode(compile_program(
        "//span[text()='Type:']/following-sibling::span[1]")[0][0]) == "general"
    assert compile_program("//a[")[1] is True
    assert compile_program(None)[1] is True
    assert len(compile_program("//title/text() | //a/@href")[0]) == 2


CASES = [
    ("title_text", "//title/text()", ["Title A"]),
    ("abs_pos", "/html/body/div/ul/li[2]", ["two"]),
    ("pred_last", "//ul/li[@class='x'][2]", ["three"]),
    ("last", "//li[last()]", ["three"]),
    ("following", "//span[text()='Type:']/following-sibling::span[1]/text()", ["Book"]),
    ("id_short", "//*[@id='main']/ul/li[1]", ["one"]),
    ("href", "//a/@href", ["/p%20q"]),
    ("tbody", "/html/body/table/tbody/tr/td[2]", ["c2"]),
    ("union", "//title/text() | //li[1]", ["Title A", "one"]),
    ("contains", "//li[contains(text(), 'hre')]", ["three"]),
    ("parent", "//li[@class='x']/..", ["one\ntwo\nthree"]),
    ("ancestor", "//li[1]/ancestor::div/span[2]", ["Book"]),
    ("css", "ul > li.x", ["one", "three"]),
    ("tail_pos", "//ul/li[2]/text()", ["two"]),
    ("tail_cell", "//tr/td[2]", ["c2"]),
    ("deep_after_pos", "/html/body/div[1]//li[3]", ["three"]),
    ("anchor_text", "//div[@id='main']/span[2]/text()", ["Book"]),
    ("anchor_self", "//*[@id='main']/a/@href", ["/p%20q"]),
    ("css_entity", "span.lbl", ["Type:"]),
    ("or_pred", "//ul/li[text()='one' or text()='three']", ["one", "three"]),
    ("or_and_brackets", "//li[@class='x' or text()='two'][text()!='one']", ["two", "three"]),
    ("ne_absent_attr", "//ul/li[@class != 'y']", ["one", "three"]),
    ("not_eq", "//ul/li[not(@class = 'x')]", ["two"]),
    ("abs_inner_pred", "/html/body/div[@id='main']/ul/li[2]/text()", ["two"]),
    ("abs_inner_fail", "/html/body/div[@class='nope']/ul/li", []),
    ("abs_inner_last", "/html/body/div[@id='main']/ul/li[@class='x'][2]", ["three"]),
    ("css_nbsp", "p.n", ["x\xa0y"]),           # CSS: one unescape, NBSP kept
    ("xpath_nbsp", "//p[@class='n']", ["x y"]),  # XPath values: NBSP becomes a space
    ("invalid", "//li[", []),
]


@pytest.fixture(scope="module")
def results(spark, explode):
    from pagesift.operators.xpath import apply_programs
    nodes = explode([PAGE])
    progs = spark.createDataFrame(
        [("s.example.com", n, p, "css" if n.startswith("css") else "xpath") for n, p, _ in CASES],
        "site string, field string, program string, lang string")
    res = apply_programs(nodes, progs, ["site"], ["field"])
    return {r["field"]: (list(r["values"]), r["invalid"]) for r in res.collect()}


@pytest.mark.parametrize("name,program,expected", CASES)
def test_program(results, name, program, expected):
    values, invalid = results[name]
    assert values == expected
    assert invalid == (name == "invalid")


def test_positional_xpath_selects_its_node(spark, explode):
    """Property: every node's own positional path selects exactly that node."""
    from pagesift.operators.xpath import apply_programs
    nodes = explode([PAGE]).filter((F.col("tag") != "#comment"))
    progs = nodes.select("site", F.col("node_id").cast("string").alias("field"),
                         F.col("xpath").alias("program"))
    res = apply_programs(nodes, progs, ["site"], ["field"], "program", None)
    hits = res.filter(F.size("values") > 0).count()
    assert res.filter("invalid").count() == 0
    assert hits >= nodes.filter(F.size("text_slots") > 0).count()

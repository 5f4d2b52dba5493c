"""Column functions F1-F15 against Python semantics."""

import html

from pyspark.sql import functions as F

from pagesift.functions import text


def one(spark, col_fn, value, schema="string"):
    df = spark.createDataFrame([(value,)], f"x {schema}")
    return df.select(col_fn(F.col("x")).alias("y")).first().y


def test_normalize_text_double_unescape_and_spaces(spark):
    assert one(spark, text.normalize_text, "  a &amp;lt; b&nbsp;&nbsp;c \n") == "a < b c"
    assert one(spark, text.normalize_text, "caf&eacute; &#8226; x&#x27;s") == "café • x's"
    # a newline is kept (only runs of spaces collapse), surrounding whitespace goes
    assert one(spark, text.normalize_text, "　a  b\nc\t") == "a b\nc"


def test_token_count(spark):
    assert one(spark, text.token_count, "Hello, world! 42") == 5
    assert one(spark, text.token_count, None) == 0


def test_token_count_is_the_number_of_matches(spark):
    import random
    rnd = random.Random(4)
    marks = "aZ_09 \t\n\x0b\f\r\x1c\x85\xa0é漢😀.,<>&;-$\\\u200b\u0301"
    rows = [("".join(rnd.choices(marks, k=rnd.randint(0, 14))),) for _ in range(3000)] + [(None,), ("",), ("  ",), ("a" * 500,)]
    df = spark.createDataFrame(rows, "x string").select("x", text.token_count("x").alias("n"), F.coalesce(
        F.size(F.regexp_extract_all("x", F.lit(text.TOKEN_PATTERN), 0)), F.lit(0)).alias("matches"))
    assert df.filter("n <> matches OR n IS NULL OR matches IS NULL").collect() == []
    plan = df.select("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # a string of each match took most of the time


def test_url_decode_keeps_plus(spark):
    assert one(spark, text.url_decode_keep_plus, "/a%20b+c") == "/a b+c"


def test_answer_parsing(spark):
    raw = 'thinking...\nConclusion: ```json\n{"xpath": "//h1"}\n```'
    s = one(spark, text.strip_answer, raw)
    assert s == '{"xpath": "//h1"}'
    assert one(spark, text.parse_program_answer, s) == "//h1"
    assert one(spark, text.parse_program_answer, "/html/body") == "/html/body"
    assert one(spark, text.parse_program_answer, '["//a", "//b"]') == "//a"


def test_ordered_list_and_parent_path(spark):
    assert one(spark, text.ordered_list, ["a", "b"], "array<string>") == "1. a\n2. b"
    assert one(spark, text.parent_xpath, "/html/body/div[2]") == "/html/body"


def test_html_unescape_matches_stdlib(spark):
    samples = ["&copy; &middot; &hellip;", "&#128150;", "&amp;amp;", "no entity", "&bogus;"]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    got = [r.y for r in df.select(text.html_unescape(F.col("x")).alias("y")).collect()]
    assert got == [html.unescape(s) for s in samples]


def test_normalize_text_with_unescape_in_one_step(spark):
    samples = ["a &amp;amp;lt; b", "&amp;nbsp;x&amp;#8226;", "&#0;&#xD83D;", "&amp;bogus; &", "plain", "", None, "&amp;amp;nbsp;"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, x string")
    got = df.select(text.normalize_text("x", True).alias("a"),
                    text.normalize_text(text.html_unescape("x")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "a < b"


def python_steps(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython")


def test_non_empty_values_run_python_once(spark):
    from pagesift.operators import induce, ops
    from pagesift.operators.dom import explode_dom
    from pagesift.operators.xpath import apply_programs
    from pagesift.plans.pipeline import harness_annotations, normalize_values
    df = spark.createDataFrame([(1, "f", ["&amp;lt;b", "&nbsp;", None, " x "]), (2, "f", ["&#160;"])],
                               "page_id int, field string, raw array<string>")
    out = text.non_empty(df.select("page_id", F.explode("raw").alias("v")), ["page_id"], text.normalize_text("v"), "y")
    assert sorted(out.collect()) == [(1, "<b"), (1, "x")] and python_steps(out) == 1
    assert normalize_values(df, ["page_id", "field"], "raw", unescape=True).collect() == [(1, "f", ["<b", "x"])]
    html = "<html><head><title>T &amp;amp; U</title></head><body><nav><a href=\"/\">A</a></nav><p>T &amp; U</p></body></html>"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string").checkpoint(eager=True)
    ann = harness_annotations(pages)
    # a second step on the same rows is one more Python worker in each task
    assert python_steps(ann) == 1
    ann = ann.checkpoint(eager=True)
    assert {(r.field, *r["values"]) for r in ann.collect()} == {("title", "T & U"), ("nav", "A")}
    targets = induce.targets_from_annotations(ann)
    assert python_steps(targets) == 1 and targets.count() == 2
    nodes = explode_dom(pages).withColumn("site", F.lit("s")).checkpoint(eager=True)
    # the targets' page ids, the targets and the chunks: different tasks
    assert python_steps(induce.matched_chunks(nodes, ann)) == 3
    program = spark.createDataFrame([("s", "f", "//p")], "site string, field string, program string")
    assert python_steps(apply_programs(nodes, program, ["site"], ["field"], "program", None)) == 1
    found = ops.deepest_text_node(nodes, ann.select("page_id", F.explode("values").alias("target")))
    # the chunks and the targets
    assert python_steps(found) == 2 and found.count() == 2

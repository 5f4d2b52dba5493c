"""Program selection rules (W4, W5, X12) and small table jobs."""

from pyspark.sql import functions as F

from pagesift.operators import induce, ops

TRIED = "site string, field string, program string, try_seq int"
FB = ("page_id long, site string, field string, program string, extracted array<string>, "
      "invalid boolean")


def choose(spark, tried, fb):
    t = spark.createDataFrame(tried, TRIED)
    f = spark.createDataFrame(fb, FB)
    return {r.field: r.program for r in induce.select_best(t, f, ["site"]).collect()}


def test_select_best_prefers_no_feedback(spark):
    tried = [("s", "x", "A", 1), ("s", "x", "B", 2), ("s", "x", "C", 3), ("s", "x", "D", 4)]
    fb = [(1, "s", "x", "A", [], True),            # invalid -> out
          (1, "s", "x", "C", [], False),           # extracted nothing on a page -> out
          (1, "s", "x", "D", ["u", "v"], False)]   # 2 values in feedback
    assert choose(spark, tried, fb) == {"x": "B"}  # no feedback at all scores 0 and wins


def test_select_best_single_valid_and_fallbacks(spark):
    # only one valid program: it wins even if it extracted nothing
    tried = [("s", "x", "A", 1), ("s", "x", "B", 2)]
    fb = [(1, "s", "x", "A", [], True), (1, "s", "x", "B", [], False)]
    assert choose(spark, tried, fb) == {"x": "B"}
    # all valid programs extract nothing somewhere: first tried valid wins
    tried = [("s", "y", "P", 1), ("s", "y", "Q", 2)]
    fb = [(1, "s", "y", "P", [], False), (1, "s", "y", "Q", [], False)]
    assert choose(spark, tried, fb) == {"y": "P"}


def test_best_by_f1_and_seed_coverage(spark):
    scored = spark.createDataFrame(
        [("s", "x", "//b", 0.9, 3), ("s", "x", "//a", 0.9, 3), ("s", "x", "//c", 0.9, 5),
         ("s", "x", "//d", 0.5, 9)], "site string, field string, program string, f1 double, n_extracted long")
    assert induce.best_by_f1(scored, ["site"]).first().program == "//c"
    per_page = spark.createDataFrame(
        [(1, "s", "x", "//a", ["v"]), (2, "s", "x", "//a", []), (1, "s", "x", "//b", ["v"]),
         (2, "s", "x", "//b", ["w"])], "page_id long, site string, field string, program string, values array<string>")
    assert induce.best_by_seed_coverage(per_page, ["site"]).first().program == "//b"


def test_label_counts_and_limits(spark):
    gt = spark.createDataFrame([("f1", "3"), ("f1", "1"), ("f1", "x"), ("f2", "7")], "file_name string, col1 string")
    rows = [(r.file_name, r.max_col1, r.min_col1) for r in ops.label_counts(gt).collect()]
    assert rows == [("f2", 7.0, 7.0), ("f1", 3.0, 1.0)]
    tried = spark.createDataFrame([(i,) for i in range(1, 7)], "try_seq int")
    assert ops.limit_tries(tried).count() == 4


def test_prompt_rows(spark):
    snips = spark.createDataFrame(
        [("s", "title", 2, "<h1>B</h1>", ["B"], ["/html/body/h1"], []),
         ("s", "title", 1, "<h1>A</h1>", ["A"], ["/html/body/h1"], ["//label"])],
        "site string, field string, page_id long, html string, values array<string>, "
        "target_xpaths array<string>, cue_xpaths array<string>")
    p = ops.prompt_rows(snips, ["site"]).first().prompt
    assert p.index("## Snippet 1") < p.index("## Snippet 2") and '["//label"]' in p


def test_convert_ground_truth(spark, tmp_path):
    from pagesift.sources import sinks
    gt = tmp_path / "groundtruth" / "book"
    gt.mkdir(parents=True)
    (gt / "book-amazon-title.txt").write_text("h\nh\n0000\t1\tBook 0\n0001\t1\t<NULL>\n")
    out = str(tmp_path / "gt.parquet")
    sinks.convert_ground_truth(spark, str(tmp_path), out)
    r = spark.read.parquet(out).collect()
    assert len(r) == 1 and r[0].category == "book" and r[0].site == "amazon"
    assert '"title":["Book 0"]' in r[0].attributes

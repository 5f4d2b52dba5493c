"""Text search by automaton equals the pair join."""

import random

from pyspark.sql import functions as F

from pagesift.operators import induce, ops
from pagesift.operators.textsearch import matches, text_matches


def brute(chunks, targets, both):
    return sorted((i, j) for i, c in enumerate(chunks) for j, t in enumerate(targets)
                  if t in c or (both and c and c in t))


def test_matches_equal_pairs():
    r = random.Random(7)
    for _ in range(400):
        words = ["".join(r.choice("aé \U00010003") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 12))]
        cut = r.randint(0, len(words))
        for both in (False, True):
            assert matches(words[:cut], words[cut:], both) == brute(words[:cut], words[cut:], both)


def test_many_targets_are_linear():
    r = random.Random(1)
    chunks = [f"k{i} " + "x" * 50 for i in range(20_000)]
    targets = [f"k{r.randrange(40_000)} " for _ in range(20_000)]
    hits = matches(chunks, targets, True)
    assert 0 < len(hits) < 60_000


def test_text_matches_join(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab ") for _ in range(r.randint(0, 4)))
    chunks = [(p, word(), i) for p in (1, 2, 3) for i in range(20)] + [(1, None, 99)]
    targets = [(p, word(), f"t{i}") for p in (1, 2, 4) for i in range(10)]
    c = spark.createDataFrame(chunks, "page_id long, norm string, chunk int")
    t = spark.createDataFrame(targets, "page_id long, t_norm string, name string")
    for both in (False, True):
        got = sorted(tuple(x) for x in text_matches(c, t, ["page_id"], both).collect())
        want = sorted((p, i, n) for p, a, i in chunks for q, b, n in targets
                      if p == q and (b in (a or "") or (both and a and a in b)))
        assert got == want


def test_values_over_two_lines_are_found(explode, spark):
    nodes = explode(["<html><body><h1>Big\n  Title</h1><p>other</p></body></html>"])
    ann = spark.createDataFrame([(0, "title", ["Big Title"])], "page_id long, field string, values array<string>")
    ann = ann.withColumn("page_id", F.lit(nodes.first().page_id))
    got = [r.program for r in induce.candidate_programs(nodes, ann, induce.EXTRACT).collect()]
    assert got == ["/html/body/h1"]


def test_earlier_fragments_are_removed_before_ranking(explode, spark):
    """The value stands in an h1 inside the first fragment, which the second one, an
    ancestor, no longer holds when it is searched."""
    nodes = explode(["<html><body><div><section><h1>42</h1></section><p>the number 42 in a long text</p></div></body></html>"])
    page = nodes.first().page_id
    rows = [(page, "n", 1, "/html/body/div/section", "prune", None), (page, "n", 2, "/html/body/div", "extract", ["42"]),
            (page, "n", 3, "/html/body/div/p", "extract", ["42"])]
    fops = spark.createDataFrame(rows, "page_id long, field string, seq int, xpath string, operator_type string, values array<string>")
    got = sorted((r.seq, r.operator_type) for r in ops.rank_extracts(nodes, fops).collect())
    # the p is tight for both, but the third finds nothing once the second is gone
    assert got == [(1, "prune"), (2, "extract")]


def test_predictions_come_from_the_extracting_fragment(explode, spark):
    """The value also stands, tighter, in a pruned fragment and outside: neither counts."""
    nodes = explode(["<html><body><h1>42</h1><div><p>42 EUR</p></div><section><p>price: 42 EUR only</p><p>no</p></section></body></html>"])
    page = nodes.first().page_id
    rows = [(page, "price", 1, "/html/body/div", "prune", None), (page, "price", 2, "/html/body/section", "extract", ["42 EUR", "gone"])]
    fops = spark.createDataFrame(rows, "page_id long, field string, seq int, xpath string, operator_type string, values array<string>")
    assert ops.field_predictions(nodes, fops).collect()[0]["values"] == ["price: 42 EUR only", "gone"]

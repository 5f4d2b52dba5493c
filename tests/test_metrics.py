"""Metric goldens (FIXTURES M6, M13) and the per-site report."""

import pytest
from pyspark.sql import functions as F

from pagesift.operators import metrics

M6_TRUTH = [["a", "b"]] * 6
M6_PRED = [["a", "b"], ["a"], ["a", "b", "c"], ["a", "c"], ["c"], []]
S, P, E = "S", "P", "E"
M13_TRUTH = [[], [S], [S, P]] + [[S, P, E]] * 10
M13_PRED = [[S, P, E], [], [E], [P, E], [P, E, "x"], [E, S, "y"], [S, E, "z"], [S, E], [E, P, S],
            [S], ["other"], [P, S], [S, P]]


def frame(spark, preds, truths):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(zip(preds, truths))],
                                 "id long, pred array<string>, truth array<string>")


def test_m6_set_micro(spark):
    r = metrics.set_micro(frame(spark, M6_PRED, M6_TRUTH)).first()
    assert (r.tp, r.fp, r.fn) == (6, 3, 6)
    assert round(r.precision, 2) == 0.67 and round(r.recall, 2) == 0.50
    assert round(r.label_accuracy, 2) == 0.50 and round(r.f1, 2) == 0.57


def test_m6_binarized(spark):
    per, summary = metrics.multilabel_report(frame(spark, M6_PRED, M6_TRUTH), ["id"])
    s = summary.first()
    assert round(s.micro_precision, 2) == 1.0 and round(s.micro_recall, 2) == 0.5
    assert round(s.micro_f1, 2) == 0.67 and round(s.subset_accuracy, 2) == 0.33
    pl = {r.label: r for r in per.collect()}
    assert round(pl["a"].recall, 3) == 0.667 and round(pl["b"].recall, 3) == 0.333
    assert round(pl["a"].f1, 1) == 0.8 and round(pl["b"].f1, 1) == 0.5


def test_m13_micro_sample_exact(spark):
    df = frame(spark, M13_PRED, M13_TRUTH)
    r = metrics.set_micro(df).first()
    assert (r.tp, r.fp, r.fn) == (18, 8, 15)
    assert round(r.precision, 4) == 0.6923 and round(r.recall, 4) == 0.5455
    s = metrics.sample_averages(df).first()
    assert round(s.sample_precision, 4) == 0.6667 and round(s.sample_recall, 4) == 0.5
    e = metrics.exact_set_accuracy(df).first()
    assert round(e.exact_accuracy, 4) == 0.0769


def test_membership_counts_duplicates(spark):
    df = spark.createDataFrame([(["a", "a", "x"], ["a", "b"])], "pred array<string>, truth array<string>")
    r = metrics.with_counts(df).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)
    # tp + fp = |pred|
    assert r.tp + r.fp == 3


def test_site_report_overall_row(spark):
    c = spark.createDataFrame([("book", "a", 3, 1, 0), ("book", "b", 1, 0, 1)],
                              "category string, site string, tp long, fp long, fn long")
    rep = {(r.category, r.site): r for r in metrics.site_report(c).collect()}
    o = rep[("overall", "overall")]
    assert (o.tp, o.fp, o.fn) == (4, 1, 1)
    assert o.accuracy == pytest.approx(4 / (6 + 1e-6))
    p, rc = 4 / (5 + 1e-6), 4 / (5 + 1e-6)
    assert o.f1 == pytest.approx(2 * p * rc / (p + rc + 1e-6))

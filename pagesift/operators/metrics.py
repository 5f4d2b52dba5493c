"""Evaluation metrics (E1-E13, A8, J4, J5, U4-U6) as column and aggregate work.

Arrays of predicted and true values per (page, field) are compared with
higher-order functions; totals use map-side partial aggregation; per-site plus
overall rows come from one ``GROUPING SETS`` aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _empty() -> Column:
    return F.array().cast("array<string>")


def membership_counts(pred: Column, truth: Column) -> tuple[Column, Column, Column]:
    """tp = predictions found in truth (duplicates counted), fp = the rest,
    fn = truths not among predictions."""
    p = F.coalesce(pred, _empty())
    g = F.coalesce(truth, _empty())
    tp = F.size(F.filter(p, lambda x: F.array_contains(g, x)))
    fp = F.size(p) - tp
    fn = F.size(F.filter(g, lambda x: ~F.array_contains(p, x)))
    return tp, fp, fn


def with_counts(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    tp, fp, fn = membership_counts(F.col(pred), F.col(truth))
    return df.withColumn("tp", tp).withColumn("fp", fp).withColumn("fn", fn)


def align_fields(pred: DataFrame, truth: DataFrame, keys: list[str],
                 field: str = "field", values: str = "values") -> DataFrame:
    """Full outer join on (page keys, field); an absent side becomes []."""
    p = pred.select(*keys, field, F.col(values).alias("pred"))
    t = truth.select(*keys, field, F.col(values).alias("truth"))
    j = p.join(t, keys + [field], "full_outer")
    return j.select(*keys, field, F.coalesce("pred", _empty()).alias("pred"),
                    F.coalesce("truth", _empty()).alias("truth"))


def eval_objects(pred: DataFrame, truth: DataFrame, keys: list[str],
                 field: str = "field", values: str = "values") -> DataFrame:
    """Per-page tp/fp/fn summed over the union of fields (values already
    normalized, e.g. by ``apply_programs`` and ``normalize_values``)."""
    a = with_counts(align_fields(pred, truth, keys, field, values))
    return a.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                F.sum("fn").alias("fn"))


def scores(tp: Column, fp: Column, fn: Column, eps: float = 1e-6) -> dict[str, Column]:
    """E5 (benchmark form): accuracy = tp/(tp+fp+fn+e), f1 = 2PR/(P+R+e)."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    p = tp / (tp + fp + F.lit(eps))
    r = tp / (tp + fn + F.lit(eps))
    return {"accuracy": tp / (tp + fp + fn + F.lit(eps)), "precision": p, "recall": r,
            "f1": F.lit(2.0) * p * r / (p + r + F.lit(eps))}


def evaluator_scores(tp: Column, fp: Column, fn: Column, eps: float = 1e-8) -> dict[str, Column]:
    """E3 (evaluator form): f1 = 2tp / (2tp + fp + fn + e)."""
    tp, fp, fn = tp.cast("double"), fp.cast("double"), fn.cast("double")
    return {"precision": tp / (tp + fp + F.lit(eps)), "recall": tp / (tp + fn + F.lit(eps)),
            "f1": F.lit(2.0) * tp / (F.lit(2.0) * tp + fp + fn + F.lit(eps))}


def guarded_f1(p: Column, r: Column) -> Column:
    """F1 with a zero guard."""
    return F.when((p + r) == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def site_report(counts: DataFrame, group_cols: list[str] = ("category", "site"),
                eps: float = 1e-6, label: str = "overall", digits: int | None = None) -> DataFrame:
    """Micro totals per group plus one overall row, in one aggregation
    (``GROUPING SETS ((group...), ())``); the overall row is labelled ``label``."""
    group_cols = list(group_cols)
    agg = counts.groupingSets([group_cols, []], *group_cols).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.grouping_id().alias("_gid"))
    out = agg.select(
        *[F.when(F.col("_gid") > 0, F.lit(label)).otherwise(F.col(c)).alias(c) for c in group_cols],
        "tp", "fp", "fn")
    sc = scores(F.col("tp"), F.col("fp"), F.col("fn"), eps)
    for k, v in sc.items():
        out = out.withColumn(k, F.round(v, digits) if digits is not None else v)
    return out


def set_counts(pred: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Duplicates collapse; sizes of intersection and both differences."""
    p, g = F.array_distinct(F.coalesce(pred, _empty())), F.array_distinct(F.coalesce(truth, _empty()))
    return (F.size(F.array_intersect(p, g)), F.size(F.array_except(p, g)),
            F.size(F.array_except(g, p)))


def set_micro(df: DataFrame, pred: str = "pred", truth: str = "truth",
              by: list[str] | None = None) -> DataFrame:
    """Set-based micro precision, recall, F1 and label accuracy (0 when undefined)."""
    tp, fp, fn = set_counts(F.col(pred), F.col(truth))
    d = df.select(*(by or []), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    agg = (d.groupBy(*by) if by else d.groupBy()).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return agg.select(*(by or []), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
                      guarded_f1(p, r).alias("f1"), r.alias("label_accuracy"))


def exact_set_accuracy(df: DataFrame, pred: str = "pred", truth: str = "truth",
                       by: list[str] | None = None) -> DataFrame:
    """Share of samples whose distinct value sets are equal."""
    eq = F.array_sort(F.array_distinct(F.coalesce(F.col(pred), _empty()))) == F.array_sort(
        F.array_distinct(F.coalesce(F.col(truth), _empty())))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(eq.cast("double")).alias("exact_accuracy"),
                 F.count(F.lit(1)).alias("n_samples"))


def sample_averages(df: DataFrame, pred: str = "pred", truth: str = "truth",
                    by: list[str] | None = None) -> DataFrame:
    """Per-sample precision / recall averaged, undefined samples skipped."""
    tp, fp, fn = set_counts(F.col(pred), F.col(truth))
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(F.try_divide(tp, tp + fp)).alias("sample_precision"),
                 F.avg(F.try_divide(tp, tp + fn)).alias("sample_recall"))


def multilabel_report(df: DataFrame, sample_key: list[str], pred: str = "pred",
                      truth: str = "truth") -> tuple[DataFrame, DataFrame]:
    """Binarize over the distinct truth labels (unknown predicted labels are
    ignored). Returns (per_label, summary) where summary has micro and macro
    P/R/F1 and subset accuracy.

    Relational form: explode both sides to (sample, label) rows, semi-join
    predictions to the known label set, outer-join per (sample, label).
    """
    t = df.select(*sample_key, F.explode(F.array_distinct(truth)).alias("label")).withColumn("t", F.lit(1))
    labels = t.select("label").distinct()
    p = df.select(*sample_key, F.explode(F.array_distinct(pred)).alias("label")).join(
        labels, "label", "left_semi").withColumn("p", F.lit(1))
    j = t.join(p, sample_key + ["label"], "full_outer").fillna(0, ["t", "p"])
    per = j.groupBy("label").agg(
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum((1 - F.col("t")) * F.col("p")).alias("fp"),
        F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"))
    pr = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rc = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    per = per.select("label", "tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"),
                     guarded_f1(pr, rc).alias("f1"))
    # subset accuracy: samples whose binarized rows all agree (no mismatching label)
    mism = j.groupBy(*sample_key).agg(F.max((F.col("t") != F.col("p")).cast("int")).alias("bad"))
    samples = df.select(*sample_key).distinct().join(mism, sample_key, "left").fillna(0, ["bad"])
    subset = samples.agg(F.avg((F.col("bad") == 0).cast("double")).alias("subset_accuracy"))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                  F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                  F.avg("f1").alias("macro_f1"))
    mp = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    mr = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    summary = tot.crossJoin(subset).select(
        mp.alias("micro_precision"), mr.alias("micro_recall"), guarded_f1(mp, mr).alias("micro_f1"),
        "macro_precision", "macro_recall", "macro_f1", "subset_accuracy")
    return per, summary


def missing_surplus(pred: Column, truth: Column) -> tuple[Column, Column]:
    """Values missing from the prediction and surplus values in it."""
    p, g = F.coalesce(pred, _empty()), F.coalesce(truth, _empty())
    return F.array_except(g, p), F.array_except(p, g)


def predictions_json(df: DataFrame, keys: list[str], field: str = "field",
                     pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per page, prediction and truth as JSON objects field -> values."""
    return df.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(field, pred)))).alias("prediction"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct(field, truth)))).alias("ground_truth"))

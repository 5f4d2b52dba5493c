"""States of the pipeline's stages: odd languages, clashing names, work tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagesift.llm import common, quality

TEXT = "The river ran slowly past the old mill while the children counted boats and named the birds they saw. "


def corpus(spark, n=60, **extra):
    rows = []
    for i in range(n):
        words = [TEXT.split()[(i * 7 + j * (1 + i % 5)) % 19] + ("" if j % 3 else f"x{(i * j) % 50}") for j in range(80)]
        rows.append((i, " ".join(words) + f"\nline {i} a\nline {i} b\nline {i} c", ["en", "de", None][i % 3], "s", 0))
    rows += [(900, "", "blank1", "s", 0), (901, None, "blank2", "s", 0), (902, " \n ", "blank3", "s", 0), (903, "one", "tiny", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)


def test_languages_without_words(spark):
    rows = {r.doc_id: r for r in quality.judge(corpus(spark)).collect()}
    assert len(rows) == 64
    assert all(rows[i].base_failed and not rows[i].kept and rows[i].n_words == 0 for i in (900, 901, 902))
    only = quality.judge(corpus(spark).filter("doc_id BETWEEN 900 AND 902")).collect()
    assert len(only) == 3 and not any(r.kept for r in only)


NAMES = ["_d", "_t", "_n_lines", "_n_removed", "row", "a.b", "m", "kept", "words", "_doc", "low", "a`c"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_of_any_name_pass_every_stage(spark, tmp_path, name, stage):
    docs = corpus(spark)
    for k, c in enumerate(NAMES):
        docs = docs.withColumn(c, F.lit(k))
    spark.createDataFrame([(1, "no such item in any text at all")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == k for r in rows for k, c in enumerate(NAMES))
    last = corpus_pipeline.packing(spark, docs, str(tmp_path))
    assert last.count() >= 64


def test_stages_leave_no_work_tables(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such item in any text at all")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    base = os.path.dirname(common.fresh_path(spark, "x"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
    left = set(os.listdir(base)) - before
    # the last stage's input, and what the last stage itself reads
    assert any(x.startswith("stage-decontamination") for x in left)
    assert not any(x.startswith(("stage-quality", "stage-line", "stage-near", "quality", "bigrams", "signatures", "word"))
                   for x in left), left


def test_scratch(spark, tmp_path):
    df = spark.range(3)
    with common.scratch(spark) as keep:
        a = common.written(df, "a")
        with common.scratch(spark) as keep_inner:
            b = keep_inner(common.written(df, "b"))
            c = common.written(df, "c")
        assert b.count() == 3 and not os.path.exists(c.work_path)
        keep(a)
    assert a.count() == 3 and not os.path.exists(b.work_path)

"""A training-corpus pipeline over ``documents``: five stages, each written as
Parquet and read again as the next one's input.

Quality rules drop documents, line dedup removes repeated passages, near-dedup
keeps one document of each group, decontamination drops documents that contain
benchmark items, and packing lays the rest out in token sequences. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import noted, prepare, quoted, remove_folders, table, written
from pagesift.llm.decontaminate import drop_contaminated
from pagesift.llm.line_dedup import dedup_lines
from pagesift.llm.minhash import keep_one
from pagesift.llm.packing import pack_documents
from pagesift.llm.quality import keep_good


# work folders of the stage that was called last
_FOLDERS: list[str] = []


def _stage(run):
    """A stage's output is written before the next stage begins (or the pipeline runs
    anew): then the work tables that it was read from are deleted, unless the input
    still reads them."""

    @functools.wraps(run)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        read = "\n".join(docs.inputFiles()) if _FOLDERS else ""
        gone = [f for f in _FOLDERS if os.path.basename(f) not in read]
        remove_folders(spark, gone)
        _FOLDERS[:] = [f for f in _FOLDERS if f not in gone]
        with noted(_FOLDERS):
            return run(spark, docs, sf_dir)

    return stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the word rules and their language's perplexity bands."""
    return keep_good(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows removed; ``n_chars`` follows the text."""
    out = dedup_lines(docs).select(*[quoted(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, 80 percent)."""
    return keep_one(docs, 5, 80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in 2048-token sequences."""
    import public_tokenizers
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# perplexity, MinHash and tokenizer stages have no SQL form; the tests compare
# the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows of the last one."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if before:
                remove_folders(spark, [before])
            before = docs.work_path
    return docs

"""Quality rules: word and line measures, and n-gram perplexity bands.

Spelling is judged by the perplexity of a character n-gram model of the words of
the document's language, order by a word bigram model of that language (both
modified Kneser-Ney, counted over all documents; the word model leaves out the
document it scores). Of the latter come the perplexity per word and the gain: by
how much the words before make a word likelier than its frequency does, which
shuffled words and keyword lists lose. Each language has bands, as wide as a
multiple of the spread of the bulk of its documents, so ordinary documents stay
inside: a lower and an upper one for characters, an upper one for words, a lower
one for the gain. Very predictable texts are not rejected by the word model:
copies are such, and one of them is to stay.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.arrays import _GOLD, batch_words, dense_unique, mix
from pagesift.llm.common import broadcast_if_small, prepare, scratch, table, worker_object, written
from pagesift.llm.kneser_ney import CharModel, char_model, per_language_words, word_totals
from pagesift.llm.lm_score import Languages, Scorer, train

MIN_WORDS = 50
REPEAT_SHARE = 50  # percent of words in repeated three-word windows
# half width of a band: this many interquartile ranges beside the quartiles
UPPER_WIDTH, LOWER_WIDTH = 4.0, 8.0
GAIN_WIDTH = 4.0
# least spread of word measures, as a share of the median perplexity
WORD_SPREAD = 0.02
SYMBOLS = "[#*$%&|<>]"
_MAX_BANDS = 100_000

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "log10_ppl double, log10_word_ppl double, word_gain double")


def repeated_words(codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row: words covered by three-word windows that come twice or more."""
    m = max(0, len(codes) - 2)
    c = codes.astype(np.uint64)
    inside = row[:m] == row[2:2 + m]
    at = np.flatnonzero(inside)
    key = mix(mix(mix(c[:m] * _GOLD + c[1:1 + m]) * _GOLD + c[2:2 + m]) * _GOLD + row[:m].astype(np.uint64))[at]
    found, n = np.unique(key, return_counts=True)
    at = at[np.isin(key, found[n > 1])]
    covered = np.zeros(len(codes), dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(row[covered], minlength=rows)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text: newline-split lines with a word that equal an earlier line of it."""
    lines = pc.split_pattern(texts, "\n")
    off = lines.offsets.to_numpy(zero_copy_only=False)
    enc = lines.flatten().dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(off))
    has_word = pc.match_substring_regex(enc.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    keep = has_word.astype(bool)[code] if len(code) else np.zeros(0, dtype=bool)
    code, row = code[keep], row[keep]
    pair = row * max(1, len(enc.dictionary)) + code
    _, first = np.unique(pair, return_index=True)
    return np.bincount(row, minlength=len(texts)) - np.bincount(row[first], minlength=len(texts))


def measure_batch(langs: pa.Array, texts: pa.Array, model: CharModel, word_model: Scorer) -> pa.StructArray:
    texts = pc.fill_null(texts, "")
    rows = len(texts)
    codes, row, distinct = batch_words(texts, lower=False)
    n_words = np.bincount(row, minlength=rows)
    chars = np.bincount(row, pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[codes], rows)
    logs, units = np.zeros(rows), np.zeros(rows)
    split = codes, row, distinct
    groups, distinct = per_language_words(texts, langs, split)
    for lang, c, r in groups:
        used, inv = dense_unique(c, len(distinct))
        w_log, w_units = model.word_logs(lang, distinct.take(pa.array(used)))
        logs += np.bincount(r, w_log[inv], rows)
        units += np.bincount(r, w_units[inv], rows)
    ppl = pa.array(np.where(units > 0, -logs / np.maximum(units, 1), 0), mask=units == 0)
    tokens, plain, scores = word_model.score_without_own(texts, langs, split)
    empty, tokens = n_words == 0, np.maximum(tokens, 1)
    doubles = [ppl, pa.array(-scores / tokens, mask=empty), pa.array((scores - plain) / tokens, mask=empty)]
    ints = (n_words, chars, pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False),
            duplicate_lines(texts), repeated_words(codes, row, rows))
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return pa.StructArray.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in ints] + doubles, names)


def measures(model) -> Column:
    """Struct of all measures of a row's (lang, text)."""
    manifest, unknown, word_model = model
    key = ("quality-models", uuid.uuid4().hex)

    def make():
        return CharModel(manifest, unknown), Scorer(word_model)

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in MEASURES.split(', '))}>")
    def run(lang: pa.Array, text: pa.Array) -> pa.Array:
        return measure_batch(lang, text, *worker_object(key, make))

    return run(F.col("lang").cast("string"), F.col("text").cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def perplexity_bands(scored: DataFrame) -> DataFrame:
    """(lang, low, high, word_high, gain_low) over a language's documents that pass
    the base rules; quartiles by mergeable sketches over all rows."""
    q = scored.filter(~base_failed() & F.col("log10_ppl").isNotNull()).groupBy("lang").agg(
        *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(a)
          for c, a in (("log10_ppl", "q"), ("log10_word_ppl", "w"), ("word_gain", "g"))])
    least = WORD_SPREAD * F.col("w")[1]
    spread = F.greatest(F.col("q")[2] - F.col("q")[0], 0.01 * F.col("q")[1])
    return q.select("lang", (F.col("q")[0] - LOWER_WIDTH * spread).alias("low"),
                    (F.col("q")[2] + UPPER_WIDTH * spread).alias("high"),
                    (F.col("w")[2] + UPPER_WIDTH * F.greatest(F.col("w")[2] - F.col("w")[0], least)).alias("word_high"),
                    (F.col("g")[0] - GAIN_WIDTH * F.greatest(F.col("g")[2] - F.col("g")[0], least)).alias("gain_low"))


def _model(docs: DataFrame):
    """Both models, from two passes over the texts: words counted once for both, then
    bigrams."""
    totals = written(word_totals(docs), "word-totals")
    manifest, unknown = char_model(docs, totals=totals)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return manifest, unknown, train(rows, None, Languages(x or "" for x in unknown), totals)


def _scored(docs: DataFrame, rows) -> tuple[DataFrame, DataFrame]:
    """``rows(measures)`` with the documents' measures, written, and the bands. The
    models are gone when it returns."""
    with scratch(docs.sparkSession) as keep:
        scored = keep(written(rows(measures(_model(docs))), "quality"))
        return scored, keep(written(perplexity_bands(scored), "bands"))


def _verdict(scored: DataFrame, bands: DataFrame) -> DataFrame:
    inside = F.col("log10_ppl").isNull() | F.col("low").isNull() | (
        F.col("log10_ppl").between(F.col("low"), F.col("high")) & (F.col("log10_word_ppl") <= F.col("word_high"))
        & (F.col("word_gain") >= F.col("gain_low")))
    joined = scored.join(broadcast_if_small(bands.withColumnRenamed("lang", "band_lang"), _MAX_BANDS),
                         F.col("lang").eqNullSafe(F.col("band_lang")), "left")
    return (joined.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & inside).drop("band_lang"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, the measures, its language's bands,
    base_failed and kept.

    Null text counts as empty: no words, base_failed. A null language is the
    language ''. Repeated rows are judged alike; an empty table gives no
    rows; other columns are ignored. A language none of whose documents pass the
    base rules has no bands."""
    return _verdict(*_scored(docs, lambda m: docs.select("doc_id", "lang", m.alias("m")).select("doc_id", "lang", "m.*")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. Measured once and
    judged row by row: no join on ids, so repeated and null ids are safe."""
    scored = _scored(docs, lambda m: docs.select(F.struct("*").alias("row"), F.col("lang"), m.alias("m"))
                     .select("row", "lang", "m.*"))
    return _verdict(*scored).filter("kept").select("row.*")


def op9_quality(spark, sf_dir):
    """Quality verdict of every document."""
    prepare(spark)
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lang", "log10_ppl", "low", "high", "log10_word_ppl", "word_high", "word_gain", "gain_low")

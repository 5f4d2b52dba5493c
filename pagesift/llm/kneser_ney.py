"""Interpolated modified Kneser-Ney discounts and the character n-gram model.

The character model describes the words of one language: n-grams of character
units inside a word, with start padding and an end unit. Its parts are

* counting: tasks count the n-grams of the distinct words they meet, weighted
  by how often each word comes; Spark adds the counts up;
* estimation: SQL over the count table, one pass per order;
* storage: one row per n-gram (interpolated probability, back-off weight) in
  sorted hash arrays, which scoring tasks map into memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.arrays import _GOLD, batch_words, mix
from pagesift.llm.common import release_worker_object, scratch, written
from pagesift.llm.hash_store import SortedArrays, folder_of, parts_for, write_sorted

ORDER = 4
START, END = 2, 3
MODEL_COLS = {"p": "<f4", "gamma": "<f4"}


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 0.75 and 0.9
    where those are too few to estimate one. Always 0 < D_i <= i."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else None
    found = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if y is not None and a and b else -1
        found.append(d if 0 < d <= i else (0.5, 0.75, 0.9)[i - 1])
    return tuple(found)


def word_units(distinct: pa.Array | list[str]):
    """Character units of words, one after the other, each with its end unit.

    Returns (packed 4-grams as uint64 ending at each unit, index of its word).
    A unit is a code point of 16 bits, or for larger ones a place in the private use
    area; all digits count as ``0``."""
    if not len(distinct):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = distinct if isinstance(distinct, pa.Array) else pa.array(distinct, pa.string())
    line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")
    cp = np.frombuffer((line[0].as_py() + "\n").encode("utf-32-le"), "<u4")
    unit = np.where(cp > 0xFFFF, 0xE000 + cp % 0x18FF, cp).astype(np.uint64)
    unit[(cp >= 48) & (cp <= 57)] = 48
    ends = cp == 10
    unit[ends] = END
    word = np.cumsum(ends) - ends
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    pos = np.arange(len(cp)) - starts[word]
    gram = unit.copy()
    for k in range(1, ORDER):
        before = np.full(len(unit), START, dtype=np.uint64)
        before[k:] = unit[:-k] if k < len(unit) else before[k:]
        before[pos < k] = START
        gram |= before << np.uint64(16 * k)
    return gram, word


def per_language_words(texts: pa.Array, langs: pa.Array, split=None):
    """For each language of a batch: (language, codes, rows) and the distinct words.
    ``split`` are the batch's words, where they are known already."""
    codes, row, distinct = split or batch_words(texts, lower=False)
    enc = pc.fill_null(langs, "").dictionary_encode()
    lang_of = enc.indices.to_numpy(zero_copy_only=False)[row]
    names = enc.dictionary.to_pylist()
    return [(n, codes[lang_of == i], row[lang_of == i]) for i, n in enumerate(names)], distinct


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word comes in the texts of a language; a null
    language is ''."""

    def run(batches):
        release_worker_object()
        for b in batches:
            groups, distinct = per_language_words(b.column(1), b.column(0))
            for lang, codes, _ in groups:
                n = np.bincount(codes, minlength=len(distinct))
                used = np.flatnonzero(n)
                n = n[used]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()),
                                                  "word": distinct.take(pa.array(used)), "n": pa.array(n.astype(np.int64))})

    return (docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
            .mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def char_counts(totals: DataFrame) -> DataFrame:
    """(lang, gram, n) over the words of ``totals`` (lang, word, n)."""

    def run(batches):
        total: dict[str, tuple] = {}
        for b in batches:
            enc = b.column(0).dictionary_encode()
            which, counts = enc.indices.to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            for i, lang in enumerate(enc.dictionary.to_pylist()):
                at = np.flatnonzero(which == i)
                gram, word = word_units(b.column(1).take(pa.array(at)))
                n = counts[at]
                have = total.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
                g, inv = np.unique(np.concatenate([have[0], gram]), return_inverse=True)
                c = np.bincount(inv, np.concatenate([have[1], n[word]]), len(g)).astype(np.int64)
                total[lang] = (g, c)
                if len(g) > 2_000_000:  # bounded memory: hand over what there is
                    yield _count_rows(lang, *total.pop(lang))
        for lang, (g, c) in total.items():
            yield _count_rows(lang, g, c)

    return (totals.select("lang", "word", "n").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _count_rows(lang, g, c):
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g.view(np.int64)),
                                       "n": pa.array(c)})


def _discount(c: Column, d: Column) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def char_model(docs: DataFrame, parts: int | None = None, totals: DataFrame | None = None):
    """Estimate and store the model of the words of ``docs``, or of ``totals`` where
    they are counted already; returns (manifest, {lang: p of an unknown unit}). The
    files are ``parts`` range parts, by default as many as the model's size asks for.
    Work tables are gone when it returns."""
    with scratch(docs.sparkSession) as keep:
        manifest, unknown = _char_model(word_totals(docs) if totals is None else totals, parts)
        keep(*folder_of(manifest))
        return manifest, unknown


def _char_model(totals: DataFrame, parts: int | None):
    level = written(char_counts(totals), "char-counts")
    spark = totals.sparkSession
    orders = {}
    for k in range(ORDER, 0, -1):  # continuation counts below the highest order
        orders[k] = level
        if k > 1:
            mask = (1 << (16 * (k - 1))) - 1
            level = level.select("lang", F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).groupBy(
                "lang", "gram").agg(F.count("*").alias("n"))
    coc = [f"count_if(n = {i}) AS n{i}" for i in (1, 2, 3, 4)]
    tables = None
    for k, t in orders.items():
        t = t.selectExpr(f"{k} AS k", "*")
        tables = t if tables is None else tables.unionByName(t)
    tables = written(tables, "char-orders")
    stats = tables.groupBy("lang", "k").agg(*[F.expr(x) for x in coc]).collect()  # languages x orders
    ds = spark.createDataFrame(
        [(r.lang, r.k, list(discounts(r.n1, r.n2, r.n3, r.n4))) for r in stats],
        "lang string, k int, d array<double>")
    units = {r.lang: r.u for r in tables.filter("k = 1").groupBy("lang").agg(F.count("*").alias("u")).collect()}
    rows = (tables.join(F.broadcast(ds), ["lang", "k"])  # languages x orders rows
            .withColumn("ctx", F.expr("shiftrightunsigned(gram, 16)")))
    ctx = rows.groupBy("lang", "k", "ctx", "d").agg(F.sum("n").alias("tot"), *[F.expr(x) for x in (
        "count_if(n = 1) AS n1", "count_if(n = 2) AS n2", "count_if(n > 2) AS n3")])
    ctx = ctx.withColumn("gamma", (F.col("d")[0] * F.col("n1") + F.col("d")[1] * F.col("n2")
                                   + F.col("d")[2] * F.col("n3")) / F.col("tot")).select("lang", "k", "ctx", "tot", "gamma")
    alpha = rows.join(ctx, ["lang", "k", "ctx"]).withColumn(
        "alpha", (F.col("n") - _discount(F.col("n"), F.col("d"))) / F.col("tot")).select(
        "lang", "k", "gram", "alpha", "gamma")
    alpha = written(alpha, "char-alpha")
    u = spark.createDataFrame([(k, 1.0 / (v + 1)) for k, v in units.items()], "lang string, p0 double")
    p = None
    all_p = []
    for k in range(1, ORDER + 1):
        a = alpha.filter(F.col("k") == k)
        if k == 1:
            p = a.join(F.broadcast(u), "lang").select(
                "lang", "gram", (F.col("alpha") + F.col("gamma") * F.col("p0")).alias("p"))
        else:
            mask = (1 << (16 * (k - 1))) - 1
            low = p.select("lang", F.col("gram").alias("low"), F.col("p").alias("pl"))
            p = a.withColumn("low", F.col("gram").bitwiseAND(F.lit(mask))).join(low, ["lang", "low"]).select(
                "lang", "gram", (F.col("alpha") + F.col("gamma") * F.col("pl")).alias("p"))
        p = written(p, f"char-p{k}")
        all_p.append(p.selectExpr("lang", f"{k} AS k", "gram", "p"))
    grams = all_p[0]
    for x in all_p[1:]:
        grams = grams.unionByName(x)
    weights = ctx.selectExpr("lang", "k - 1 AS k", "ctx AS gram", "gamma")
    model = grams.join(weights.filter("k > 0"), ["lang", "k", "gram"], "full_outer").select(
        "lang", "k", "gram", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    unknown = {r.lang: r.gamma / (units[r.lang] + 1) for r in weights.filter("k = 0").collect()}

    def hashed(batches):
        for b in batches:
            g = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            enc = b.column(0).dictionary_encode()
            seeds = np.array([lang_seed(x) for x in enc.dictionary.to_pylist()] or [0], dtype=np.uint64)
            h = gram_hash(g, b.column(1).to_numpy(zero_copy_only=False).astype(np.uint64),
                          seeds[enc.indices.to_numpy(zero_copy_only=False)])
            yield pa.RecordBatch.from_pydict({"key": pa.array(h), "p": b.column(3).cast(pa.float32()),
                                              "gamma": b.column(4).cast(pa.float32())})

    manifest = write_sorted(model.mapInArrow(hashed, "key long, p float, gamma float"), "key",
                            MODEL_COLS, parts or parts_for(tables.count()), "char-model")
    return manifest, unknown


def lang_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def gram_hash(gram: np.ndarray, k, seed) -> np.ndarray:
    return mix(mix(gram * _GOLD + k) ^ seed).view(np.int64)


class CharModel:
    """Scores words of one language with a stored model."""

    def __init__(self, manifest, unknown):
        self.store, self.unknown = SortedArrays(manifest, MODEL_COLS), unknown

    def word_logs(self, lang: str, distinct: pa.Array | list[str]):
        """(log10 probability, units) of each word."""
        gram, word = word_units(distinct)
        uniq, inv = np.unique(gram, return_inverse=True)
        seed = np.uint64(lang_seed(lang))
        p = np.full(len(uniq), self.unknown.get(lang, 1e-6))
        gamma_at = None
        for k in range(1, ORDER + 1):
            g = uniq & np.uint64((1 << (16 * k)) - 1)
            if k > 1:  # back-off weight of the context, 1 where it was never seen
                at = self.store.find(gram_hash(g >> np.uint64(16), np.uint64(k - 1), seed))
                gamma_at = np.ones(len(g))
                seen = at >= 0
                gamma_at[seen] = self.store.take("gamma", at[seen])
                p = p * gamma_at
            at = self.store.find(gram_hash(g, np.uint64(k), seed))
            seen = at >= 0
            got = self.store.take("p", at[seen]).astype(np.float64)
            p[np.flatnonzero(seen)[got > 0]] = got[got > 0]
        logs = np.log10(p)[inv]
        n = len(distinct)
        return np.bincount(word, logs, n), np.bincount(word, minlength=n)

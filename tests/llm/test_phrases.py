import random
import re
from collections import Counter

import numpy as np
import pytest

from pagesift.llm import double_array, phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("vocabulary,n,m", [(1, 1, 2), (5, 12, 2), (60, 500, 3), (90_000, 30_000, 2), (90_000, 20_000, 4)])
def test_double_array(vocabulary, n, m):
    r = np.random.default_rng(n)
    draw = lambda: np.unique(np.minimum((r.pareto(0.6, (n, m)) * 3).astype(np.int64), vocabulary - 1), axis=0)
    p, q = draw(), draw()
    base, check, last = double_array.build(p, vocabulary)
    assert len(np.unique(last)) == len(p)
    assert (double_array.walk(base, check, list(p.T), vocabulary) == last).all()
    assert (double_array.spell(base, check, last, m, vocabulary) == p).all()
    have = set(map(tuple, p.tolist()))
    got = double_array.walk(base, check, list(q.T), vocabulary) >= 0
    assert got.tolist() == [tuple(x) in have for x in q.tolist()]


def brute(rows, max_words, least, percent, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, max_words + 1):
                f.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        many = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        gone = {p[i:j] for p, a in many.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= percent * f[p[i:j]]}
        rows = []
        for p, a in many.items():
            if p not in gone:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"{x}{y}" for x in ("a", "é", "\U00010003", "Q", "\x01") for y in ("", "b", "\x1f", "1")]
    out = [(None, "en"), ("", "en"), (" \t\n", None), ("one", "one"), ("x y " * 30, "xx")]
    for lang in ("en", None, "und", "fr"):
        for _ in range(40):
            w = [vocabulary[min(int(r.paretovariate(0.7)), len(vocabulary)) - 1] for _ in range(r.randint(1, 60))]
            out.append(("".join(x + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  "]) for x in w), lang))
    return out + out[5:9] * 3


@pytest.mark.parametrize("max_words,least,percent,top", [(3, 10, 50, 2000), (3, 3, 90, 7), (4, 5, 60, None), (2, 300, 50, 10)])
def test_equals_brute_force(spark, monkeypatch, max_words, least, percent, top):
    # small bounds, so that chunks, filter shards and tries are many
    monkeypatch.setattr(phrases, "TRIE_PHRASES", 7)
    monkeypatch.setattr(phrases, "FILTER_SHARD", 500)
    rows = corpus(least)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "text string, lang string, n int, rank int").repartition(3)
    got = sorted(tuple(x) for x in phrases.mine_phrases(df, max_words, least, percent, top).collect())
    assert got == brute(rows, max_words, least, percent, top)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([("a b", "en"), (None, None)], "text string, lang string")
    for x in (df, df.limit(0)):
        assert phrases.mine_phrases(x).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([("a, " * 50, "en")], "text string, lang string")).collect() == []

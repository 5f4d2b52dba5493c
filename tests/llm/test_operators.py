import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagesift.llm import decontaminate, html_text, license_scan, line_dedup, lm_score, minhash, quality, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def vocabulary(r, n=400):
    return ["".join(r.choice(["th", "er", "on", "in", "st", "ed", "wh"]) for _ in range(r.randint(1, 4))) + str(i % 7) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies, and the awkward cases."""
    r = random.Random(11)
    v = vocabulary(r)
    base = [" ".join(r.choice(v) for _ in range(r.randint(3, 260))) for _ in range(40)]
    out = [None, "", "  \n ", "one", "one two", "One  two", "NULLID"] + base
    for b in base[:25]:
        w = b.split()
        for _ in range(r.randint(1, 12)):
            c = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                c[r.randrange(len(c))] = r.choice(v)
            out.append(" ".join(c) if r.random() < 0.8 else " ".join(c).upper())
    out.append("long " * 30_000)
    return out


def shingle_set(t, n):
    w = ws(t)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, corpus, n, percent):
    d = docs([t for t in corpus if t != "NULLID"]).withColumn("cls", F.lit(1)).withColumn("root", F.lit("x"))
    rows = d.select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text, n) for r in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.near_duplicates(d, n, percent).collect()}
    assert {k: (r.component_id, r.n_shingles, r.kept) for k, r in got.items()} == {
        k: (root(k), len(sets[k]), root(k) == k) for k in sets}
    kept = [r.doc_id for r in minhash.keep_one(d.unionByName(d), n, percent).filter("text rlike '[A-Za-z]'").collect()]
    assert sorted(kept) == sorted(k for k in sets if sets[k] and root(k) == k)


def test_block_search_splits_a_bucket(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)
    d = docs([t for t in corpus if t != "NULLID"])
    split = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 3, 85).collect()}
    monkeypatch.undo()
    assert split == {r.doc_id: r.component_id for r in minhash.near_duplicates(d, 3, 85).collect()}


def test_quality_measures_equal_plain_counts(docs, corpus):
    extra = ["a\na\n\na\n b", "x y z x y z q", "### $$ %% & | <> " * 20, "the same three words " * 30, "a b c " * 40]
    d = docs(corpus + extra).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise("en")).withColumn(
        "n_words", F.lit("clash"))
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in quality.judge(d.drop("n_words")).collect():
        t = texts[r.doc_id] or ""
        w = ws(t, lower=False)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if ws(line):
                dup += line in seen
                seen.add(line)
        count = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality.keep_good(d).columns == d.columns
    assert quality.judge(docs([])).count() == 0


def test_character_model_sums_to_one(spark, docs, corpus):
    from pagesift.llm.kneser_ney import CharModel, char_model
    manifest, unknown = char_model(docs(corpus[7:30]), 2)
    model = CharModel(manifest, unknown)
    units = sorted({c for t in corpus[7:30] for c in t if c not in " \n"} - set("123456789") | {"0"})
    total = sum(10 ** model.word_logs("en", [p])[0][0] for p in [""])  # the empty word: end at once
    for u in units:  # first unit: probability of u and anything after it, from two words
        full = model.word_logs("en", [u])[0][0]
        assert full < 0
    assert 0 < total < 1


def test_language_model_equals_plain_kneser_ney(docs, corpus, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 1500)  # several shards and hot words
    texts = [t for t in corpus if t != "NULLID"][:60] + ["hot " * 4000]
    d = docs(texts).withColumn("w", F.lit(1))
    toks = {i: ws(t) + [" end"] for i, t in enumerate(texts)}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2}
    u, b, after, cont = Counter(), Counter(), defaultdict(Counter), Counter()
    for i in train:
        u.update(toks[i])
        b.update(zip([" begin"] + toks[i][:-1], toks[i]))
    for (f, s), n in b.items():
        after[f][s] = n
        cont[s] += 1
    coc = lambda c: [sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)]
    d2, d1 = lm_score.discounts(*coc(b)), lm_score.discounts(*coc(cont))
    cut = lambda n, dd: dd[min(n, 3) - 1] if n else 0
    total, big_n, size = sum(cont.values()), sum(u.values()), len(u)
    g1 = sum(cut(n, d1) for n in cont.values()) / total

    def p(f, s):
        low = max(0, cont[s] - cut(cont[s], d1)) / total + g1 / (size + 1)
        if f not in after:
            return low
        t = sum(after[f].values())
        n = after[f].get(s, 0)
        return max(0, n - cut(n, d2)) / t + sum(cut(x, d2) for x in after[f].values()) / t * low

    assert abs(sum(p(" begin", s) for s in u) + sum(cut(x, d2) for x in after[" begin"].values())
               / sum(after[" begin"].values()) * g1 / (size + 1) - 1) < 1e-9
    for r in lm_score.score_documents(d).collect():
        x = toks[r.doc_id]
        assert r.held_out == (r.doc_id not in train) and r.train_tokens == big_n
        assert (r.n_tokens, r.n_known) == (len(x), sum(w in u for w in x))
        assert r.base_score == pytest.approx(sum(math.log10((u[w] + 1) / (big_n + size + 1)) for w in x), rel=1e-6)
        assert r.score == pytest.approx(sum(math.log10(p(f, s)) for f, s in zip([" begin"] + x[:-1], x)), rel=1e-6)
    assert lm_score.score_documents(docs([])).count() == 0


def test_quality_rejects_shuffled_words(docs):
    r = random.Random(5)
    v = vocabulary(r, 300)
    after = {w: r.sample(v, 3) for w in v}

    def text():
        w = [r.choice(v)]
        while len(w) < 150:
            w.append(r.choice(after[w[-1]]))
        return w

    plain = [text() for _ in range(60)]
    salad = [r.sample(x, len(x)) for x in plain[:4]] + [[r.choice(v[:30]) for _ in range(300)]]
    texts = [" ".join(x) for x in plain + [plain[0]] * 5 + salad]
    d = docs(texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise(None))
    got = {x.doc_id: x for x in quality.judge(d).collect()}
    assert [got[i].kept for i in range(len(texts))] == [True] * 65 + [False] * 5
    assert got[65].word_gain < got[65].gain_low


def test_word_scores_without_own_counts_equal_retraining(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 1500)
    import pyarrow as pa
    texts = [t for t in corpus if t != "NULLID"][:50]
    langs = [("en", "fr")[i % 2] for i in range(len(texts))]
    rows = spark.createDataFrame(list(zip(texts, langs)), "text string, lang string")
    model = lm_score.train(rows, 2, lm_score.Languages(["en", "fr"]))
    n, plain, got = lm_score.Scorer(model).score_without_own(pa.array(texts), pa.array(langs))
    toks = [ws(t) + [" end"] for t in texts]
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0
    for i, x in enumerate(toks):
        number = model["languages"].number[langs[i]]
        d1, d2 = model["d1"][number], model["d2"][number]
        b, u = Counter(), Counter()
        for j, t in enumerate(toks):
            if j != i and langs[j] == langs[i]:
                b.update(zip([" begin"] + t[:-1], t))
                u.update(t)
        size = len({w for t, y in zip(toks, langs) if y == langs[i] for w in t})
        cont, after = Counter(), defaultdict(Counter)
        for (f, s), c in b.items():
            cont[s] += 1
            after[f][s] = c
        total = sum(cont.values())
        g1 = sum(cut(c, d1) for c in cont.values()) / total
        score = 0
        for f, s in zip([" begin"] + x[:-1], x):
            p = max(0, cont[s] - cut(cont[s], d1)) / total + g1 / (size + 1)
            if f in after:
                t = sum(after[f].values())
                p = max(0, after[f][s] - cut(after[f][s], d2)) / t + sum(cut(c, d2) for c in after[f].values()) / t * p
            score += math.log10(p)
        assert n[i] == len(x) and got[i] == pytest.approx(score, rel=1e-6)
        assert plain[i] == pytest.approx(sum(math.log10((u[w] + 1) / (sum(u.values()) + size + 1)) for w in x), rel=1e-6)


def test_leaks_equal_plain_containment(spark, docs, corpus):
    r = random.Random(2)
    v = vocabulary(r)
    items = [" ".join(r.choice(v) for _ in range(n)) for n in (3, 5, 9, 14, 30, 59)] + [None, "", "..."]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[4])], "item_id long, text string")
    texts = list(corpus)
    for it in items[:6]:
        w = it.split()
        for drop in (0, 1, 3, len(w) // 3):
            c = list(w)
            for _ in range(drop):
                c[r.randrange(len(c))] = "zzz"
            texts.append("pre fix " * 900 + ", ".join(c).upper() + "! post")
    d = docs(texts).withColumn("item_id", F.lit(5)).withColumn("h", F.lit(0))
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    expect = set()
    for i, it in [*enumerate(items), (None, items[4])]:
        w = plain(it)
        n = min(5, len(w))
        for row in d.select("doc_id", "text").collect() if w else []:
            c = len(grams(w, n) & grams(plain(row.text), n))
            if 100 * c >= 80 * len(grams(w, n)):
                expect.add((row.doc_id, i, c))
    got = {(x.doc_id, x.item_id, x.n_common) for x in decontaminate.find_leaks(d, bench).collect()}
    assert got == expect and len(got) > 10
    dirty = {x[0] for x in expect}
    clean = decontaminate.drop_contaminated(d, bench)
    assert clean.columns == d.columns and {x.doc_id for x in clean.collect()} == {
        None if t == "NULLID" else i for i, t in enumerate(texts)} - dirty
    assert decontaminate.find_leaks(d, bench.limit(0)).count() == 0


def test_line_dedup_equals_plain_windows(docs):
    r = random.Random(4)
    lines = [f"line {i}" for i in range(12)] + ["", " ", "\ttabbed "]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(120)] + [
        None, "", "a\na\na\na\na", "solo", "solo", "two\nlines", "two\nlines", "x\n" * 3000]
    d = docs(texts).withColumn("covered", F.lit(1)).withColumn("pos", F.lit("p"))
    seen, expect = set(), {}
    for i, t in enumerate(texts):
        if t is None:
            expect[i] = (None, 0, 0)
            continue
        all_lines = t.split("\n")
        at = [k for k, x in enumerate(all_lines) if x.strip(" \t\r\x0b\f")]
        key = [all_lines[k].strip(" \t\r\x0b\f") for k in at]
        w = min(3, len(key))
        gone = set()
        for k in range(len(key) - w + 1 if w else 0):
            if tuple(key[k:k + w]) in seen:
                gone |= set(at[k:k + w])
            seen.add(tuple(key[k:k + w]))
        expect[i] = ("\n".join(x for k, x in enumerate(all_lines) if k not in gone), len(key), len(gone))
    out = line_dedup.dedup_lines(d)
    assert {x.doc_id: (x.text, x["_n_lines"], x["_n_removed"]) for x in out.collect()} == expect
    assert out.columns[:len(d.columns)] == d.columns
    assert line_dedup.dedup_lines(docs([])).count() == 0


def test_line_dedup_plan_is_the_same_at_every_size(docs):
    # a broadcast of the covered lines while they are few made the disk jump once they were not
    out = line_dedup.dedup_lines(docs(["a\nb\nc", "a\nb\nc", None]))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(x.doc_id, x.text) for x in out.collect()} == {(0, "a\nb\nc"), (1, ""), (2, None)}


def test_url_filter(spark):
    urls = {"http://a.example.com/en/x?q#f": ("allow" if False else "block", "example.com/en/"),
            "HTTPS://WWW.EXAMPLE.COM/en/x": ("allow", "www.example.com/en/"), "http://example.com": ("allow", None),
            "http://notexample.com/en/1": ("allow", "com/"), "http://s.net/es/1": ("block", "net/es/"),
            "http://s.net/en/casino/1": ("block", None), "http://s.net/en/casinos": ("allow", None), "nothing": ("allow", None),
            None: ("allow", None), "": ("allow", None), "x://NET/fr/?a": ("block", "net/fr/"), "http://s.org/?login": ("allow", None),
            "http://s.org/login?x=1": ("block", None), "http://s.net/ES/1": ("allow", None)}
    rows = [(i, u, "e") for i, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.url_verdicts(pages, url_filter.rule_table(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        u = list(urls)[r.page_id]
        assert (r.verdict, r.rule) == urls[u], u
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        assert r.host == re.match(r"[^/?#]*", rest)[0].translate(LOWER) and r.path == re.match(r"[^/?#]*([^?#]*)", rest)[1]
    assert url_filter.url_verdicts(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_license_scan(spark, docs):
    notice = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
              "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    r = random.Random(9)
    v = vocabulary(r)
    plain = [" ".join(r.choice(v) for _ in range(30)) for _ in range(60)]
    d = docs([None, "", *[f"{a}\n{n}\n{b}" for n, a, b in zip(notice, plain, plain[4:])], *plain[8:]]).withColumn("w", F.lit(1))
    rows = license_scan.scan(d).filter("confirmed").collect()
    assert sorted((x.doc_id, x.line, x.family) for x in rows) == [(2, 1, "mit"), (3, 1, "apache"), (4, 1, "gpl"), (5, 1, "cc")]


def test_license_background_is_of_distinct_paragraphs(docs, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_BACKGROUND", 32)
    plain = [f"plain paragraph number {i} about nothing" for i in range(30)]
    d = docs([f"{p}\nthe same line below\nand a second one" for p in plain] * 2)
    rows = license_scan.training_rows(d).filter(F.col("family") == license_scan.UNKNOWN).collect()
    got = Counter(" ".join(r.w) for r in rows)
    assert all(got[x] == 1 for x in [*plain, "the same line below", "and a second one"])


PAGE = """<html><head><title>T</title><style>x</style></head><body><header class="site"><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies, accept them please.</p></div><div class="wrap"><div class="post-content">
<h2>Title &amp; more</h2><p>First  para with a <a href=x>link</a> inside it,
long enough.<p>Second<br>line &lt;here&gt; it is.</p><ul><li>one item</li><li>two item</li></ul></div>
<div class="sidebar"><p>Some long sidebar text which is a paragraph.</p></div>
<section id="comments"><p>Great article, thanks for the long reading.</p></section></div>
<form><p>Enter your email address to join us.</p></form><script>var a = "</p><p>no";</script><footer>Copy</footer></body></html>"""


def test_main_text(spark):
    html = [PAGE, None, "", "plain words only without any markup at all here.", "<article><h1>A</h1><p>b c</article><nav><a href=1>d</a></nav>",
            "<p>cut off in a tag <b", "<div>" * 3000 + "deep text that is long enough to count." + "</div>" * 3000]
    pages = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate(html)], "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got == {0: "Title & more\nFirst para with a link inside it, long enough.\nSecond line <here> it is.\none item\ntwo item",
                   1: "", 2: "", 3: html[3], 4: "A\nb c", 5: got[5], 6: "deep text that is long enough to count."}


def test_main_text_names_are_graded():
    long = [" ".join(f"word{i}" for i in range(k, k + 100)) + "." for k in (0, 200)]
    body = "".join(f"<p>{x}</p>" for x in long)
    side = "<div class='sidebar'><p>Some more posts to read here.</p></div><footer><p>All rights are reserved by us.</p></footer>"
    for box in ("<div class='content has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class='layoutWithSidebar'>%s</div>",
                "<div class='social-issues story'>%s</div>", "<div class='search-page'><article>%s</article></div>"):
        assert html_text.main_text(box % body + side) == "\n".join(long), box
    entry = "<article><header class='entry-header'><h1>The title</h1></header>" + body + "</article>"
    assert html_text.main_text(entry + side) == "\n".join(["The title", *long])
    # many comments beside a short post stay out
    comments = "<div id='comments'>" + "".join(f"<div class='comment-content'><p>{x}</p></div>" for x in long * 3) + "</div>"
    assert html_text.main_text("<main><article>" + body + "</article>" + comments + "</main>" + side) == "\n".join(long)


def test_minimum_cut_is_minimal():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        score = [r.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): r.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6}

        def cost(x):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(score, x)) + sum(
                w for (a, b), w in edges.items() if x[a] != x[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.minimum_cut(score, edges)) == pytest.approx(best)


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5
    d = docs([t for t in corpus if t != "NULLID"])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, corpus[20][:200])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    x = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        x = f(spark, x, str(tmp_path))
        assert x.columns == (d.columns if k < 4 else ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count()

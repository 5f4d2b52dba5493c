"""Property checks: tree invariants, metric identities, prefix dedup vs brute force."""

from hypothesis import given, settings, strategies as st

from pagesift.functions.htmltree import build_rows

TAGS = ["div", "p", "span", "ul", "li", "b", "a", "table", "tr", "td", "section"]


@st.composite
def html_fragments(draw, depth=0):
    n = draw(st.integers(0, 4 if depth < 3 else 0))
    out = []
    for _ in range(n):
        kind = draw(st.sampled_from(["text", "el", "el", "void", "comment"]))
        if kind == "text":
            out.append(draw(st.sampled_from(["x", "hello world", " ", "a&amp;b", "1 < 2"])))
        elif kind == "void":
            out.append("<br>")
        elif kind == "comment":
            out.append("<!-- c -->")
        else:
            tag = draw(st.sampled_from(TAGS))
            close = draw(st.booleans())
            inner = draw(html_fragments(depth + 1))
            out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))
    return "".join(out)


@settings(max_examples=200, deadline=None)
@given(html_fragments())
def test_tree_invariants(body):
    rows = build_rows(f"<html><body>{body}</body></html>")
    ids = [r[0] for r in rows]
    assert ids == list(range(len(rows)))                    # pre-order ids, dense
    by_id = {r[0]: r for r in rows}
    paths = set()
    for r in rows:
        node_id, end_id, parent_id = r[0], r[1], r[2]
        assert node_id <= end_id < len(rows)
        if parent_id >= 0:
            p = by_id[parent_id]
            assert p[0] < node_id <= end_id <= p[1]          # nested intervals
            assert r[3] == p[3] + 1                          # depth
            assert r[11] == p[11] + [node_id]                # ancestor ids
        assert 1 <= r[6] <= r[7]                             # sib_idx within sib_n
        assert r[8] not in paths                             # positional path is unique
        paths.add(r[8])
        assert [s[0] for s in r[15]] == list(range(1, len(r[15]) + 1))
    seqs = [s[2] for r in rows for s in r[15]]
    assert sorted(seqs) == list(range(len(seqs)))            # every chunk once


def _counts(p, g):
    tp = sum(1 for x in p if x in g)
    return tp, len(p) - tp, sum(1 for x in g if x not in p)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=4),
                          st.lists(st.sampled_from("abce"), max_size=4)), min_size=1, max_size=6))
def test_membership_counts_match_python(spark, pairs):
    from pagesift.operators import metrics
    df = spark.createDataFrame([(p, g) for p, g in pairs], "pred array<string>, truth array<string>")
    got = [(r.tp, r.fp, r.fn) for r in metrics.with_counts(df).collect()]
    assert got == [_counts(p, g) for p, g in pairs]
    for (tp, fp, fn), (p, g) in zip(got, pairs):
        assert tp + fp == len(p)


@settings(max_examples=15, deadline=None)
@given(st.sets(st.lists(st.sampled_from(["a", "b", "b[2]", "bc"]), min_size=1, max_size=3)
               .map(lambda xs: "/" + "/".join(xs)), min_size=1, max_size=6))
def test_prefix_dedup_matches_brute_force(spark, paths):
    from pagesift.operators.relational import prefix_dedup
    df = spark.createDataFrame([(1, p) for p in paths], "page_id long, path string")
    got = sorted(r.path for r in prefix_dedup(df, ["page_id"], "path").collect())
    want = sorted(p for p in paths if not any(q != p and p.startswith(q + "/") for q in paths))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.data())
def test_repeat_detection_matches_direct_search(sigs, data):
    from pagesift.operators.structure import most_repeated_run
    cls = data.draw(st.lists(st.booleans(), min_size=len(sigs), max_size=len(sigs)))
    for inc in (True, False):
        # from the definition: copies of a classed block that end where it begins
        least = 0 if inc else 1

        def copies(block):
            a, b = block
            return next(m for m in range(len(sigs) + 1) if a - (m + 1) * (b - a) < least
                        or sigs[a - (m + 1) * (b - a):a - m * (b - a)] != sigs[a:b])

        blocks = [(a, b) for a in range(len(sigs)) for b in range(a + 1, len(sigs) + 1) if any(cls[a:b])]
        top = max(blocks, key=copies, default=None)
        m = copies(top) if top else 0
        want = [(top[0] - k * (top[1] - top[0]), top[1] - k * (top[1] - top[0])) for k in range(m, -1, -1)] if m else None
        assert most_repeated_run(sigs, cls, inc) == want

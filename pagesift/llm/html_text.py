"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A logistic classifier scores each block; its
log odds are the block's terminal capacity (to the content side if positive, to
the boilerplate side if negative). Smoothness edges tie neighbouring blocks, the
more the closer they are in the DOM, and blocks of one container. The minimum cut
then labels all blocks of the page together.

Boilerplate words in an element's names are graded evidence. They weigh the less,
the more of the page's likely content the element holds (nothing from one half
on), and text evidence, other names and edges can outweigh them. Likely content
is the text whose closest telling element is an article, main or well-named one;
on pages with little of that, all text outside boilerplate tags.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import prepare, table

# ---- classifier weights (log odds)
BIAS = -0.6
IN_ARTICLE, IN_BOILERPLATE, IN_ARTICLE_HEADER = 3.5, -9.0, -0.5
GOOD_NAME, BAD_NAME, MORE_BAD_NAMES = 2.0, -6.0, -1.5
# least share of a page's text that counts as its likely content by names
LIKELY_SHARE = 0.1
TEXT_TAG, HEADING, LINKS, LOG_WORDS, SENTENCE = 0.8, 0.6, -4.5, 0.45, 0.5
# ---- smoothness
NEIGHBOUR, CONTAINER, FAR = 1.2, 0.4, 12

SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "object", "select", "button",
        "textarea", "title", "math", "canvas", "audio", "video", "datalist", "head"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
         "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# a start tag closes an open element of the given kinds
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# all that may stand in a head; anything else ends it, whether it was closed or not
HEAD = {"html", "head", "title", "meta", "link", "style", "script", "base", "noscript", "template", "basefont", "bgsound"}
# a block that starts inside one of these shows that its end tag is missing
UNCLOSED = {"select", "datalist", "svg", "math"}
# the same for a button, which may hold plain boxes
NOT_IN_BUTTON = BLOCK - {"div", "center", "hr"}
BAD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sidebar",
       "menu", "nav", "navbar", "navigation", "footer", "header", "masthead", "comment", "comments",
       "disqus", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "banner", "popup", "modal",
       "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended",
       "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "promo", "login", "search", "toolbar"}
# before a boilerplate word: the element only says whether there is such a part
ABOUT = {"has", "have", "no", "not", "with", "without", "hide", "hidden"}
GOOD = {"article", "content", "entry", "post", "story", "main", "text", "body", "maincontent"}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*'|[\"'](?=[^\"'>]*(?:>|\Z)))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)


class Block:
    __slots__ = ("parts", "linked", "element", "score")

    def __init__(self, element, score):
        self.parts, self.linked, self.element, self.score = [], 0, element, score


def _names(attrs: str) -> set[str]:
    found = set()
    for m in _NAME.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value)
        for name in value.lower().split():
            words = _WORD.findall(name)
            # has-left-sidebar: what follows describes the page, not the element
            cut = next((k for k, w in enumerate(words) if w in ABOUT), len(words))
            found.update(words[:cut])
    return found


def page_blocks(page: str):
    """(blocks, parents, depths, bad, telling): text blocks in page order, and for each
    element its parent, its depth, the weight of the boilerplate words in its names,
    and what it tells of its text (1 content, -1 boilerplate words, -2 a boilerplate
    tag, 0 nothing). Block scores are without the names' weight. Open elements are kept on an explicit stack, so nesting
    depth costs nothing but that stack."""
    parents, depths, bad, telling = [-1], [0], [0.0], [0]
    # element: (tag, number, score from ancestors, inside article, hidden)
    stack = [("", 0, 0.0, False, False)]
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    current: Block | None = None
    in_link = 0
    at, n = 0, len(page)

    def add(text):
        nonlocal current
        top = stack[-1]
        if top[0] == "head" and text.strip():
            close(len(stack) - 1)
            top = stack[-1]
        if top[4]:
            return
        if current is None:
            if not text.strip():
                return
            current = Block(top[1], top[2] + (TEXT_TAG if top[0] in ("p", "blockquote", "pre") else 0)
                            + (HEADING if top[0][:1] == "h" and top[0][1:].isdigit() else 0))
            blocks.append(current)
        current.parts.append(text)
        if in_link:
            current.linked += len(text)

    def close(k):
        nonlocal current, in_link
        if in_link > k:
            in_link = 0  # the link's own block ends
        for entry in stack[k:]:
            opened[entry[0]] -= 1
        del stack[k:]
        current = None

    def close_last(tags):
        close(max(k for k, entry in enumerate(stack) if entry[0] in tags))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        if at == m.start():
            break
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif opened.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            elif tag in BLOCK:
                current = None
            continue
        if tag not in HEAD and opened.get("head"):
            close_last({"head"})
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        if tag == "a":
            # an anchor without an address is no link, and ends one that was left open
            in_link = len(stack) if _HREF.search(m[3]) else 0
            continue
        if tag in VOID:
            if tag == "hr":
                current = None
            continue
        if tag not in BLOCK and tag not in SKIP:
            if _HIDDEN.search(m[3]) is None and not (m[3] and _names(m[3]) & BAD):
                continue  # plain inline markup
        if tag in BLOCK:
            if any(opened.get(t) for t in UNCLOSED):
                close_last(UNCLOSED)
            if tag in NOT_IN_BUTTON and opened.get("button"):
                close_last({"button"})
            if opened.get("p") and tag not in ("html", "body"):
                k = len(stack) - 1
                while stack[k][0] not in ("p", "td", "th", "table") and k:
                    k -= 1
                if stack[k][0] == "p":
                    close(k)
            if tag in CLOSES and stack[-1][0] in CLOSES[tag]:
                close(len(stack) - 1)
                if tag == "tr" and stack[-1][0] == "tr":
                    close(len(stack) - 1)
            current = None
            in_link = in_link if tag != "p" else 0
        _, parent, score, article, hidden = stack[-1]
        names = _names(m[3]) if m[3] else set()
        if tag == "body":
            names = set()
        if tag in ("article", "main"):
            score, article = score + (0 if article else IN_ARTICLE), True
        elif tag in BOILERPLATE:
            score += IN_BOILERPLATE
        elif tag == "header":
            score += IN_ARTICLE_HEADER if article else IN_BOILERPLATE
        if tag == "header":
            names.discard("header")  # the tag has said so
        if names & GOOD:
            score += GOOD_NAME
        n_bad = len(names & BAD)
        boilerplate = tag in BOILERPLATE or tag == "header" and not article
        bad.append(BAD_NAME + MORE_BAD_NAMES * (min(n_bad, 3) - 1) if n_bad else 0.0)
        telling.append(-2 if boilerplate else -1 if n_bad else 1 if tag in ("article", "main") or names & GOOD else 0)
        number = len(parents)
        parents.append(parent)
        depths.append(depths[parent] + 1)
        hidden = hidden or tag in SKIP or bool(m[3] and _HIDDEN.search(m[3]))
        if m[3].endswith("/") and tag in SKIP:
            continue
        stack.append((tag, number, score, article, hidden))
        opened[tag] = opened.get(tag, 0) + 1
    return blocks, parents, depths, bad, telling


def name_scores(blocks, parents, bad, telling) -> list[float]:
    """Weight of boilerplate words on each element's text, from all its ancestors."""
    n = len(parents)
    closest, outside = [0] * n, [True] * n  # of boilerplate tags
    for i in range(1, n):  # parents come first
        closest[i] = telling[i] or closest[parents[i]]
        outside[i] = telling[i] != -2 and outside[parents[i]]
    likely, text = [0] * n, [0] * n
    total = 0
    for b in blocks:
        size = sum(map(len, b.parts)) - b.linked
        total += size
        likely[b.element] += size if closest[b.element] == 1 and outside[b.element] else 0
        text[b.element] += size if outside[b.element] else 0
    for sums in (likely, text):
        for i in range(n - 1, 0, -1):
            sums[parents[i]] += sums[i]
    held = likely if likely[0] and likely[0] >= LIKELY_SHARE * total else text
    out = [0.0] * n
    for i in range(1, n):
        share = held[i] / held[0] if held[0] else 0.0
        out[i] = out[parents[i]] + bad[i] * max(0.0, 1 - 2 * share)
    return out


def dom_distance(a: int, b: int, parents, depths) -> int:
    """Steps between two elements, at most ``FAR``."""
    steps = 0
    while a != b and steps < FAR:
        if depths[a] >= depths[b]:
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return FAR if a != b else steps


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) that minimize the sum of what disagreeing blocks and
    cut edges cost.

    A block whose own capacity exceeds all its open edges keeps its label in some
    minimum cut; it is fixed first and its edges become terminal capacity of its
    neighbours. What is left, if anything, goes through augmenting-path max-flow."""
    n = len(score)
    score = list(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(score[i]) < sum(near[i].values()):
            continue
        label[i] = score[i] > 0
        for j, w in near[i].items():
            score[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        s, t = n, n + 1
        cap: list[dict[int, float]] = [dict(d) for d in near] + [{}, {}]
        for i in rest:
            if score[i] > 0:
                cap[s][i], cap[i][s] = score[i], 0.0
            else:
                cap[i][t], cap[t][i] = -score[i], 0.0
        while True:
            came = {s: s}
            queue = deque([s])
            while queue and t not in came:
                u = queue.popleft()
                for v, c in cap[u].items():
                    if c > 1e-9 and v not in came:
                        came[v] = u
                        queue.append(v)
            if t not in came:
                break
            path, v = [], t
            while v != s:
                path.append((came[v], v))
                v = came[v]
            flow = min(cap[u][v] for u, v in path)
            for u, v in path:
                cap[u][v] -= flow
                cap[v][u] = cap[v].get(u, 0.0) + flow
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The page's content blocks, decoded, one per line; empty if there are none."""
    blocks, parents, depths, bad, telling = page_blocks(page or "")
    names = name_scores(blocks, parents, bad, telling)
    texts, scores, kept = [], [], []
    for b in blocks:
        raw = "".join(b.parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if not text:
            continue
        score = (BIAS + b.score + names[b.element] + LINKS * b.linked / max(1, len(raw)) + LOG_WORDS * math.log2(1 + text.count(" "))
                 + (SENTENCE if text[-1] in ".!?…:;\"'”»)" else 0))
        texts.append(text)
        scores.append(score)
        kept.append(b)
    edges: dict[tuple[int, int], float] = {}
    last_in: dict[int, int] = {}
    for i, b in enumerate(kept):
        if i:
            d = dom_distance(kept[i - 1].element, b.element, parents, depths)
            if d < FAR:
                edges[i - 1, i] = NEIGHBOUR / (1 + d)
        box = parents[b.element]
        if box in last_in:
            k = (last_in[box], i)
            edges[k] = edges.get(k, 0) + CONTAINER
        last_in[box] = i
    return "\n".join(t for t, keep in zip(texts, minimum_cut(scores, edges)) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Each page is worked on alone, in whole. Null and empty html give an empty
    text; markup that breaks off ends the page there; null ids and urls and
    repeated rows pass through; an empty table gives no rows; other columns are
    ignored."""

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark, sf_dir):
    """Main text of every page."""
    prepare(spark)
    return extract_text(table(spark, sf_dir, "pages"))

"""Per-page helper: HTML string -> flat list of node rows.

This is the only per-row Python in the DOM path. It runs inside the
``mapInPandas`` task of :func:`pagesift.operators.dom.explode_dom`; all later
work (cleaning, paths, programs, metrics) is Spark over the resulting table.

Tokenizing is the stdlib ``html.parser``. Tree building follows a subset of
the WHATWG HTML parsing rules: implied ``html/head/body``, implied ``tbody``
and ``tr``, implied end tags (``p``, ``li``, ``dd/dt``, ``td/th``, ``tr``,
``option``), void and raw-text elements, and re-opening of unclosed
formatting elements (``<p><b>x<p>y`` gives a ``b`` inside the second ``p``).
Foster parenting and the full adoption agency are not built: a misnested
formatting end tag simply closes up to its element.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# ---- fixed values: element classes of the HTML parsing rules -------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split())
HEAD_TAGS = frozenset(
    "base basefont bgsound link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
    "ol p pre section summary table ul li dd dt listing xmp search".split())
FORMATTING_TAGS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE_STOP = frozenset("applet caption html table td th marquee object template".split())
MARKER_TAGS = frozenset("applet object marquee template td th caption".split())
TABLE_PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
TABLE_SCOPE = frozenset("html table template".split())
SPECIAL_TAGS = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button "
    "caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img "
    "input keygen li link listing main marquee menu meta nav noembed noframes noscript "
    "object ol p param plaintext pre script search section select source style summary "
    "table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
# Inline elements (text flows on the same line when rendered).
INLINE_TAGS = frozenset([
    "a", "abbr", "acronym", "b", "bdo", "big", "br", "button", "cite", "code", "dfn", "em", "i", "img",
    "input", "kbd", "label", "map", "object", "output", "q", "samp", "script", "select", "small", "span",
    "strong", "sub", "sup", "textarea", "time", "tt", "var",
])
HIDDEN_TAGS = frozenset("script style noscript template".split())
# --------------------------------------------------------------------------

_DISPLAY_NONE = re.compile(r"display\s*:\s*none")
COMMENT = "#comment"


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children", "text", "tail")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.parent = parent
        self.children = []
        self.text = None
        self.tail = None


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.html = self._new("html", {}, None)
        self.head = None
        self.body = None
        self.stack = [self.html]
        self.afe: list = []  # active formatting elements; None is a marker

    # -- tree primitives ---------------------------------------------------
    def _new(self, tag, attrs, parent):
        n = _Node(tag, attrs, parent)
        self.nodes.append(n)
        if parent is not None:
            parent.children.append(n)
        return n

    def _push(self, tag, attrs):
        n = self._new(tag, attrs, self.stack[-1])
        self.stack.append(n)
        if tag in MARKER_TAGS:
            self.afe.append(None)
        return n

    def _pop(self):
        n = self.stack.pop()
        if n.tag in MARKER_TAGS:
            while self.afe:
                if self.afe.pop() is None:
                    break
        return n

    def _pop_until(self, tag):
        while len(self.stack) > 1:
            if self._pop().tag == tag:
                return

    def _in_scope(self, tags, extra_stop=frozenset(), stop=SCOPE_STOP):
        for n in reversed(self.stack):
            if n.tag in tags:
                return True
            if n.tag in stop or n.tag in extra_stop:
                return False
        return False

    def _implied_end(self, exclude=None):
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != exclude:
            self._pop()

    def _close_p(self):
        if self._in_scope({"p"}, {"button"}):
            self._implied_end("p")
            self._pop_until("p")

    def _ensure_body(self):
        if self.body is None:
            while len(self.stack) > 1:
                self._pop()
            self.body = self._push("body", {})

    def _ensure_head(self):
        if self.head is None:
            self.head = self._new("head", {}, self.html)
        if self.stack[-1] is not self.head:
            self.stack.append(self.head)

    def _reconstruct(self):
        if not self.afe or self.afe[-1] is None or self.afe[-1] in self.stack:
            return
        i = len(self.afe) - 1
        while i > 0 and self.afe[i - 1] is not None and self.afe[i - 1] not in self.stack:
            i -= 1
        for j in range(i, len(self.afe)):
            old = self.afe[j]
            self.afe[j] = self._push(old.tag, dict(old.attrs))

    def _add_formatting(self, n):
        same = [e for e in self._afe_tail() if e.tag == n.tag and e.attrs == n.attrs]
        if len(same) >= 3:
            self.afe.remove(same[0])
        self.afe.append(n)

    def _afe_tail(self):
        out = []
        for e in reversed(self.afe):
            if e is None:
                break
            out.append(e)
        return out[::-1]

    def _end_formatting(self, tag):
        entry = next((e for e in reversed(self._afe_tail()) if e.tag == tag), None)
        if entry is None:
            return False
        if entry in self.stack:
            while len(self.stack) > 1 and self._pop() is not entry:
                pass
        self.afe.remove(entry)
        return True

    def _text(self, data):
        cur = self.stack[-1]
        if cur.children:
            last = cur.children[-1]
            last.tail = data if last.tail is None else last.tail + data
        else:
            cur.text = data if cur.text is None else cur.text + data

    # -- tokenizer callbacks -----------------------------------------------
    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            if k not in a:
                a[k] = "" if v is None else v
        self._start(tag, a)
        if tag in VOID_TAGS and self.stack[-1].tag == tag:
            self._pop()

    def handle_startendtag(self, tag, attrs):
        # HTML5 ignores the self-closing flag on non-void elements
        self.handle_starttag(tag, attrs)

    def _start(self, tag, a):
        if tag == "html":
            for k, v in a.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.body is None:
                self._ensure_head()
            return
        if tag == "body":
            if self.body is None:
                self._ensure_body()
                self.body.attrs.update(a)
            else:
                for k, v in a.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD_TAGS:
                self._ensure_head()
                self._push(tag, a)
                return
            self._ensure_body()
        if tag in CLOSES_P:
            if tag in ("li", "dd", "dt"):
                self._close_list_item(tag)
            self._close_p()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].tag in (
                    "h1", "h2", "h3", "h4", "h5", "h6"):
                self._pop()
            self._push(tag, a)
            return
        if tag in ("tbody", "thead", "tfoot"):
            self._close_table_section()
            self._push(tag, a)
            return
        if tag == "tr":
            self._close_row()
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            self._push(tag, a)
            return
        if tag in ("td", "th"):
            self._close_cell()
            if self.stack[-1].tag == "table":
                self._push("tbody", {})
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push("tr", {})
            self._push(tag, a)
            return
        if tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self._pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self._pop()
            self._reconstruct()
            self._push(tag, a)
            return
        if tag in FORMATTING_TAGS:
            if tag == "a" and any(e.tag == "a" for e in self._afe_tail()):
                self._end_formatting("a")
            self._reconstruct()
            self._add_formatting(self._push(tag, a))
            return
        self._reconstruct()
        self._push(tag, a)

    def _close_list_item(self, tag):
        group = {"li"} if tag == "li" else {"dd", "dt"}
        for n in reversed(self.stack):
            if n.tag in group:
                self._implied_end(n.tag)
                self._pop_until(n.tag)
                return
            if n.tag in SPECIAL_TAGS and n.tag not in ("address", "div", "p"):
                return

    def _close_cell(self):
        if self._in_scope({"td", "th"}, {"tr", "tbody", "thead", "tfoot"}) is False:
            return
        while len(self.stack) > 1 and self.stack[-1].tag not in ("td", "th"):
            self._pop()
        self._pop()

    def _close_row(self):
        for n in reversed(self.stack):
            if n.tag == "tr":
                self._pop_until("tr")
                return
            if n.tag in ("table", "html"):
                return

    def _close_table_section(self):
        for n in reversed(self.stack):
            if n.tag in ("tbody", "thead", "tfoot"):
                self._pop_until(n.tag)
                return
            if n.tag in ("table", "html"):
                return

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return  # content after </body> still goes into body
        if tag == "head":
            if self.stack[-1] is self.head:
                self.stack.pop()
            return
        if tag == "br":
            self._start("br", {})
            self._pop()
            return
        if tag == "p" and not self._in_scope({"p"}, {"button"}):
            self._ensure_body()
            self._push("p", {})
            self._pop()
            return
        if tag in FORMATTING_TAGS and self._end_formatting(tag):
            return
        if tag in TABLE_PARTS:
            if self._in_scope({tag}, stop=TABLE_SCOPE):
                self._implied_end(tag)
                self._pop_until(tag)
            return
        if tag in SPECIAL_TAGS:
            if self._in_scope({tag}, {"ul", "ol"} if tag == "li" else frozenset()):
                self._implied_end(tag)
                self._pop_until(tag)
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self._implied_end(tag)
                while self._pop() is not n:
                    pass
                return
            if n.tag in SPECIAL_TAGS:
                return

    def handle_data(self, data):
        if not data:
            return
        cur = self.stack[-1]
        if self.body is None and cur is self.html:
            if not data.strip():
                return
            self._ensure_body()
        elif self.body is None and cur is self.head:
            if data.strip():
                self.stack.pop()
                self._ensure_body()
        if cur.tag not in HIDDEN_TAGS and cur.tag not in ("title", "textarea"):
            self._reconstruct()
        self._text(data)

    def parse_marked_section(self, i, report=1):
        """``<![...]`` in HTML is a comment up to the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        if end < 0:
            return -1
        if report:
            self.handle_comment(self.rawdata[i + 2:end])
        return end + 1

    def handle_comment(self, data):
        c = self._new(COMMENT, {}, self.stack[-1])
        c.text = data

    def handle_entityref(self, name):  # only reached when convert_charrefs is off
        self.handle_data(f"&{name}")


# XML 1.0 illegal characters, removed before parsing, raw or as char refs.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_CHARREF = re.compile(r"&#([xX][0-9a-fA-F]+|[0-9]+);?")


def _illegal_code(n: int) -> bool:
    return (n <= 0x8 or n in (0xB, 0xC, 0xFFFE, 0xFFFF) or 0xE <= n <= 0x1F
            or 0xD800 <= n <= 0xDFFF)


def _drop_illegal_ref(m):
    g = m.group(1)
    n = int(g[1:], 16) if g[0] in "xX" else int(g)
    return "" if _illegal_code(n) else m.group(0)


def strip_illegal_xml(s: str) -> str:
    if "&#" in s:
        s = _CHARREF.sub(_drop_illegal_ref, s)
    return _ILLEGAL.sub("", s)


def build_rows(html: str):
    """Parse one page; return a list of node tuples in pre-order.

    Tuple: (node_id, end_id, parent_id, depth, child_ord, tag, sib_idx, sib_n,
    xpath, tag_path, sib_path, anc_ids, attrs, text, tail, text_slots, start_seq) where
    text_slots is a list of (idx, text, seq, brk, vis) for every non-empty own
    text and child tail (idx counts only those, like XPath ``text()[i]``) and
    start_seq is the document-order position of the element among text chunks.
    """
    b = _TreeBuilder()
    try:
        b.feed(strip_illegal_xml(html or ""))
        b.close()
    except Exception as e:  # never silent: the page's table shows where it broke off
        b.handle_comment(f"parse error: {type(e).__name__}")
    nodes = b.nodes
    ids = {id(n): i for i, n in enumerate(nodes)}
    rows = []
    end = [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        end[i] = end[ids[id(n.children[-1])]] if n.children else i
    sib = [(1, 1, 1)] * len(nodes)  # (child_ord, sib_idx, sib_n)
    for n in nodes:
        if n.children:
            counts = {}
            for c in n.children:
                counts[c.tag] = counts.get(c.tag, 0) + 1
            seen = {}
            for k, c in enumerate(n.children):
                seen[c.tag] = seen.get(c.tag, 0) + 1
                sib[ids[id(c)]] = (k + 1, seen[c.tag], counts[c.tag])
    info = [None] * len(nodes)  # (depth, xpath, tag_path, sib_path, anc_ids, hidden)
    seq = 0
    brk = False
    slots_of = [[] for _ in nodes]

    def emit(owner, text):
        nonlocal seq, brk
        lst = slots_of[owner]
        vis = not info[owner][5] and nodes[owner].tag != COMMENT
        lst.append((len(lst) + 1, text, seq, brk, vis))
        seq += 1
        brk = False

    # iterative pre-order walk with explicit close events for tails
    stack = [(0, False)]
    while stack:
        i, closing = stack.pop()
        n = nodes[i]
        block = n.tag not in INLINE_TAGS or n.tag == "br"
        if closing:
            if block:
                brk = True
            if n.tail and n.parent is not None:
                emit(ids[id(n.parent)], n.tail)
            continue
        p = n.parent
        if p is None:
            info[i] = (0, "/" + n.tag, "/" + n.tag, [1], [i], False)
            child_ord = sib_idx = sib_n = 1
            parent_id = -1
        else:
            pi = ids[id(p)]
            parent_id = pi
            child_ord, sib_idx, sib_n = sib[i]
            pd_, px, pt, ps, pa, ph = info[pi]
            step = "comment()" if n.tag == COMMENT else n.tag
            xp = f"{px}/{step}[{sib_idx}]" if sib_n > 1 else f"{px}/{step}"
            hidden = ph or n.tag in HIDDEN_TAGS or bool(
                _DISPLAY_NONE.search(n.attrs.get("style", "")))
            info[i] = (pd_ + 1, xp, f"{pt}/{step}", ps + [sib_idx], pa + [i], hidden)
        if block:
            brk = True
        start_seq = seq
        if n.tag != COMMENT and n.text:
            emit(i, n.text)
        d, xp, tp, sp, anc, _ = info[i]
        rows.append([i, end[i], parent_id, d, child_ord, n.tag, sib_idx, sib_n, xp, tp, sp, anc,
                     n.attrs, n.text, n.tail, None, start_seq])
        stack.append((i, True))
        for c in reversed(n.children):
            stack.append((ids[id(c)], False))
    for r in rows:
        r[15] = slots_of[r[0]]
    return rows


"""A small, sandboxed template language for chat formats, compiled to closures.

``{{ value }}`` prints, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in list %} {% endfor %}``, ``{% set x = value %}`` and ``{% generation %}
{% endgeneration %}`` (the text a model is to learn) steer; ``-`` inside a tag trims
the white space beside it, ``{# #}`` is a comment. Values are literals, names,
``a.b``, ``a['b']``, ``a if c else b``, ``or and not``, comparisons, ``in``, ``+ - %``,
``~`` (joins texts) and filters ``value | name``.

The sandbox: a template reaches only the values it is given, keys of dictionaries and
items of lists; no attributes, calls or imports, and no loop but over given lists.
Parts without names of the row are computed once, when the template is compiled.
"""

from __future__ import annotations

import re

_TAGS = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)"
                    r"|(?P<op>==|!=|<=|>=|[-<>+%~|.\[\]()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b, "~": lambda a, b: text_of(a) + text_of(b),
}
# binary operators, loosest first
_LEVELS = [("==", "!=", "<=", ">=", "<", ">", "in", "not in"), ("~",), ("+", "-"), ("%",)]


class TemplateError(ValueError):
    pass


def text_of(value) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


def _item(value, key):
    """A key of a dictionary or an item of a list; None if there is none."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


def _operate(op, a, b):
    if op in ("-", "%") and not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError(f"{op} takes whole numbers")
    try:
        return _COMPARE[op](a, b)
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(f"{op}: {e}") from None


# --- syntax tree: tuples whose first item is the kind -----------------------

class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else None

    def take(self, *expected):
        if self.at >= len(self.tokens) or (expected and self.peek() not in expected):
            raise TemplateError(f"expected {' or '.join(expected) or 'a value'}, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()}")
        return tree

    def choice(self):
        yes = self.either()
        if self.peek() != "if":
            return yes
        self.take()
        test = self.either()
        self.take("else")
        return ("choice", test, yes, self.choice())

    def either(self):
        tree = self.both()
        while self.peek() == "or":
            self.take()
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negation()
        while self.peek() == "and":
            self.take()
            tree = ("and", tree, self.negation())
        return tree

    def negation(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negation())
        return self.binary(0)

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.value()
        tree = self.binary(level + 1)
        while True:
            op = "not in" if self.peek() == "not" and self.peek(1) == "in" else self.peek()
            if op not in _LEVELS[level] or self.tokens[self.at][0] == "str":
                return tree
            for _ in op.split():
                self.take()
            tree = ("op", op, tree, self.binary(level + 1))

    def value(self):
        kind, got = self.take()
        if kind == "num":
            tree = ("const", int(got))
        elif kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), got[1:-1], flags=re.S))
        elif got == "(":
            tree = self.choice()
            self.take(")")
        elif kind == "name":
            known = {"true": True, "false": False, "none": None}
            tree = ("const", known[got]) if got in known else ("name", got)
        else:
            raise TemplateError(f"unexpected {got}")
        while self.peek() in (".", "[", "|") and self.tokens[self.at][0] == "op":
            _, mark = self.take()
            if mark == "[":
                tree = ("item", tree, self.choice())
                self.take("]")
            else:
                kind, name = self.take()
                if kind != "name":
                    raise TemplateError(f"a name must follow {mark}")
                tree = ("item", tree, ("const", name)) if mark == "." else ("filter", name, tree)
        return tree


def _pieces(source: str):
    """(kind, body) of texts and tags, with the trimming of ``-`` applied."""
    at, trim, out = 0, False, []
    while True:
        m = _TAGS.search(source, at)
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        if m and m.group().endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            return out
        opening = m.group()[:2]
        close = source.find({"{{": "}}", "{%": "%}", "{#": "#}"}[opening], m.end())
        if close < 0:
            raise TemplateError(f"{opening} is not closed")
        body = source[m.end():close]
        trim = opening != "{#" and body.endswith("-")
        if opening != "{#":
            out.append((opening, body[:-1] if trim else body))
        at = close + 2


def parse(source: str):
    """The template as a list of nodes."""
    pieces = _pieces(source)
    pos = 0

    def block(*ends):
        nonlocal pos
        nodes = []
        while pos < len(pieces):
            kind, body = pieces[pos]
            pos += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "{{":
                nodes.append(("print", _Expression(body).whole()))
            else:
                word, _, rest = body.strip().partition(" ")
                if word in ends:
                    return nodes, word, rest
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return nodes, None, ""

    def statement(word, rest):
        if word == "if":
            arms, otherwise = [], []
            while True:
                test = _Expression(rest).whole()
                body, end, rest = block("elif", "else", "endif")
                arms.append((test, body))
                if end == "else":
                    otherwise, _, _ = block("endif")
                if end != "elif":
                    return ("if", arms, otherwise)
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            body, _, _ = block("endfor")
            return ("for", m[1], _Expression(m[2]).whole(), body)
        if word == "set":
            name, sep, value = rest.partition("=")
            if not sep or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                raise TemplateError(f"set {rest}")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            body, _, _ = block("endgeneration")
            return ("generation", body)
        raise TemplateError(f"unknown tag {word}")

    return block()[0]


# --- constant folding -------------------------------------------------------

def fold(tree, constants: dict, filters: dict):
    """An expression with everything computed that needs no value of the row."""
    kind = tree[0]
    if kind == "const":
        return tree
    if kind == "name":
        return ("const", constants[tree[1]]) if tree[1] in constants else tree
    parts = [fold(x, constants, filters) if isinstance(x, tuple) else x for x in tree[1:]]
    if kind == "filter" and parts[0] not in filters:
        raise TemplateError(f"unknown filter {parts[0]}")
    if kind in ("and", "or", "choice") and parts[0][0] == "const":
        first = parts[0][1]
        if kind == "choice":
            return parts[1] if first else parts[2]
        return parts[1] if bool(first) == (kind == "and") else parts[0]
    node = (kind, *parts)
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return ("const", evaluator(node, filters)({}))
    return node


def fold_nodes(nodes, constants: dict, filters: dict):
    """Nodes with constant parts computed, untaken arms dropped and neighbouring texts
    joined. A name that the template itself sets or loops over is no constant."""
    out = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        kind = node[0]
        if kind == "text":
            add(node)
        elif kind == "print":
            value = fold(node[1], constants, filters)
            add(("text", text_of(value[1])) if value[0] == "const" else ("print", value))
        elif kind == "set":
            add(("set", node[1], fold(node[2], constants, filters)))
        elif kind == "generation":
            add(("generation", fold_nodes(node[1], constants, filters)))
        elif kind == "for":
            inner = {k: v for k, v in constants.items() if k not in (node[1], "loop")}
            add(("for", node[1], fold(node[2], constants, filters), fold_nodes(node[3], inner, filters)))
        else:
            arms, otherwise = [], fold_nodes(node[2], constants, filters)
            for test, body in node[1]:
                test = fold(test, constants, filters)
                if test[0] == "const" and not test[1]:
                    continue
                body = fold_nodes(body, constants, filters)
                if test[0] == "const":
                    otherwise = body
                    break
                arms.append((test, body))
            if arms:
                add(("if", arms, otherwise))
            else:
                for n in otherwise:
                    add(n)
    return out


def names_set(nodes) -> set:
    """Names that a template sets or loops over, at any depth."""
    found = set()
    for node in nodes:
        if node[0] in ("set", "for"):
            found.add(node[1])
        bodies = {"for": [node[-1]], "generation": [node[-1]]}.get(node[0], [])
        if node[0] == "if":
            bodies = [b for _, b in node[1]] + [node[2]]
        for b in bodies:
            found |= names_set(b)
    return found


# --- closures ---------------------------------------------------------------

def evaluator(tree, filters: dict):
    """A function of the scope that computes an expression."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "filter":
        inner, apply = evaluator(tree[2], filters), filters[tree[1]]
        return lambda scope: apply(inner(scope))
    if kind == "op":
        op, a, b = tree[1], evaluator(tree[2], filters), evaluator(tree[3], filters)
        if op == "==":
            return lambda scope: a(scope) == b(scope)
        return lambda scope: _operate(op, a(scope), b(scope))
    parts = [evaluator(x, filters) for x in tree[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    a, b = parts[:2]
    if kind == "item":
        return lambda scope: _item(a(scope), b(scope))
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: b(scope) if a(scope) else parts[2](scope)


def emitter(nodes, filters: dict, learned: bool = False):
    """A function (scope, out) that appends (text, learned) pairs."""
    steps = [_step(n, filters, learned) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope, out):
        for s in steps:
            s(scope, out)
    return run


def _step(node, filters, learned):
    kind = node[0]
    if kind == "text":
        pair = (node[1], learned)
        return lambda scope, out: out.append(pair)
    if kind == "print":
        value = evaluator(node[1], filters)
        return lambda scope, out: out.append((text_of(value(scope)), learned))
    if kind == "generation":
        return emitter(node[1], filters, True)
    if kind == "set":
        name, value = node[1], evaluator(node[2], filters)

        def assign(scope, out):
            scope[name] = value(scope)
        return assign
    if kind == "if":
        arms = [(evaluator(t, filters), emitter(b, filters, learned)) for t, b in node[1]]
        otherwise = emitter(node[2], filters, learned)

        def branch(scope, out):
            for test, body in arms:
                if test(scope):
                    return body(scope, out)
            return otherwise(scope, out)
        return branch
    values, body = evaluator(node[2], filters), emitter(node[3], filters, learned)

    def loop(scope, out):
        for inner in turns(node[1], values(scope) or [], scope):
            body(inner, out)
    return loop


def turns(name: str, values, scope: dict):
    """The scope of each turn of a loop: the value and ``loop`` with index, index0,
    first, last, previtem and nextitem. Takes any iterable and looks one item ahead;
    what a turn sets is gone with it."""
    values = iter(values)
    before, at = None, 0
    here = next(values, _END)
    while here is not _END:
        after = next(values, _END)
        yield {**scope, name: here, "loop": {"index": at + 1, "index0": at, "first": at == 0, "last": after is _END,
                                             "previtem": before, "nextitem": None if after is _END else after}}
        before, here, at = here, after, at + 1


_END = object()


class Template:
    """A compiled template. ``constants`` are known when it is compiled."""

    def __init__(self, source: str, constants: dict | None = None, filters: dict | None = None):
        self.filters = {"trim": lambda x: text_of(x).strip(), "upper": lambda x: text_of(x).upper(),
                        "lower": lambda x: text_of(x).lower(), "length": lambda x: len(x or ()), **(filters or {})}
        tree = parse(source)
        own = names_set(tree)
        self.nodes = fold_nodes(tree, {k: v for k, v in (constants or {}).items() if k not in own}, self.filters)
        self.constants = dict(constants or {})
        self._parts = [(n, emitter(n[3] if self._over_messages(n) else [n], self.filters)) for n in self.nodes]

    @staticmethod
    def _over_messages(node) -> bool:
        return node[0] == "for" and node[2] == ("name", "messages")

    def stream(self, messages, **values):
        """Lists of (text, learned) pairs, one after each message and outer part, so a
        conversation of any length is rendered while it is read. ``messages`` is any
        iterable; the first outer loop over it uses it up."""
        scope = {**self.constants, **values}
        for node, emit in self._parts:
            if self._over_messages(node):
                for inner in turns(node[1], messages, scope):
                    out = []
                    emit(inner, out)
                    yield out
            else:
                out = []
                emit(scope, out)
                yield out

    def render(self, messages, **values) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its learned spans as (start, length)."""
        pairs = [p for out in self.stream(messages, **values) for p in out]
        spans, at = [], 0
        for text, learned in pairs:
            if learned and text:
                if spans and sum(spans[-1]) == at:
                    spans[-1] = (spans[-1][0], spans[-1][1] + len(text))
                else:
                    spans.append((at, len(text)))
            at += len(text)
        return "".join(t for t, _ in pairs), spans

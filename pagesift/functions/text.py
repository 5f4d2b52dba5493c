"""Column functions for text, entities, paths and tokens.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen. The one exception is the generic HTML
entity decoder, an Arrow-batched pandas UDF (Spark SQL has no HTML unescape).
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: ordered literal entity replacements (F1) -------------
ENTITY_REPLACEMENTS = [
    ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"),
    ("&apos;", "'"), ("&#150;", "–"), ("&nbsp;", " "), ("&#160;", " "), ("&#039;", "'"),
    ("&#34;", '"'), ("&reg;", "®"), ("&rsquo;", "’"), ("&#8226;", "•"), ("&ndash;", "–"),
    ("&#x27;", "'"), ("&#40;", "("), ("&#41;", ")"), ("&#47;", "/"), ("&#43;", "+"),
    ("&#035;", "#"), ("&#38;", "&"), ("&eacute;", "é"), ("&frac12;", "½"),
]
# visual priority of tags for fragment ranking
TEXT_VISUAL_PRIORITY = ["h1", "h2", "h3", "h4", "h5", "h6", "strong", "em", "b", "a", "p",
                        "span", "div"]
# --------------------------------------------------------------------------

# Python's str.strip() whitespace, as a Java regex class (Unicode mode).
_WS = r"[\s\x1c-\x1f]"
STRIP_PATTERN = rf"(?U)^{_WS}+|{_WS}+$"
# words and single marks; the whitespace class is spelled out so engines agree
TOKEN_PATTERN = "[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"
# what counting leaves out: all of a word but its first character, and white space
_TOKEN_REST = "([A-Za-z0-9_])[A-Za-z0-9_]*+[ \t\n\x0B\f\r]*+|[ \t\n\x0B\f\r]++"


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Generic HTML5 entity decoding (named, decimal, hex), Arrow-batched."""
    return s.map(lambda x: _html.unescape(x) if isinstance(x, str) and "&" in x else x)


@F.pandas_udf(T.StringType())
def unescape_replace_unescape(s: pd.Series) -> pd.Series:
    """``html_unescape(replace_entities(html_unescape(s)))`` in one Python step."""
    def one(x):
        x = _html.unescape(x)
        for a, b in ENTITY_REPLACEMENTS:
            x = x.replace(a, b)
        return _html.unescape(x)
    return s.map(lambda x: one(x) if isinstance(x, str) and "&" in x else x)


def py_strip(c: Column) -> Column:
    """``str.strip()`` semantics (all Unicode whitespace), JVM-side."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def replace_entities(c: Column) -> Column:
    for a, b in ENTITY_REPLACEMENTS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_text(c: Column | str, unescape: bool = False) -> Column:
    """literal entity replaces, generic unescape, NBSP, collapse 2+ spaces, strip.
    ``unescape`` first decodes entities once, as an HTML parser would."""
    c = F.col(c) if isinstance(c, str) else c
    c = unescape_replace_unescape(c) if unescape else html_unescape(replace_entities(c))
    c = F.replace(c, F.lit("\xa0"), F.lit(" "))
    c = F.regexp_replace(c, "  +", " ")
    return py_strip(c)


def non_empty(df: DataFrame, cols: list[str], value: Column, name: str) -> DataFrame:
    """``cols`` and ``value`` as ``name`` of the rows where it is not null or empty. Spark
    would push a filter on it below the projection and run the Python step in ``value``
    twice, in two workers of every task; it does not push one below an explode."""
    return df.select(*cols, F.explode(F.filter(F.array(value), lambda x: x != "")).alias(name))


def unescape_and_strip(c: Column | str) -> Column:
    """unescape then strip."""
    c = F.col(c) if isinstance(c, str) else c
    return py_strip(html_unescape(c))


def unescape_collapse(c: Column | str) -> Column:
    """unescape twice and collapse any whitespace run to one space."""
    c = F.col(c) if isinstance(c, str) else c
    return py_strip(F.regexp_replace(html_unescape(html_unescape(c)), r"(?U)\s+", " "))


def token_count(c: Column | str) -> Column:
    """F9 default tokenizer: words and single punctuation marks; 0 on null/empty. This is
    the number of matches of ``TOKEN_PATTERN``, without a string made of each: one
    character is left of every token."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.length(F.regexp_replace(c, _TOKEN_REST, "$1")), F.lit(0))


def parent_xpath(c: Column | str) -> Column:
    """F10."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "/[^/]*$", "")


def ordered_list(arr: Column) -> Column:
    """``1. a\\n2. b``."""
    return F.array_join(
        F.transform(arr, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def minify_html(c: Column | str) -> Column:
    """F21 approximation: drop whitespace between tags, collapse runs."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r">\s+<", "><"), r"\s{2,}", " ")


def url_decode_keep_plus(c: Column) -> Column:
    """F8: percent-decode like ``urllib.parse.unquote`` (``+`` stays ``+``)."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def site_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(url, "://([^/]+)", 1)


def category_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(url, "/(en|fr|de|es)/", 1)


def strip_answer(c: Column | str) -> Column:
    """keep text after the last 'Conclusion:' and inside a code fence."""
    c = F.col(c) if isinstance(c, str) else c
    tail = F.element_at(F.split(c, "Conclusion:"), -1)
    fenced = F.regexp_extract(tail, r"(?s)```(?:json)?(.*?)```", 1)
    return py_strip(F.when(fenced != "", fenced).otherwise(tail))


def parse_program_answer(c: Column | str) -> Column:
    """bare path, JSON string, JSON object with ``xpath``, or list."""
    c = py_strip(F.col(c) if isinstance(c, str) else c)
    return (F.when(c.startswith("/") | c.startswith("("), c)
            .when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x"))
            .when(c.startswith("["), F.get_json_object(c, "$[0]"))
            .otherwise(F.get_json_object(c, "$.xpath")))


def normalize_unescape_first(c: Column | str) -> Column:
    """generic unescape first, then the literal replacements; NBSP to
    space and strip, without collapsing space runs."""
    c = F.col(c) if isinstance(c, str) else c
    return py_strip(F.replace(replace_entities(html_unescape(c)), F.lit("\xa0"), F.lit(" ")))

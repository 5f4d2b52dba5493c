"""Table functions for SQL (D6): tree walk, text chunks and fragments of pages.

    register(spark)
    SELECT * FROM traverse(TABLE(pages) PARTITION BY page_id)
    SELECT * FROM itertext(TABLE(pages) PARTITION BY page_id)
    SELECT * FROM fragments(TABLE(tokens) PARTITION BY (page_id), 1024, 256)

``pages`` has page_id and html; ``tokens`` are the rows of
``fragments.token_rows``. A partition is one page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _keyed(table: AnalyzeArgument, fields: list) -> AnalyzeResult:
    """The table's page_id and the function's own columns."""
    out = StructType().add("page_id", table.dataType["page_id"].dataType)
    for name, kind in fields:
        out = out.add(name, kind)
    return AnalyzeResult(schema=out)


@udtf
class Traverse:
    """One row per element or comment, with its positional path."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return _keyed(pages, [("node_id", IntegerType()), ("parent_id", IntegerType()), ("depth", IntegerType()),
                              ("tag", StringType()), ("xpath", StringType())])

    def eval(self, page):
        from pagesift.functions.htmltree import build_rows
        for r in build_rows(page["html"]):
            yield page["page_id"], r[0], r[2], r[3], r[5], r[8]


@udtf
class IterText:
    """X4's input: text chunks with their owner and text() index."""

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        return _keyed(pages, [("node_id", IntegerType()), ("idx", IntegerType()), ("text", StringType())])

    def eval(self, page):
        from pagesift.functions.htmltree import build_rows
        for r in build_rows(page["html"]):
            for idx, text, *_ in r[15]:
                yield page["page_id"], r[0], idx, text


@udtf
class Fragments:
    """Greedy fragments of each page, from its token rows."""

    @staticmethod
    def analyze(tokens: AnalyzeArgument, until_html_tokens: AnalyzeArgument, max_text_tokens: AnalyzeArgument) -> AnalyzeResult:
        return _keyed(tokens, [("seq", IntegerType()), ("xpath", StringType()), ("text_tokens", LongType()),
                               ("html_tokens", LongType()), ("weight", DoubleType()), ("is_rest", BooleanType())])

    def __init__(self):
        self.rows, self.bounds = [], None

    def eval(self, row, until_html_tokens, max_text_tokens):
        self.rows.append(row.asDict())
        self.bounds = (until_html_tokens, max_text_tokens)

    def terminate(self):
        from pagesift.operators.fragments import _fragments, _Tree
        if self.rows:
            found = _fragments(_Tree(pd.DataFrame(self.rows)), *self.bounds)
            for seq, (xpath, text, html, weight, _) in enumerate(found, 1):
                yield self.rows[0]["page_id"], seq, xpath, int(text), int(html), weight, weight is None


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as traverse, itertext and fragments."""
    for name, f in (("traverse", Traverse), ("itertext", IterText), ("fragments", Fragments)):
        spark.udtf.register(name, f)

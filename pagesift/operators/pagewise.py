"""Python steps over whole groups of rows (a page, a page's field), read as a stream.

The rows are dealt out by key, sorted in their partition and passed through
``mapInArrow``: Spark makes no data frame for each group, a Python worker holds
one group and one batch at a time, and the number of tasks does not shrink with
the bytes of the rows (these steps take their time in Python).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# result rows sent back at once
OUT_ROWS = 2048


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns as lists) of each run of rows with equal first ``keys`` columns;
    a group may go on in the next batch."""
    at, held = None, None
    for rb in batches:
        cols = [c.to_pylist() for c in rb.columns]
        ks, n, start = list(zip(*cols[:keys])), rb.num_rows, 0
        while start < n:
            end = start + 1
            while end < n and ks[end] == ks[start]:
                end += 1
            part = [c[start:end] for c in cols]
            if held is not None and at == ks[start]:
                for c, more in zip(held, part):
                    c.extend(more)
            else:
                if held is not None:
                    yield at, held
                at, held = ks[start], part
            start = end
    if held is not None:
        yield at, held


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, dict], list[tuple]], schema,
               types: list[pa.DataType | str]) -> DataFrame:
    """``fn(key, {column: values})`` for every group; its rows, as tuples, in ``schema``.
    ``types`` are their Arrow types, a column's name standing for that column's type."""
    src = df.select(*keys, *[c for c in df.columns if c not in keys])
    names, spark = src.columns, df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        known = None

        def typed(stream):
            nonlocal known
            for rb in stream:
                if known is None:
                    known = [rb.schema.field(t).type if isinstance(t, str) else t for t in types]
                yield rb

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), known)], names=fields)

        rows = []
        for key, cols in groups(typed(batches), len(keys)):
            for row in fn(key, dict(zip(names, cols))):
                rows.append(row)
                if len(rows) == OUT_ROWS:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    fields = [f.split()[0] for f in schema.split(", ")] if isinstance(schema, str) else schema.names
    return src.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

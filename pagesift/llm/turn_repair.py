"""Conversation structure repair by weighted interval parsing.

The rows of a conversation are to be edited at the least cost until their role
initials read ``(s?(ua)+)?``. The grammar is in Chomsky normal form: a nonterminal
``X[p,q]`` stands for all initials that lead from state ``p`` of the small automaton of
that language to state ``q``, with ``X[p,q] -> X[p,r] X[r,q]`` for every ``r``, the start
symbols ``X[0,0]`` and ``X[0,3]``, and one rule per edit of a row. A cell of a span holds
the minimum (cost, audit) of each nonterminal, closed under insertions. Spans are
combined bottom-up by length: 1, 2, 4, ... rows and what is left over. As every split
of a span derives the same strings in this grammar, one split per span is enough, and
a conversation of n rows takes n - 1 combinations.

Minima may be combined: the edits of a span fix the cost of its audit, so of two audits
of equal cost none is a proper prefix of the other, and the least concatenation is the
concatenation of the least.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.chat_format import _batches, _rows
from pagesift.llm.common import SPACE, prepare, release_worker_object, table, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# automaton of (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
FAULTS = ("blank", "duplicate", "truncated")


def combine(a: dict, b: dict) -> dict:
    """The cell of two neighbouring spans: each cell maps (p, q) to (cost, audit)."""
    out = {}
    for (p, r), (cost, audit) in a.items():
        for (r2, q), (more, rest) in b.items():
            if r2 == r:
                found = (cost + more, audit + rest)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _inserted() -> dict:
    """Cell of the empty span: the cheapest insertions between any two states."""
    cell = {(p, p): (0, "") for p in STATES}
    step = {(p, q): (INSERT, "I") for (p, c), q in MOVES.items() if c in ROLES} | cell
    for _ in STATES:
        cell = combine(cell, step)
    return cell


_EMPTY = _inserted()


def row_cell(initial: str, fault: str) -> dict:
    """Cell of one row: its edits with any insertions before and after."""
    extra = TRUNCATED if fault == "truncated" else 0
    cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault not in ("blank", "duplicate"):
        for (p, c), q in MOVES.items():
            if c in ROLES:
                cell[p, q] = (REROLE + extra, "R")
        for (p, c), q in MOVES.items():
            if c == initial:
                cell[p, q] = min(cell.get((p, q), (99, "")), (KEEP + extra, "K"))
    return combine(combine(_EMPTY, cell), _EMPTY)


class Parser:
    """Rows come in one by one; equal neighbouring spans are combined at once, so only
    the cells of about log2(n) spans are held."""

    def __init__(self):
        self.rows, self.spans, self._cells = 0, [], {}

    def add(self, initial: str, fault: str) -> None:
        key = (initial if initial in ("s", "u", "a") else "", fault)
        if key not in self._cells:
            self._cells[key] = row_cell(*key)
        self.spans.append((1, self._cells[key]))
        while len(self.spans) > 1 and self.spans[-1][0] == self.spans[-2][0]:
            (n, a), (_, b) = self.spans[-2:]
            self.spans[-2:] = [(2 * n, combine(a, b))]
        self.rows += 1

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair; no rows need none."""
        cell = None
        for _, right in reversed(self.spans):
            cell = right if cell is None else combine(right, cell)
        self.rows, self.spans = 0, []
        return min(cell[0, q] for q in ACCEPTING) if cell else (0, "")


def repaired(audit: str, rows):
    """(role, text) of the repaired conversation; ``rows`` gives (role, text) per row.
    The language leaves one role for each edit once the edits are known."""
    rows, state = iter(rows), 0
    for edit in audit:
        if edit == "I":
            role, text = None, ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
        if edit == "K":
            initial = role[:1]
        else:
            initial = "a" if state == 2 else "u"
            role = ROLES[initial]
        state = MOVES[state, initial]
        yield role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of the table after damage, with ``dropped`` ones still there.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user. Nulls are one space in role,
    text and the hashed key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def _fault(duplicate: Column) -> Column:
    """A row's first fault, empty if it has none."""
    full = F.regexp_replace("text", f"{SPACE}$", "")
    return (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(duplicate, "duplicate")
            .when(~full.rlike(r"[.!?]$"), "truncated").otherwise(""))


_AUDITS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _in_order(rows: DataFrame, *cols: str) -> DataFrame:
    """Each conversation's rows side by side: by turn (nulls first), equal turns by role
    and the text's digest."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), *cols, F.asc_nulls_first("turn"), "role", "digest")


def audits(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation, from narrow rows (no texts)."""
    from pyspark.sql import Window
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", _fault(F.lit(False)).alias("fault"), "dropped")
    again = F.when(F.col("dropped") | (F.col("fault") == "blank"), F.col("fault")).when(
        F.row_number().over(seen) > 1, "duplicate").otherwise(F.col("fault"))
    # dropped rows must not count as earlier ones: they are kept apart by their own role
    narrow = narrow.withColumn("role", F.when(F.col("dropped"), None).otherwise(F.col("role")))
    narrow = narrow.withColumn("fault", again)
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *FAULTS, "illegal", "cost")],
                        ("audit", pa.string())])

    def run(batches):
        release_worker_object()
        parser = Parser()

        def rows():
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                first = last = None
                distinct = illegal = 0
                before, count = None, dict.fromkeys(FAULTS, 0)
                for _, turn, role, fault in group:
                    if role is None:  # dropped
                        continue
                    if turn is not None and turn != last:
                        first, last, distinct = (turn if first is None else first), turn, distinct + 1
                    if fault:
                        count[fault] += 1
                    initial = role[:1]
                    if before is not None and before + initial not in LEGAL:
                        illegal += 1
                    before = initial
                    parser.add(initial, fault)
                cost, audit = parser.result()
                gaps = 0 if first is None else last - first + 1 - distinct
                yield (conv_id, gaps, *count.values(), illegal, cost, audit)

        yield from _batches(rows(), schema)

    return _in_order(narrow).select("conv_id", "turn", "role", "fault").mapInArrow(run, _AUDITS)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Damage, audit and repair ``conversations`` (conv_id, turn, role, text).

    Returns the audits, one row per original conversation, and the repaired rows:
    conv_id, seq (from 0), role, text, in order within their partitions. Null conv_ids
    are one conversation; a conversation that loses all its rows has an empty audit and
    no repaired rows; equal turns are ordered by role and the text's digest; other
    columns are ignored. A conversation's rows pass through a task as a stream; of its
    length are only the audit's characters."""
    rows = damaged(conversations).withColumn("digest", F.md5("text"))
    found = written(audits(rows), "audits")

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def out():
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                _, audit, _, _ = next(group)  # the audit comes first
                for seq, (role, text) in enumerate(repaired(audit, ((r[2], r[3]) for r in group))):
                    yield conv_id, seq, role, text

        yield from _batches(out(), schema)

    texts = rows.filter(~F.col("dropped")).select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", F.lit(None).cast("string").alias("audit"), "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.lit("").alias("digest"), "audit", F.lit("").alias("text"))
    both = _in_order(heads.unionByName(texts), "kind").select("conv_id", "audit", "role", "text")
    return found, both.mapInArrow(run, "conv_id long, seq long, role string, text string")


def repaired_digests(repaired_rows: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches):
        def out():
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                h = hashlib.sha256()
                for _, seq, role, text in group:
                    h.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
                yield conv_id, h.hexdigest()

        yield from _batches(out(), schema)

    return repaired_rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def op13_turn_repair(spark, sf_dir):
    """Faults, cheapest repair and digest of the repaired rows of every conversation."""
    prepare(spark)
    found, rows = repair(table(spark, sf_dir, "conversations"))
    digest = repaired_digests(rows).withColumnRenamed("conv_id", "id")
    return found.join(digest, found["conv_id"].eqNullSafe(F.col("id")), "left").drop("id").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))

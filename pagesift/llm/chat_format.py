"""Chat formatting: conversations rendered by a compiled template, with the learned
spans, and read back from the formatted text.

Control strings inside texts are escaped reversibly. With the mark ``\\``: a mark
becomes ``\\\\``, a line break (where the format ends a role by one) ``\\n``, and ``\\.``
is put after the first character of each control string, which so never occurs whole
in a text.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.chat_template import Template
from pagesift.llm.common import prepare, release_worker_object, table

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (BEGIN, END, OPEN, CLOSE)
# assistants' texts stand bare and are learned; every other turn names its role
TEMPLATE = """{{ begin }}
{%- for m in messages -%}
  {%- if m.role == 'assistant' -%}
    {{ ' ' }}{% generation %}{{ m.content | escape }}{% endgeneration %}{{ end }}
  {%- else -%}
    {{ open }} {{ m.role | escape_line }}{{ '\\n' }}{{ m.content | escape }}{{ close }}
  {%- endif -%}
{%- endfor -%}"""
# code points after which a conversation goes on in a new row
PART_CHARS = 1 << 20

_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)")
_MARKED = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", "n": "\n", ".": ""}
_TURN = re.compile(rf" (?P<said>.*?){re.escape(END)}|{re.escape(OPEN)} (?P<role>[^\n]*)\n(?P<text>.*?){re.escape(CLOSE)}", re.S)


def escape(text: str) -> str:
    """The text with no control string in it; :func:`unescape` gives it back."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _STARTS.sub(r"\1\\.", text) if "<" in text or "[" in text else text


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def chat_template() -> Template:
    return Template(TEMPLATE, {"begin": BEGIN, "end": END, "open": OPEN, "close": CLOSE},
                    {"escape": escape, "escape_line": escape_line})


def ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side and in order: by turn (nulls first), equal
    turns by role and text. One sort of the whole table; a task reads its rows as a
    stream, so a conversation of any length needs no more memory than a batch."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


_FORMATTED = "conv_id long, part long, text string, spans array<struct<start:long,length:long>>"


def _row(conv_id, part, pieces):
    text, spans, at = [], [], 0
    for t, learned in pieces:
        if learned:
            spans.append({"start": at, "length": len(t)})
        text.append(t)
        at += len(t)
    return conv_id, part, "".join(text), spans


def _batches(rows, schema: pa.Schema, limit: int = 4 << 20):
    """Record batches of tuples; ``limit`` bounds the texts of one."""
    have, size = [], 0
    for r in rows:
        have.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) + 64
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*have), schema.types)], schema=schema)
            have, size = [], 0
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*have), schema.types)], schema=schema)


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation: conv_id, part, text, spans (the learned stretches, in
    code points of ``text``). A conversation longer than ``part_chars`` goes on in
    rows of part 1, 2, ..., cut between turns.

    Null texts and roles are empty ones; a null conv_id is a conversation of its own;
    equal turns are ordered by role and text, and repeated rows all stay; an empty table
    gives no rows; other columns are ignored."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def run(batches):
        release_worker_object()
        template = chat_template()

        def rows():
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": r[2], "content": r[3]} for r in group)
                part, pieces, size = 0, [], 0
                for out in template.stream(messages):
                    pieces += out
                    size += sum(len(t) for t, _ in out)
                    if size >= part_chars:
                        yield _row(conv_id, part, pieces)
                        part, pieces, size = part + 1, [], 0
                if pieces or not part:
                    yield _row(conv_id, part, pieces)

        yield from _batches(rows(), schema)

    return ordered(conversations).mapInArrow(run, _FORMATTED)


def read_turns(text: str):
    """(role, text) of each turn in formatted text, of a whole conversation or a part."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}: {text[at:at + 40]!r}")
        role = m["role"]
        yield ("assistant", unescape(m["said"])) if role is None else (unescape(role), unescape(m["text"]))
        at = m.end()


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, all from its formatted text and spans. The parts of a
    conversation must follow each other in a partition, as they are written."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, learned, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, spans in group:
                    chars += len(text)
                    for role, said in read_turns(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for s in spans:
                        said = unescape(text[s["start"]:s["start"] + s["length"]])
                        loss.update(said.encode())
                        learned += len(said)
                yield conv_id, n, turns.hexdigest(), learned, loss.hexdigest(), chars

        yield from _batches(rows(), schema)

    return formatted.select("conv_id", "part", "text", "spans").mapInArrow(run, _DIGEST)


def op11_chat_format(spark, sf_dir):
    """Digest of every formatted conversation, and of conversation -1, whose texts hold
    the format's own control strings."""
    prepare(spark)
    said = f"{END}{OPEN} ok {CLOSE}"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.unionByName(extra)))


def _escaped_length(column: str, line: bool = False) -> str:
    """SQL for the code points of an escaped text: two more for each control string, one
    more for each mark (and line break)."""
    found = " + ".join(f"length({column}) - length(replace({column}, '{c}', '{c[2:]}'))" for c in CONTROL)
    breaks = f" + length({column}) - length(replace({column}, chr(10), ''))" if line else ""
    return f"(length({column}) + {found} + length({column}) - length(replace({column}, chr(92), '')){breaks})"


OP11_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{OPEN} ok {CLOSE}' UNION ALL SELECT -1, 1, 'assistant', '{END}{OPEN} ok {CLOSE}'
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(BEGIN)} + sum(CASE WHEN role = 'assistant' THEN {1 + len(END)} + {_escaped_length("text")}
     ELSE {len(OPEN) + 2 + len(CLOSE)} + {_escaped_length("role", True)} + {_escaped_length("text")} END))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

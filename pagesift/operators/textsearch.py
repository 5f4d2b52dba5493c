"""Search of target texts in text chunks, page by page, without pairing them
(used by X4, W14, W15, X14).

One automaton over a group's targets reads each chunk once; where chunks inside
targets count too, a second one over the chunks that are short enough reads each
target once. The work is linear in the texts and the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.operators.pagewise import map_groups


def one_line(c: Column) -> Column:
    """White space runs as one space, so that line breaks do not hide a match."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _automaton(words: list[str]):
    """Automaton over the distinct non-empty words, or None."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in words:
        if w:
            a.add_word(w, w)
    if not len(a):
        return None
    a.make_automaton()
    return a


def matches(chunks: list[str], targets: list[str], both_ways: bool) -> list[tuple[int, int]]:
    """(chunk, target) places where the chunk contains the target or, with
    ``both_ways``, lies in it. An empty target lies in every chunk; an empty chunk
    matches only that."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(targets):
        at.setdefault(t, []).append(i)
    out = set()
    auto = _automaton(list(at))
    for c, text in enumerate(chunks):
        found = {w for _, w in auto.iter(text)} if auto and text else set()
        for t in found | ({""} & at.keys()):
            out.update((c, i) for i in at[t])
    if both_ways:
        longest = max(map(len, at), default=0)
        places: dict[str, list[int]] = {}
        for c, text in enumerate(chunks):
            if text and len(text) <= longest:
                places.setdefault(text, []).append(c)
        auto = _automaton(list(places))
        for t, ids in at.items():
            if auto and t:
                for text in {w for _, w in auto.iter(t)}:
                    out.update((c, i) for c in places[text] for i in ids)
    return sorted(out)


def text_matches(chunks: DataFrame, targets: DataFrame, keys: list[str], both_ways: bool = False) -> DataFrame:
    """Join of ``chunks`` (keys, norm, ...) with ``targets`` (keys, t_norm, ...) where
    ``norm`` contains ``t_norm`` or, with ``both_ways``, lies in it. Returns both
    sides' columns without the two texts; they must have no other names in common."""
    left = chunks.select(*keys, "norm", *[c for c in chunks.columns if c not in (*keys, "norm")])
    right = targets.select(*keys, "t_norm", *[c for c in targets.columns if c not in (*keys, "t_norm")])
    lcols, rcols = left.columns[len(keys) + 1:], right.columns[len(keys) + 1:]
    schema = T.StructType([left.schema[c] for c in [*keys, *lcols]] + [right.schema[c] for c in rcols])
    both = left.withColumnRenamed("norm", "_text").withColumn("_target", F.lit(False)).unionByName(
        right.withColumnRenamed("t_norm", "_text").withColumn("_target", F.lit(True)), allowMissingColumns=True)

    def run(key: tuple, rows: dict) -> list[tuple]:
        if None in key:  # a null key joins with nothing
            return []
        texts, side = [x or "" for x in rows["_text"]], rows["_target"]
        cs, ts = ([i for i, target in enumerate(side) if target == want] for want in (False, True))
        hits = matches([texts[i] for i in cs], [texts[i] for i in ts], both_ways) if cs and ts else []
        a, b = [rows[c] for c in lcols], [rows[c] for c in rcols]
        return [(*key, *[x[cs[c]] for x in a], *[x[ts[t]] for x in b]) for c, t in hits]

    return map_groups(both, keys, run, schema, [*keys, *lcols, *rcols])

"""Programs as step sequences: parsing, generalizing and aligning them.

A step is ``(axis, test, predicates)`` with axis ``/`` or ``//``. Quotes and nested
brackets are respected, so a digit or slash inside a value is never taken for a
position or a step.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INDEX = re.compile(r"\d+|last\(\)")


def parse_steps(program: str) -> list[tuple[str, str, tuple]] | None:
    """Steps of a plain path; None for unions and anything else."""
    steps, i, n = [], 0, len(program)
    while i < n:
        if program[i] != "/":
            return None
        axis = "//" if program.startswith("//", i) else "/"
        i += len(axis)
        start = i
        while i < n and program[i] not in "/[":
            if program[i] in "|'\" ":
                return None
            i += 1
        test, preds = program[start:i], []
        while i < n and program[i] == "[":
            start, depth, quote = i + 1, 0, None
            while i < n:
                c = program[i]
                if quote:
                    quote = None if c == quote else quote
                elif c in "'\"":
                    quote = c
                elif c == "[":
                    depth += 1
                elif c == "]":
                    depth -= 1
                    if not depth:
                        break
                i += 1
            if i == n:
                return None
            preds.append(program[start:i].strip())
            i += 1
        if not test:
            return None
        steps.append((axis, test, tuple(preds)))
    return steps or None


def format_steps(steps: list) -> str:
    return "".join(f"{a}{t}{''.join(f'[{p}]' for p in ps)}" for a, t, ps in steps)


def is_position(predicate: str) -> bool:
    return bool(_INDEX.fullmatch(predicate))


def without_positions(program: str) -> str:
    """The program with the positions of its element steps taken off; ``text()[2]``,
    attributes and quoted values stay."""
    steps = parse_steps(program)
    if steps is None:
        return program
    return format_steps([(a, t, ps if t.endswith("()") else tuple(p for p in ps if not is_position(p)))
                         for a, t, ps in steps])


def align(a: str, b: str) -> str | None:
    """Anti-unification: the closest program that covers both.

    The steps are aligned by a longest common subsequence of their tests, steps with
    equal predicates counting double. A step keeps the predicates that both have;
    where one side has steps that the other has not, the next common step is reached
    by ``//``. The last steps must be of one test; None if they are not."""
    if a == b:
        return a
    x, y = parse_steps(a), parse_steps(b)
    if x is None or y is None or x[-1][1] != y[-1][1]:
        return None
    n, m = len(x) - 1, len(y) - 1   # the last steps are aligned with each other
    best = [[0] * (m + 1) for _ in range(n + 1)]
    gain = lambda i, j: 0 if x[i][1] != y[j][1] else 2 + (x[i][2] == y[j][2])
    for i in range(n):
        for j in range(m):
            g = gain(i, j)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + g if g else 0)
    pairs, i, j = [(n, m)], n, m
    while i and j:
        g = gain(i - 1, j - 1)
        if g and best[i][j] == best[i - 1][j - 1] + g:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    out, pi, pj = [], -1, -1
    for i, j in reversed(pairs):
        direct = i == pi + 1 and j == pj + 1 and x[i][0] == y[j][0] == "/"
        out.append(("/" if direct else "//", x[i][1], tuple(p for p in x[i][2] if p in y[j][2])))
        pi, pj = i, j
    return format_steps(out)


def align_all(programs: list[str]) -> str | None:
    """One program that covers all, folded in the given order."""
    out = None
    for k, p in enumerate(programs):
        out = p if k == 0 else align(out, p)
        if out is None:
            return None
    return out


@F.pandas_udf(T.StringType())
def strip_positions(programs: pd.Series) -> pd.Series:
    return programs.map(lambda p: p if p is None else without_positions(p))


@F.pandas_udf(T.StringType())
def aligned(programs: pd.Series) -> pd.Series:
    """Arrays of programs to the program that covers them, null if there is none."""
    return programs.map(lambda ps: None if ps is None else align_all(list(ps)))


@F.pandas_udf(T.StringType())
def last_test(programs: pd.Series) -> pd.Series:
    """Test of the last element step, '' for programs that are no plain path."""
    def one(p):
        tests = [t for _, t, _ in parse_steps(p) or () if not t.endswith("()") and not t.startswith("@")]
        return tests[-1] if tests else ""
    return programs.map(lambda p: None if p is None else one(p))

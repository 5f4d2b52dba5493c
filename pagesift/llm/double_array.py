"""Double-array tries over word ids, walked for many positions at once.

A word is two symbols, the digits of its id to a base near the square root of the
vocabulary, so a node's children span a short range. State ``s`` goes on to
``t = base[s] + symbol`` if ``check[t] == s``; ``check`` leads back to the parent,
which is how :func:`spell` reads a phrase out of its last state. State 0 is the root.
"""

from __future__ import annotations

import math

import numpy as np

# share of tries that must succeed before the array is made longer
_LEAST_SUCCESS = 0.02


def radix(words: int) -> int:
    """Base of the two symbols of an id below ``words``."""
    return max(2, math.isqrt(max(0, words - 1)) + 1)


def symbols(phrases: np.ndarray, base: int) -> np.ndarray:
    """(n, 2m) symbols of (n, m) word ids."""
    out = np.empty((len(phrases), 2 * phrases.shape[1]), dtype=np.int64)
    out[:, 0::2], out[:, 1::2] = phrases // base, phrases % base
    return out


def _place(start: np.ndarray, sym: np.ndarray, span: int):
    """A base for each group of symbols, so that no two groups share a slot.

    ``start`` has the first edge of each group and the number of all edges. Wide
    groups get a stretch of their own, small ones are tried at random places, all
    at once and the larger first; single edges fill what is left."""
    k = np.diff(start)
    base = np.zeros(len(k), dtype=np.int64)
    rng = np.random.default_rng(7)
    wide = np.flatnonzero(k > max(2, span // 16))
    base[wide] = 1 + span * np.arange(len(wide))
    size = 1 + span * len(wide) + 2 * len(sym) + 2 * span
    used = np.zeros(size + span, dtype=bool)
    used[0] = True
    group = np.repeat(np.arange(len(k)), k)
    in_wide = np.isin(group, wide)
    used[base[group[in_wide]] + sym[in_wide]] = True
    owner = np.full(len(used), -1, dtype=np.int64)
    low = 1
    rest = np.flatnonzero((k > 1) & (k <= max(2, span // 16)))
    rest = rest[np.argsort(-k[rest], kind="stable")]
    for lot in np.split(rest, np.flatnonzero(np.diff(np.log2(k[rest]).astype(int))) + 1) if len(rest) else []:
        while len(lot):
            at = rng.integers(low, size, len(lot))
            edge = np.repeat(start[lot] - np.cumsum(np.concatenate([[0], k[lot][:-1]])), k[lot]) + np.arange(k[lot].sum())
            of = np.repeat(np.arange(len(lot)), k[lot])
            slot = at[of] + sym[edge]
            owner[slot] = of
            lost = used[slot] | (owner[slot] != of)
            good = np.bincount(of[lost], minlength=len(lot)) == 0
            base[lot[good]] = at[good]
            used[slot[good[of]]] = True
            lot = lot[~good]
            if good.mean() < _LEAST_SUCCESS:
                low, more = size, 2 * int(k[lot].sum()) + 4 * span
                size += more
                used = np.concatenate([used, np.zeros(more, dtype=bool)])
                owner = np.concatenate([owner, np.full(more, -1, dtype=np.int64)])
    one = np.flatnonzero(k == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(one):
        free = np.concatenate([free, len(used) + np.arange(len(one))])
    base[one] = free[:len(one)] - sym[start[one]]
    return base


def build(phrases: np.ndarray, words: int):
    """(base, check, last state of each phrase) for distinct phrases of one length."""
    span = radix(words)
    s = symbols(phrases, span)
    order = np.lexsort(s.T[::-1])
    s = s[order]
    n, depth = s.shape
    # edges of each level: the rows of s where a prefix appears first
    parent, sym, node_of = [], [], [np.zeros(n, dtype=np.int64)]
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    nodes = 1
    for d in range(depth):
        new[1:] |= s[1:, d] != s[:-1, d]
        at = np.flatnonzero(new)
        parent.append(node_of[-1][at])
        sym.append(s[at, d])
        node_of.append(nodes + np.cumsum(new) - 1)
        nodes += len(at)
    parent, sym = np.concatenate(parent), np.concatenate(sym)  # edge i leads to node i + 1
    by_parent = np.argsort(parent, kind="stable")
    heads, start = np.unique(parent[by_parent], return_index=True)
    found = _place(np.append(start, len(parent)), sym[by_parent], span)
    node_base = np.zeros(nodes, dtype=np.int64)
    node_base[heads] = found
    state = np.zeros(nodes, dtype=np.int64)
    state[1:] = node_base[parent] + sym
    size = int(max(state.max(initial=0), node_base.max(initial=0))) + span + 1
    base, check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
    base[state] = node_base
    check[state[1:]] = state[parent]
    last = np.empty(n, dtype=np.int64)
    last[order] = state[node_of[-1]]
    return base, check, last


def walk(base: np.ndarray, check: np.ndarray, columns: list[np.ndarray], words: int) -> np.ndarray:
    """State after the phrase of each row (word ids given by column), -1 if it has none.
    All rows advance together, one symbol at a time; those that fall out stop."""
    span = radix(words)
    out = np.full(len(columns[0]), -1, dtype=np.int64)
    at, state = np.arange(len(out)), np.zeros(len(out), dtype=np.int64)
    for c in columns:
        for step in (lambda x: x // span, lambda x: x % span):
            to = base[state] + step(c[at])
            ok = check[to] == state
            at, state = at[ok], to[ok]
    out[at] = state
    return out


def spell(base: np.ndarray, check: np.ndarray, last: np.ndarray, m: int, words: int) -> np.ndarray:
    """(n, m) word ids of the phrases that end in the states ``last``."""
    span = radix(words)
    out = np.zeros((len(last), m), dtype=np.int64)
    t = last
    for d in range(2 * m - 1, -1, -1):
        parent = check[t].astype(np.int64)
        out[:, d // 2] += (t - base[parent]) * (span if d % 2 == 0 else 1)
        t = parent
    return out

"""Array helpers that run inside Arrow tasks: words, hashes, shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def raw_bytes(a: np.ndarray) -> memoryview:
    """The array's memory as bytes (a memoryview of an empty one can't be cast)."""
    return memoryview(np.ascontiguousarray(a).reshape(-1)).cast("B") if a.size else memoryview(b"")


def batch_words(texts: pa.Array, lower: bool):
    """Words of a batch of texts (null: no words).

    Returns (codes, row, distinct): the word codes in reading order, the row of
    each, and the distinct words as an Arrow array indexed by code."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    lengths = np.diff(parts.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    enc = parts.flatten().dictionary_encode()
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    blank = pc.index(enc.dictionary, "").as_py()
    if blank >= 0:
        full = codes != blank
        codes, row = codes[full], row[full]
    return codes, row, enc.dictionary


def dense_unique(x: np.ndarray, size: int):
    """Distinct values of ``x`` (whole numbers below ``size``), ascending, and the place
    of each item's value among them; no sort."""
    present = np.zeros(size, dtype=bool)
    present[x] = True
    place = np.cumsum(present) - 1
    return np.flatnonzero(present), place[x]


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word, the same in every task."""
    # slices of the array's own bytes: far cheaper than one Python object per word
    raw = distinct.cast(pa.large_binary())
    off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = raw.buffers()[2].to_pybytes() if len(raw) and raw.buffers()[2] is not None else b""
    ends = off.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint64, len(raw))


def shingles(codes: np.ndarray, row: np.ndarray, hashes: np.ndarray, n: int):
    """Hash of each run of ``n`` words that lies within one row, with its row.

    Rows of fewer words give one shingle of all their words."""
    h = hashes[codes]
    out = h.copy() if n == 1 else None
    if n > 1:
        m = max(0, len(h) - n + 1)
        out = np.full(m, np.uint64(n), dtype=np.uint64)
        for k in range(n):
            out = mix(out * _GOLD + h[k:k + m])
        inside = row[:m] == row[n - 1:n - 1 + m]
        out, at = out[inside], row[:m][inside]
    else:
        return out, row
    counts = np.bincount(row, minlength=int(row[-1]) + 1 if len(row) else 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = np.full(len(short), 0, dtype=np.uint64)
        for i, r in enumerate(short):
            v = np.uint64(counts[r])
            acc = np.array([v], dtype=np.uint64)
            for x in h[starts[r]:starts[r] + counts[r]]:
                acc = mix(acc * _GOLD + x)
            extra[i] = acc[0]
        out, at = np.concatenate([out, extra]), np.concatenate([at, short])
    return out, at


def distinct_per_row(values: np.ndarray, at: np.ndarray, rows: int):
    """Distinct values of each row, sorted within it, and the row offsets."""
    order = np.lexsort((values, at))
    v, r = values[order], at[order]
    if len(v):
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        v, r = v[new], r[new]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]).astype(np.int64)
    return v, offsets


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs: start, start + 1, ... of each run in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)

"""Sorted hash arrays in the shared folder, memory-mapped by tasks.

A table with a 64-bit key is range-partitioned and sorted by Spark; each task
writes its part as one raw file per column. A reader maps the files and finds
keys by binary search, so a task holds only the pages it touches, and all tasks
of a machine share them.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.arrays import raw_bytes
from pagesift.llm.common import fresh_path

MANIFEST = "part int, first long, n long, file string"
# rows that one file holds, and a task that writes one
PART_ROWS = 1 << 20


def _filesystem(path: str):
    """(filesystem, path in it); local for plain and ``file:`` paths."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def save_array(path: str, a: np.ndarray) -> None:
    fs, p = _filesystem(path)
    fs.create_dir(os.path.dirname(p), recursive=True)
    with fs.open_output_stream(p) as out:
        out.write(raw_bytes(a))


def map_array(path: str, dtype) -> np.ndarray:
    """Memory-mapped array. A file in a remote store is copied to the worker's
    temporary folder and its name there removed as soon as it is mapped, so the space
    is free again when the array is, and any retry can make the copy again."""
    fs, p = _filesystem(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
        with fs.open_input_stream(p) as src, open(local, "wb") as dst:
            while block := src.read(1 << 22):
                dst.write(block)
        out = np.memmap(local, dtype=dtype, mode="r") if os.path.getsize(local) else np.empty(0, dtype)
        os.unlink(local)
        return out
    return np.memmap(p, dtype=dtype, mode="r") if os.path.getsize(p) else np.empty(0, dtype)


def parts_for(rows: int) -> int:
    """Range parts of a table of that many rows: their size does not grow with it."""
    return max(1, -(-rows // PART_ROWS))


def folder_of(manifest: list[tuple]) -> list[str]:
    """The folder of a manifest's files, if it has any."""
    return sorted({os.path.dirname(m[3]) for m in manifest})


def write_sorted(df: DataFrame, key: str, cols: dict[str, str], parts: int, name: str) -> list[tuple]:
    """Store ``df`` sorted by ``key``; returns the manifest, one row per file.

    ``cols`` gives the other columns' numpy types. A retried task writes files
    of a new name, and only the names of the attempt that ended well count."""
    folder = fresh_path(df.sparkSession, name)

    def run(batches):
        from pyspark import TaskContext
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        file = os.path.join(folder, uuid.uuid4().hex)
        keys = t.column(0).to_numpy()
        save_array(file + ".key", keys.astype("<i8"))
        for c, kind in cols.items():
            save_array(f"{file}.{c}", t.column(c).to_numpy().astype(kind))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "first": pa.array([int(keys[0])], pa.int64()),
            "n": pa.array([len(keys)], pa.int64()), "file": pa.array([file])})

    rows = (df.select(key, *cols).repartitionByRange(parts, key).sortWithinPartitions(key)
            .mapInArrow(run, MANIFEST).collect())  # one row per file
    return sorted((r.part, r.first, r.n, r.file) for r in rows)


class SortedArrays:
    """Lookups in stored arrays; the files are mapped when first used."""

    def __init__(self, manifest: list[tuple], cols: dict[str, str]):
        self.manifest, self.cols = manifest, cols
        self.first = np.array([m[1] for m in manifest], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum([m[2] for m in manifest])]).astype(np.int64)
        self._maps: dict = {}

    def __len__(self):
        return int(self.base[-1])

    def _map(self, i: int, c: str):
        if (i, c) not in self._maps:
            self._maps[i, c] = map_array(f"{self.manifest[i][3]}.{c}", "<i8" if c == "key" else self.cols[c])
        return self._maps[i, c]

    def find(self, keys: np.ndarray, sort: bool = True):
        """Rank of each key among all stored keys, -1 if absent."""
        out = np.full(len(keys), -1, dtype=np.int64)
        if not len(keys) or not len(self.first):
            return out
        order = np.argsort(keys, kind="stable") if sort else np.arange(len(keys))
        k = keys[order]
        cuts = np.concatenate([[0], np.searchsorted(k, self.first[1:], "left"), [len(k)]])
        found = np.full(len(k), -1, dtype=np.int64)
        for i in range(len(self.first)):
            lo, hi = cuts[i], cuts[i + 1]
            if lo < hi:
                a = self._map(i, "key")
                at = np.searchsorted(a, k[lo:hi])
                ok = at < len(a)
                ok[ok] = a[at[ok]] == k[lo:hi][ok]
                found[lo:hi] = np.where(ok, at + self.base[i], -1)
        out[order] = found
        return out

    def keys_at(self, ranks: np.ndarray) -> np.ndarray:
        """Keys at ranks (which must be present)."""
        return self._gather("key", "<i8", ranks)

    def take(self, c: str, ranks: np.ndarray) -> np.ndarray:
        """Column values at ranks (which must be present)."""
        return self._gather(c, self.cols[c], ranks)

    def _gather(self, c: str, kind: str, ranks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ranks), dtype=kind)
        part = np.searchsorted(self.base, ranks, "right") - 1
        for i in np.unique(part):
            here = part == i
            out[here] = self._map(int(i), c)[ranks[here] - self.base[i]]
        return out

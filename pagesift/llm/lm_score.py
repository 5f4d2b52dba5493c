"""Language-model scores: an interpolated modified Kneser-Ney bigram model of words.

Counting runs in Spark in three steps, each leaving files of sorted arrays in the
shared folder that tasks map into memory:

1. word hashes and their counts, sorted; a word's id is its rank there;
2. bigrams: tasks sum up what they meet and deal sorted blocks to shards; a shard
   holds a range of first words (as rows of a compressed matrix: offsets, second
   words, counts). A first word that alone holds more than a shard's share gets
   shards of its own, split by the second word, so no word makes a task large;
3. continuation counts: in how many distinct bigrams each word comes second.

Scoring maps all files and looks bigrams up by binary search within their row.

With ``Languages`` the model is one per language: a word's hash starts with its
language's number, so the ids of a language are one range, and discounts,
totals and opening contexts are the language's own.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.arrays import batch_words, dense_unique, word_hashes
from pagesift.llm.common import fresh_path, prepare, scratch, table, written
from pagesift.llm.hash_store import SortedArrays, folder_of, map_array, parts_for, save_array, write_sorted
from pagesift.llm.kneser_ney import discounts

# tokens per bigram shard: bounds the memory of the task that sorts one
SHARD_TOKENS = 3_000_000
FOLDS, HELD_OUT = 7, 2
END_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\x20end"))  # no word holds a space
WORD_COLS = {"n": "<i8"}


class Languages:
    """Numbers of languages; one more stands for all that are not named."""

    def __init__(self, names):
        self.number = {n: i for i, n in enumerate(sorted(names))}
        self.bits = (len(self.number)).bit_length() + 1  # the top bit stays 0: hashes sort as signed numbers

    def __len__(self):
        return len(self.number) + 1

    def of(self, langs: pa.Array) -> np.ndarray:
        enc = pc.fill_null(langs, "").dictionary_encode()
        known = np.array([self.number.get(x, len(self.number)) for x in enc.dictionary.to_pylist()] or [0], dtype=np.int64)
        return known[enc.indices.to_numpy(zero_copy_only=False)]

    def tagged(self, hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (number.astype(np.uint64) << np.uint64(64 - self.bits)) | (hashes >> np.uint64(self.bits))


def token_codes(texts: pa.Array, langs=None, languages=None, split=None):
    """(code, row, hashes) of a batch: numbers of its distinct tokens in order, each row
    closed by the end, and the hash of each number. ``split`` are the batch's words as
    they stand, where they are known already."""
    if split is None:
        codes, row, distinct = batch_words(texts, lower=True)
    else:
        codes, row, distinct = split
        lower = pc.ascii_lower(distinct).dictionary_encode()
        codes, distinct = lower.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], lower.dictionary
    h = np.append(word_hashes(distinct), END_HASH)
    rows = len(texts)
    n = np.bincount(row, minlength=rows)
    ends = np.cumsum(n + 1) - 1
    at = np.full(len(codes) + rows, len(h) - 1, dtype=np.int64)
    inner = np.ones(len(at), dtype=bool)
    inner[ends] = False
    at[inner] = codes
    row = np.repeat(np.arange(rows), n + 1)
    if languages is not None:
        used, at = dense_unique(languages.of(langs)[row] * len(h) + at, len(languages) * len(h))
        h = languages.tagged(h[used % len(h)], used // len(h))
    return at, row, h


def token_stream(texts: pa.Array, hashes_to=None, langs=None, languages=None):
    """(token, row) of a batch: word hashes in order, each row closed by the end.

    ``hashes_to`` maps the batch's distinct hashes to other numbers."""
    at, row, h = token_codes(texts, langs, languages)
    values = h if hashes_to is None else hashes_to(h)
    return values[at], row


def _summed(keys: list, counts: list):
    """Distinct sorted keys and their summed counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(n, starts)


def _columns(docs: DataFrame, languages) -> DataFrame:
    return docs.select("text", "lang") if languages is not None else docs.select("text")


def _tokens_of(b: pa.RecordBatch, languages, hashes_to=None):
    return token_stream(b.column(0), hashes_to, b.column(1) if languages is not None else None, languages)


def word_counts(docs: DataFrame, parts: int | None = None, languages=None, totals: DataFrame | None = None):
    """Manifest of (word hash, count), sorted; the end counts as a word. ``totals``
    (lang, word, n) stands for the texts' words, where they are counted already."""

    def run(batches):
        keys, counts, size = [], [], 0
        for b in batches:
            tokens, _ = _tokens_of(b, languages)
            k, n = np.unique(tokens.view(np.int64), return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > 3_000_000:
                k, n = _summed(keys, counts)
                keys, counts, size = [k], [n], len(k)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_pydict({"w": pa.array(k), "n": pa.array(n)})
                    keys, counts, size = [], [], 0
        k, n = _summed(keys, counts)
        yield pa.RecordBatch.from_pydict({"w": pa.array(k), "n": pa.array(n)})

    def hashed(batches):
        for b in batches:
            h = word_hashes(pc.ascii_lower(b.column(1))) if b.num_rows else np.empty(0, np.uint64)
            ends = pc.equal(b.column(1), "").to_numpy(zero_copy_only=False)  # no word is empty
            h[ends] = END_HASH
            yield pa.RecordBatch.from_pydict({"w": pa.array(languages.tagged(h, languages.of(b.column(0))).view(np.int64)),
                                              "n": b.column(2)})

    if totals is None:
        counts = _columns(docs, languages).mapInArrow(run, "w long, n long")
    else:
        ends = docs.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
        counts = totals.select("lang", "word", "n").unionByName(ends.select("lang", F.lit("").alias("word"), "n")).mapInArrow(
            hashed, "w long, n long")
    counts = written(counts.groupBy("w").agg(F.sum("n").alias("n")), "words")
    tokens, size = counts.agg(F.sum("n"), F.count("*")).first()
    return write_sorted(counts, "w", WORD_COLS, parts or parts_for(size), "word-array"), tokens or 0, counts


class Words:
    """Ids of words: their rank in the sorted array; one more id opens a text."""

    def __init__(self, manifest):
        self.store = SortedArrays(manifest, WORD_COLS)
        self.size = len(self.store)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return self.store.find(hashes.view(np.int64))


def bigram_stream(texts: pa.Array, words: Words, langs=None, languages=None):
    """(first, second, row): unknown words have id -1. The id after the last word's
    opens each text; with languages, the end of the text's language does."""
    tokens, row = token_stream(texts, words.ids, langs, languages)
    first = np.empty_like(tokens)
    first[1:] = tokens[:-1]
    opens = np.ones(len(tokens), dtype=bool)
    opens[1:] = row[1:] != row[:-1]
    first[opens] = words.size if languages is None else tokens[np.append(opens[1:], True)] if len(tokens) else 0
    return first, tokens, row


class Shards:
    """Where a bigram lives. Ranges of first-word ids, ``per`` each; the hot first
    words (``hot``: id -> number of own shards) come after them."""

    def __init__(self, size: int, n: int, hot: dict[int, int]):
        self.n = max(1, n)
        self.per = -(-(size + 1) // self.n)
        self.hot = dict(sorted(hot.items()))
        self.hot_ids = np.array(list(self.hot), dtype=np.int64)
        k = np.array(list(self.hot.values()), dtype=np.int64)
        self.hot_base = self.n + np.concatenate([[0], np.cumsum(k)[:-1]]).astype(np.int64) if len(k) else k
        self.hot_k = k
        self.total = self.n + int(k.sum())

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = first // self.per
        if len(self.hot_ids):
            at = np.minimum(np.searchsorted(self.hot_ids, first), len(self.hot_ids) - 1)
            is_hot = self.hot_ids[at] == first
            out[is_hot] = self.hot_base[at[is_hot]] + second[is_hot] % self.hot_k[at[is_hot]]
        return out

    def range(self, shard: int) -> tuple[int, int]:
        if shard < self.n:
            return shard * self.per, (shard + 1) * self.per
        h = int(np.searchsorted(self.hot_base, shard, "right") - 1)
        return int(self.hot_ids[h]), int(self.hot_ids[h]) + 1


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers, compressed by byte planes: the high ones are mostly zeros. The
    length comes first."""
    planes = np.ascontiguousarray(a).view("u1").reshape(-1, a.dtype.itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(blob[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(size, n).T).reshape(-1).view(dtype)


def bigram_blocks(docs: DataFrame, manifest, shards: Shards, languages=None) -> DataFrame:
    """(shard, first, second, n): sorted blocks of summed bigrams as binary arrays."""

    def flush(keys, counts):
        k, n = _summed(keys, counts)
        first, second = k >> 32, k & 0xFFFFFFFF
        shard = shards.of(first, second)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([int(shard[part[0]])], pa.int32()),
                    # differences of the sorted first words: mostly zeros, cheap to move
                    "first": pa.array([_packed(np.diff(first[part], prepend=0).astype("<u4"))], pa.binary()),
                    "second": pa.array([_packed(second[part].astype("<u4"))], pa.binary()),
                    # one byte each; larger counts beside them
                    "n": pa.array([_packed(np.minimum(n[part], 255).astype("u1"))], pa.binary()),
                    "big": pa.array([_blob(n[part][n[part] >= 255].astype("<i8"))], pa.binary())})

    def run(batches):
        words, keys, counts, size = Words(manifest), [], [], 0
        for b in batches:
            first, second, _ = bigram_stream(b.column(0), words, b.column(1) if languages is not None else None, languages)
            k, n = np.unique((first << 32) | second, return_counts=True)
            keys.append(k)
            counts.append(n)
            size += len(k)
            if size > 6_000_000:
                yield from flush(keys, counts)
                keys, counts, size = [], [], 0
        yield from flush(keys, counts)

    return _columns(docs, languages).mapInArrow(run, "shard int, first binary, second binary, n binary, big binary")


_SHARD_OUT = "kind int, shard int, file string, ids binary, counts binary, coc array<long>, stats array<long>"


def _row(kind, shard, file="", ids=b"", counts=b"", coc=(), stats=()):
    return {"kind": kind, "shard": shard, "file": file, "ids": ids, "counts": counts, "coc": list(coc), "stats": list(stats)}


_ROW_TYPE = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("ids", pa.binary()),
                       ("counts", pa.binary()), ("coc", pa.list_(pa.int64())), ("stats", pa.list_(pa.int64()))])


def _per_language(starts: np.ndarray, ids: np.ndarray, chosen) -> list[int]:
    """How many of ``ids`` are chosen by each mask, by the language of the id."""
    lang = np.searchsorted(starts, ids, "right") - 1
    return [int(x) for sel in chosen for x in np.bincount(lang[sel], minlength=len(starts))]


def _coc(starts: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[int]:
    return _per_language(starts, ids, [n == i for i in (1, 2, 3, 4)])


def bigram_shards(blocks: DataFrame, shards: Shards, starts: np.ndarray) -> DataFrame:
    """Sort and store each shard. Rows of kind 0 name a shard's files and carry its
    counts of counts per language, whose first ids are ``starts``; rows of kind 1
    are its share of the continuation counts."""
    folder = fresh_path(blocks.sparkSession, "bigrams")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = [], []
        for r in t.select(["first", "second", "n", "big"]).to_pylist():
            f = np.cumsum(_unpacked(r["first"], "<u4").astype(np.int64))
            keys.append((f << 32) | _unpacked(r["second"], "<u4"))
            n = _unpacked(r["n"], "u1").astype(np.int64)
            n[n == 255] = np.frombuffer(r["big"], "<i8")
            counts.append(n)
        k, n = _summed(keys, counts)
        del keys, counts
        lo, hi = shards.range(shard)
        first, second = (k >> 32) - lo, (k & 0xFFFFFFFF).astype("<u4")
        file = os.path.join(folder, uuid.uuid4().hex)
        at = np.searchsorted(first, np.arange(hi - lo + 1))
        big = np.flatnonzero(n >= 255)
        save_array(file + ".off", at.astype("<u4"))
        save_array(file + ".second", second)
        save_array(file + ".n", np.minimum(n, 255).astype("u1"))
        save_array(file + ".big", np.stack([big, n[big]]).astype("<i8"))  # counts past one byte
        per = [np.bincount(first[sel], minlength=hi - lo) for sel in (n == 1, n == 2, n > 2)]
        per.append(np.bincount(first, n, hi - lo).astype(np.int64))
        hot = shard >= shards.n
        if not hot:
            save_array(file + ".row", np.stack(per).astype("<i8"))
        out = [_row(0, shard, file, coc=_coc(starts, first + lo, n), stats=[lo, *[int(x[0]) for x in per]] if hot else [])]
        ids, c = np.unique(second, return_counts=True)
        span = ids // shards.per
        for s in np.unique(span):
            here = span == s
            out.append(_row(1, int(s), ids=_packed(np.diff(ids[here], prepend=0).astype("<u4")),
                            counts=_packed(c[here].astype("<u4"))))
        return pa.Table.from_pylist(out, _ROW_TYPE)

    return blocks.groupBy("shard").applyInArrow(run, _SHARD_OUT)


def continuation_shards(rows: DataFrame, shards: Shards, starts: np.ndarray) -> DataFrame:
    """Sum the continuation counts of each range of words and store them densely."""
    folder = fresh_path(rows.sparkSession, "continuations")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        lo = shard * shards.per
        total = np.zeros(shards.per, dtype="<u4")
        for r in t.select(["ids", "counts"]).to_pylist():
            ids = np.cumsum(_unpacked(r["ids"], "<u4").astype(np.int64)) - lo
            total[ids] += _unpacked(r["counts"], "<u4")
        file = os.path.join(folder, uuid.uuid4().hex)
        save_array(file, total)
        ids = lo + np.arange(len(total))
        stats = _per_language(starts, ids, [total == 1, total == 2, total > 2])
        lang = np.searchsorted(starts, ids, "right") - 1
        stats += [int(x) for x in np.bincount(lang, total, len(starts))]
        return pa.Table.from_pylist([_row(2, shard, file, coc=_coc(starts, ids, total), stats=stats)], _ROW_TYPE)

    return rows.filter("kind = 1").groupBy("shard").applyInArrow(run, _SHARD_OUT)


def train(docs: DataFrame, parts: int | None = None, languages: Languages | None = None,
          totals: DataFrame | None = None) -> dict:
    """Count the model over ``docs`` (text, and lang with ``languages``); returns what
    a scorer needs: file names and a few numbers, whose count grows only with the
    number of shards and languages. The words lie in ``parts`` range parts, by default
    as many as they ask for. Work tables are gone when it returns."""
    with scratch(docs.sparkSession) as keep:
        model = _train(docs, parts, languages, totals)
        files = [*model["files"].values(), *model["cont"].values()]
        keep(*folder_of(model["words"]), *{os.path.dirname(f) for f in files})
        return model


def _train(docs: DataFrame, parts, languages: Languages | None, totals: DataFrame | None) -> dict:
    manifest, tokens, counts = word_counts(docs, parts, languages, totals)
    size = sum(m[2] for m in manifest)
    if size + 2 >= 1 << 31:
        raise ValueError(f"{size} distinct words do not fit the 31 bits of a word id")
    n_shards = max(1, tokens // SHARD_TOKENS)
    share = max(1, tokens // n_shards)
    # at most n_shards words can hold more than a shard's share
    heavy = [(r.w, r.n) for r in counts.filter(F.col("n") > share).collect()]
    words = Words(manifest)
    ids = words.ids(np.array([w for w, _ in heavy], dtype=np.int64).view(np.uint64))
    hot = {int(i): -(-n // share) for i, (_, n) in zip(ids, heavy)}
    sizes, lang_tokens = np.array([size]), np.array([tokens])
    if languages is None:
        n_docs = (counts.filter(F.col("w") == int(END_HASH.view(np.int64))).agg(F.sum("n")).first()[0] or 0)
        if n_docs > share:
            hot[size] = -(-n_docs // share)
    else:
        sizes, lang_tokens = np.zeros((2, len(languages)), dtype=np.int64)
        number = F.shiftrightunsigned("w", 64 - languages.bits)
        for r in counts.groupBy(number.alias("l")).agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect():  # languages
            sizes[r.l], lang_tokens[r.l] = r.c, r.n
    starts = np.cumsum(sizes) - sizes
    shards = Shards(size, n_shards, hot)
    rows = written(bigram_shards(bigram_blocks(docs, manifest, shards, languages), shards, starts), "shards")
    files = rows.filter("kind = 0").select("shard", "file", "coc", "stats").collect()
    cont = written(continuation_shards(rows, shards, starts), "continuations").select("shard", "file", "coc", "stats").collect()
    hot_rows: dict[int, np.ndarray] = {}
    for r in files:
        if r.stats:
            hot_rows[r.stats[0]] = hot_rows.get(r.stats[0], 0) + np.array(r.stats[1:], dtype=np.int64)

    def total(rs, k):
        """Four sums for each language."""
        return sum((np.array(r[k], dtype=np.int64).reshape(4, -1) for r in rs), np.zeros((4, len(sizes)), np.int64)).T

    d2 = np.array([discounts(*x) for x in total(files, "coc").tolist()])
    d1 = np.array([discounts(*x) for x in total(cont, "coc").tolist()])
    c = total(cont, "stats")
    return {"words": manifest, "tokens": tokens, "size": size, "shards": shards, "files": {r.shard: r.file for r in files},
            "cont": {r.shard: r.file for r in cont}, "d2": d2, "d1": d1, "cont_counts": c,
            "sizes": sizes, "lang_tokens": lang_tokens, "hot_rows": hot_rows, "languages": languages}


class Scorer:
    """Scores batches with a trained model; one object per task."""

    def __init__(self, model: dict):
        self.m, self.words, self.maps = model, Words(model["words"]), {}

    def _map(self, file, dtype):
        if file not in self.maps:
            self.maps[file] = map_array(file, dtype)
        return self.maps[file]

    def _discounted(self, n, d):
        return np.maximum(0.0, n - np.where(n == 1, d[..., 0], np.where(n == 2, d[..., 1], d[..., 2])) * (n > 0))

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        """Continuation count of each word id; -1 is an unknown word."""
        m = self.m
        out = np.zeros(len(ids))
        known = np.flatnonzero(ids >= 0)
        span = ids[known] // m["shards"].per
        for s in np.unique(span):
            if int(s) in m["cont"]:
                at = known[span == s]
                out[at] = self._map(m["cont"][int(s)], "<u4")[ids[at] - int(s) * m["shards"].per]
        return out

    def counts(self, first: np.ndarray, second: np.ndarray):
        """Count of each bigram; of its first word: how many bigrams come once, twice
        and more often, and the sum of their counts."""
        m, shards = self.m, self.m["shards"]
        count, rows = np.zeros(len(first)), np.zeros((4, len(first)))
        known = np.flatnonzero(first >= 0)
        # unknown second words have no bigram, but their context's back-off weight counts
        shard = shards.of(first[known], np.maximum(second[known], 0))
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(part):
                continue
            s, at = int(shard[part[0]]), known[part]
            lo = shards.range(s)[0]
            f, g = first[at] - lo, second[at]
            hits = np.zeros(len(at))
            if s in m["files"]:
                file = m["files"][s]
                off, col = self._map(file + ".off", "<u4"), self._map(file + ".second", "<u4")
                a, end = off[f].astype(np.int64), off[f + 1].astype(np.int64)
                z = end.copy()
                for _ in range(int((z - a).max()).bit_length() if len(a) else 0):  # bisect all rows together
                    mid = (a + z) >> 1
                    open_ = a < z
                    less = open_ & (col[np.minimum(mid, len(col) - 1)] < g)
                    a, z = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, z)
                found = (a < end) & (g >= 0)
                found[found] = col[a[found]] == g[found]
                n = self._map(file + ".n", "u1")[a[found]].astype(np.float64)
                big = np.flatnonzero(n == 255)
                if len(big):
                    table_ = self._map(file + ".big", "<i8").reshape(2, -1)
                    n[big] = table_[1][np.searchsorted(table_[0], a[found][big])]
                hits[found] = n
            count[at] = hits
            if s >= shards.n:
                rows[:, at] = np.asarray(m["hot_rows"].get(lo, np.zeros(4)), dtype=np.float64)[:, None]
            elif s in m["files"]:
                rows[:, at] = self._map(m["files"][s] + ".row", "<i8").reshape(4, -1)[:, f]
        return count, rows

    def _mixed(self, count, rows, d2, low):
        """Interpolated probability from counts, row sums and the lower order's."""
        seen = rows[3] > 0
        total = np.where(seen, rows[3], 1)
        gamma = (d2[..., 0] * rows[0] + d2[..., 1] * rows[1] + d2[..., 2] * rows[2]) / total
        return np.where(seen, self._discounted(count, d2) / total + gamma * low, low)

    def bigram(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        m = self.m
        d1, c = m["d1"][0], m["cont_counts"][0]
        base = d1 @ c[:3] / c[3] if c[3] else 1.0
        low = self._discounted(self.continuations(second), d1) / max(1, c[3]) + base / (m["size"] + 1)
        return self._mixed(*self.counts(first, second), m["d2"][0], low)

    def score_without_own(self, texts: pa.Array, langs: pa.Array, split=None):
        """(tokens, frequency score, model score) of each text under its language's
        model, with the text's own counts taken out of all counts; ``split`` are the
        batch's words as they stand."""
        m, rows = self.m, len(texts)
        lang = m["languages"].of(langs)
        code, row, hashes = token_codes(texts, langs, m["languages"], split)
        if not len(row):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        known, k = self.words.ids(hashes), len(hashes)
        before, last = np.empty_like(code), np.append(row[1:] != row[:-1], True)
        before[1:] = code[:-1]
        before[np.append(True, last[:-1])] = code[last]  # a text opens with its language's end
        cell, own = np.unique((row * k + before) * k + code, return_counts=True)  # one cell per text and bigram
        head, second = cell // k, cell % k
        r = head // k
        count, sums = self.counts(known[head % k], known[second])
        left = np.maximum(0, count - own)

        def moved(kinds, at, before, after):
            """How the numbers of once, twice and more often change, summed at ``at``."""
            kind = lambda n: np.minimum(n, 3).astype(np.int64)
            return [np.bincount(at, (kind(after) == k) * 1.0 - (kind(before) == k), kinds) for k in (1, 2, 3)]

        at = np.cumsum(np.append(False, head[1:] != head[:-1]))  # cells of a context follow each other
        change = np.stack([*moved(at[-1] + 1, at, count, left), -np.bincount(at, np.minimum(own, count))])
        sums = np.maximum(0, sums + change[:, at])
        word, at = np.unique(r * k + second, return_inverse=True)
        of, ids = word // k, known[word % k]
        cont = self.continuations(ids)
        gone = (count > 0) & (left == 0)
        rest = np.maximum(0, cont - np.bincount(at, gone, len(word)))
        c = m["cont_counts"][lang].T + np.stack([*moved(rows, of, cont, rest), -np.bincount(r, gone, rows)])
        d1, size = m["d1"][lang], m["sizes"][lang]
        base = np.where(c[3] > 0, (d1.T * c[:3]).sum(0) / np.maximum(1, c[3]), 1.0)
        low = self._discounted(rest, d1[of]) / np.maximum(1, c[3])[of] + (base / (size + 1))[of]
        logs = np.log10(self._mixed(left, sums, m["d2"][lang[r]], low[at]))
        n = np.bincount(row, minlength=rows)
        freq = np.zeros(len(ids))
        freq[ids >= 0] = self.words.store.take("n", ids[ids >= 0])
        own_words = np.bincount(at, own, len(word))
        plain = np.log10((np.maximum(0, freq - own_words) + 1) / (np.maximum(0, m["lang_tokens"][lang] - n) + size + 1)[of])
        return n, np.bincount(of, own_words * plain, rows), np.bincount(r, own * logs, rows)

    def score(self, texts: pa.Array):
        """(tokens, known tokens, base score, model score) of each text."""
        first, second, row = bigram_stream(texts, self.words)
        rows = len(texts)
        ids, inv = np.unique(second, return_inverse=True)
        counts = np.zeros(len(ids))
        have = ids >= 0
        counts[have] = self.words.store.take("n", ids[have])
        base = np.log10((counts + 1) / (self.m["tokens"] + self.m["size"] + 1))[inv]
        pairs, at = np.unique(((first + 1) << 32) | (second + 1), return_inverse=True)
        logs = np.log10(self.bigram((pairs >> 32) - 1, (pairs & 0xFFFFFFFF) - 1))[at]
        return (np.bincount(row, minlength=rows), np.bincount(row, (counts > 0)[inv], rows).astype(np.int64),
                np.bincount(row, base, rows), np.bincount(row, logs, rows))


def is_held_out(doc_id):
    """crc32 of the id as text, modulo the folds; null ids train."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Learns from all rows that are not held out and scores all. Null and empty
    texts are the end alone. Repeated rows count and come back as often as they
    come; null ids are never held out; without training rows every token is
    unknown; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out("doc_id").alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    model = train(rows.filter(~F.col("held_out")).select("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # file names and shard ranges only

    def run(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            n, known, base, score = scorer.score(b.column(2))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "held_out": b.column(1), "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([model_tokens] * len(n), pa.int64()),
                "base_score": pa.array(base), "score": pa.array(score)})

    model_tokens = model["tokens"]
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def op5_lm_score(spark, sf_dir):
    """Model and base scores of all documents."""
    prepare(spark)
    return score_documents(table(spark, sf_dir, "documents"))

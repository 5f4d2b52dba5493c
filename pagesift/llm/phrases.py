"""Phrase collocation mining, level by level.

Words of a language that come often enough get ids; the texts are written once as
ids, where a piece's end or a rare word is a break, since no frequent phrase spans
either. A phrase of ``m`` words is a candidate if both its parts of ``m - 1`` words
are frequent (Apriori) and its capped occurrence counts reach the least count. The
candidates of a level become double-array tries of bounded size. Tasks walk all text
positions through them together, one symbol at a time, and count the accepting states;
the counts of all shards of the text are added up.

Everything that grows with the corpus lies in sharded files of the shared folder,
which tasks map one shard at a time; the driver holds the files' names.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm import double_array
from pagesift.llm.arrays import mix
from pagesift.llm.common import broadcast_if_small, fresh_path, prepare, release_worker_object, table, written
from pagesift.llm.hash_store import SortedArrays, map_array, parts_for, save_array, write_sorted

# piece ends; other ASCII white space separates words
ENDS = r"[.,;:!?\n-\r]+"
UNKNOWN_LANG = "und"
# ids that a task looks at together
CHUNK = 4 << 20
# phrase occurrences of one filter shard, phrases of one trie
FILTER_SHARD = 2 << 20
TRIE_PHRASES = 100_000
# first ranking: sub-groups of a language; copies of a word that phrases meet
SALTS, WORD_COPIES = 64, 8
# files that a task keeps mapped
_MAPPED = 256
_MAX_LANGS = 100_000
VOCABULARY = {"check": "<i8", "n": "<i8"}


def batch_tokens(langs: pa.Array, texts: pa.Array):
    """Tokens of a batch with piece ends between them.

    Returns (codes, distinct, langs of codes): token codes in order, -1 at each end of
    a piece or text; the words and the languages that the codes stand for."""
    text = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), ENDS, " . ")
    text = pc.binary_join_element_wise(text, ".", " ")  # a text's end; "." is in no word
    parts = pc.ascii_split_whitespace(text)
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy(zero_copy_only=False)))
    enc = parts.flatten().dictionary_encode()
    code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    gap = [i for i in (pc.index(enc.dictionary, ".").as_py(), pc.index(enc.dictionary, "").as_py()) if i >= 0]
    end = np.isin(code, gap)
    lang = pc.fill_null(langs, UNKNOWN_LANG).dictionary_encode()
    size = max(1, len(enc.dictionary))
    both = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + code
    used, inverse = np.unique(both[~end], return_inverse=True)
    out = np.full(len(code), -1, dtype=np.int64)
    out[~end] = inverse
    return out, enc.dictionary.take(pa.array(used % size)), lang.dictionary.take(pa.array(used // size))


def word_keys(langs: pa.Array, words: pa.Array):
    """Two 64-bit halves of a 128-bit hash of each (language, word)."""
    raw = [f"{len(a)}:{a}{w}".encode("utf-8", "surrogatepass") for a, w in zip(langs.to_pylist(), words.to_pylist())]
    h = b"".join(xxhash.xxh3_128_digest(x) for x in raw)
    both = np.frombuffer(h, ">i8").reshape(-1, 2).astype(np.int64)
    return both[:, 0].copy(), both[:, 1].copy()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts."""

    def run(batches):
        release_worker_object()
        for b in batches:
            codes, words, langs = batch_tokens(b.column(0), b.column(1))
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([langs, words, pa.array(n.astype(np.int64))], ["lang", "word", "n"])

    return (docs.mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Frequent words of all languages; a word's id is its rank by hash."""

    def __init__(self, manifest):
        self.store = SortedArrays(manifest, VOCABULARY)

    def __len__(self):
        return len(self.store)

    def ids(self, langs: pa.Array, words: pa.Array) -> np.ndarray:
        key, check = word_keys(langs, words)
        at = self.store.find(key)
        seen = at >= 0
        at[np.flatnonzero(seen)[self.store.take("check", at[seen]) != check[seen]]] = -1
        return at

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.store.take("n", ids)


def write_vocabulary(frequent: DataFrame, parts: int, name: str) -> list[tuple]:
    """Store (lang, word, n) as sorted arrays; the driver gets one row per file."""

    def run(batches):
        for b in batches:
            key, check = word_keys(b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), b.column(2)], ["key", "check", "n"])

    return write_sorted(frequent.mapInArrow(run, "key long, check long, n long"), "key", VOCABULARY, parts, name)


def encoded(docs: DataFrame, manifest) -> DataFrame:
    """The texts as ids plus one, one row per batch; 0 is a break."""

    def run(batches):
        vocabulary = Vocabulary(manifest)
        for b in batches:
            codes, words, langs = batch_tokens(b.column(0), b.column(1))
            ids = np.append(vocabulary.ids(langs, words), -1)[codes] + 1
            keep = ids > 0
            keep[1:] |= ids[:-1] > 0  # one break is enough
            yield pa.RecordBatch.from_pydict({"ids": pa.array([ids[keep].astype("<u4").tobytes()], pa.binary())})

    return docs.mapInArrow(run, "ids binary")


def _chunks(batches):
    """Arrays of ids plus one, of about ``CHUNK`` each or as long as one row."""
    have, size = [], 0
    for b in batches:
        for x in b.column(0):
            have.append(np.frombuffer(x.as_buffer(), "<u4"))
            size += len(have[-1])
            if size >= CHUNK:
                yield np.concatenate([*have, [0]]).astype(np.int64)
                have, size = [], 0
    if size:
        yield np.concatenate([*have, [0]]).astype(np.int64)


class Level:
    """The tries of the phrases of ``m`` words: ``files[i]`` holds those whose first
    two words fall to shard ``i``."""

    def __init__(self, m: int, words: int, files: list[str], sizes: list[int]):
        self.m, self.words, self.files = m, words, files
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.count_files: list[str] = []
        self._maps: dict = {}

    def load(self, i: int, *kinds: str):
        out = []
        for k in kinds:
            if (i, k) not in self._maps:
                if len(self._maps) >= _MAPPED:
                    self._maps.clear()
                self._maps[i, k] = (map_array(self.count_files[i], "<i8") if k == "n"
                                    else map_array(f"{self.files[i]}.{k}", "<i4"))
            out.append(self._maps[i, k])
        return out

    def shard_of(self, columns) -> np.ndarray:
        return shard_of(columns[0], columns[1], len(self.files))

    def states(self, columns) -> np.ndarray:
        """Number of the state after the phrase of each row over all shards, or -1."""
        out = np.full(len(columns[0]), -1, dtype=np.int64)
        for i, rows in by_shard(self.shard_of(columns), len(self.files)):
            t = double_array.walk(*self.load(i, "base", "check"), [c[rows] for c in columns], self.words)
            out[rows] = np.where(t >= 0, t + self.first[i], -1)
        return out

    def counts(self, states: np.ndarray) -> np.ndarray:
        """Occurrences of the phrases that end in these states; 0 for -1."""
        out = np.zeros(len(states), dtype=np.int64)
        shard = np.where(states < 0, len(self.files), np.searchsorted(self.first, states, "right") - 1)
        for i, rows in by_shard(shard, len(self.files)):
            out[rows] = self.load(i, "n")[0][states[rows] - self.first[i]]
        return out

    def spell(self, states: np.ndarray) -> np.ndarray:
        out = np.zeros((len(states), self.m), dtype=np.int64)
        for i, rows in by_shard(np.searchsorted(self.first, states, "right") - 1, len(self.files)):
            out[rows] = double_array.spell(*self.load(i, "base", "check"), states[rows] - self.first[i],
                                           self.m, self.words)
        return out


def shard_of(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Shard of a phrase by its first two words, so that a common word is split."""
    return (mix((first.astype(np.uint64) << np.uint64(32)) ^ second.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def by_shard(shard: np.ndarray, n: int):
    """(shard, its rows) for the shards below ``n`` that have rows."""
    order = np.argsort(shard.astype(np.uint16) if n < 1 << 16 else shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i]:cuts[i + 1]]


def occurrences(x: np.ndarray, m: int, below: Level | None, least: int):
    """Where phrases of ``m`` words start whose parts are frequent: (places, codes).

    A code is the state of the first ``m - 1`` words (their id for one word) times the
    number of words, plus the last word's id."""
    pair = (x[:-1] > 0) & (x[1:] > 0)
    if below is None:
        at = np.flatnonzero(pair)
        return at, x[at] - 1, x[at + 1] - 1
    inside = pair.copy()
    for k in range(1, below.m - 1):
        inside[:-k] &= pair[k:]
        inside[-k:] = False
    at = np.flatnonzero(inside)
    state = below.states([x[at + k] - 1 for k in range(below.m)])
    state[below.counts(state) < least] = -1
    full = np.full(len(x) + 1, -1, dtype=np.int64)
    full[at] = state
    at = np.flatnonzero((full[:-1] >= 0) & (full[1:] >= 0))
    return at, full[at], x[at + m - 1] - 1


def candidates(ids: DataFrame, m: int, below: Level | None, words: int, least: int, shards: int) -> DataFrame:
    """(phrases, n): blobs of candidate phrases, as many word ids as ``n`` times ``m``.

    Tasks send each distinct phrase with its occurrences, capped at ``least`` in a
    byte; a phrase is a candidate if these reach ``least``, so none that is frequent
    is missed."""
    heads = words if below is None else int(below.first[-1])
    if heads * words >= 1 << 63:
        raise ValueError(f"{heads} phrases times {words} words do not fit a 64-bit code")
    cap = min(least, 255)

    def gather(batches):
        for x in _chunks(batches):
            _, head, last = occurrences(x, m, below, least)
            code, n = np.unique(head * words + last, return_counts=True)
            for i, rows in by_shard((mix(code.astype(np.uint64)) % np.uint64(shards)).astype(np.int64), shards):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([i], pa.int32()),
                    "codes": pa.array([np.diff(code[rows], prepend=0).tobytes()], pa.binary()),
                    "n": pa.array([np.minimum(n[rows], cap).astype("u1").tobytes()], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        code = np.concatenate([np.cumsum(np.frombuffer(c.as_buffer(), "<i8")) for c in t.column("codes")])
        n = np.concatenate([np.frombuffer(c.as_buffer(), "u1") for c in t.column("n")])
        order = np.argsort(code, kind="stable")
        code = code[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        total = np.add.reduceat(n[order].astype(np.int64), start)
        code = code[start[total >= cap]]
        if not len(code):
            return pa.table({"phrases": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        head, last = code // words, code % words
        phrases = np.column_stack([head if below is None else below.spell(head), last]).astype("<u4")
        return pa.table({"phrases": pa.array([phrases.tobytes()], pa.binary()), "n": pa.array([len(phrases)], pa.int64())})

    return (ids.mapInArrow(gather, "shard int, codes binary, n binary")
            .groupBy("shard").applyInArrow(merge, "phrases binary, n long"))


_FILES = "shard int, file string, states long"


def write_tries(found: DataFrame, m: int, words: int, shards: int, name: str) -> tuple[list[str], list[int]]:
    """Build a trie per shard of the candidates; returns file names and state counts."""
    folder = fresh_path(found.sparkSession, name)

    def deal(batches):
        for b in batches:
            for x in b.column(0):
                p = np.frombuffer(x.as_buffer(), "<u4").reshape(-1, m)
                for i, rows in by_shard(shard_of(p[:, 0], p[:, 1], shards), shards):
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([i], pa.int32()),
                                                      "phrases": pa.array([p[rows].tobytes()], pa.binary())})

    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in t.column("phrases")]).reshape(-1, m)
        base, check, _ = double_array.build(p.astype(np.int64), words)
        file = os.path.join(folder, uuid.uuid4().hex)
        save_array(file + ".base", base)
        save_array(file + ".check", check)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": pa.array([file]),
                         "states": pa.array([len(base)], pa.int64())})

    rows = (found.mapInArrow(deal, "shard int, phrases binary").groupBy("shard").applyInArrow(build, _FILES)
            .collect())  # one row per trie
    have = {r.shard: r for r in rows}
    if len(have) < shards:  # a shard without phrases: a trie of the root alone
        empty = os.path.join(folder, "none")
        span = double_array.radix(words)
        save_array(empty + ".base", np.zeros(span + 1, np.int32))
        save_array(empty + ".check", np.full(span + 1, -1, np.int32))
    files = [have[i].file if i in have else empty for i in range(shards)]
    return files, [have[i].states if i in have else double_array.radix(words) + 1 for i in range(shards)]


def count_level(ids: DataFrame, level: Level, below: Level | None, least: int) -> Level:
    """Fill in the level's counts: tasks count accepting states per chunk of text, and
    the counts of each trie are added up while they stream by."""
    spark = ids.sparkSession
    sizes = np.diff(level.first).tolist()

    def count(batches):
        for x in _chunks(batches):
            at, _, _ = occurrences(x, level.m, below, least)
            state = level.states([x[at + k] - 1 for k in range(level.m)])
            state = state[state >= 0]
            for i, rows in by_shard(np.searchsorted(level.first, state, "right") - 1, len(sizes)):
                n = np.bincount(state[rows] - level.first[i], minlength=1)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([i], pa.int32()),
                    "states": pa.array([np.diff(hit, prepend=0).astype("<u4").tobytes()], pa.binary()),
                    "n": pa.array([n[hit].astype("<u4").tobytes()], pa.binary())})

    folder = fresh_path(spark, f"counts-{level.m}")

    def add(batches):
        shard, total = None, None

        def done():
            file = os.path.join(folder, uuid.uuid4().hex)
            save_array(file, total.astype("<i8"))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": pa.array([file])})

        for b in batches:
            for i, states, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if i != shard:
                    if shard is not None:
                        yield done()
                    shard, total = i, np.zeros(sizes[i], dtype=np.int64)
                total[np.cumsum(np.frombuffer(states.as_buffer(), "<u4").astype(np.int64))] += np.frombuffer(n.as_buffer(), "<u4")
        if shard is not None:
            yield done()

    rows = (ids.mapInArrow(count, "shard int, states binary, n binary").repartition(len(sizes), "shard")
            .sortWithinPartitions("shard").mapInArrow(add, "shard int, file string").collect())  # one row per trie
    have = {r.shard: r.file for r in rows}
    none = os.path.join(folder, "none")
    if len(have) < len(sizes):
        save_array(none, np.zeros(max(sizes), dtype="<i8"))
    level.count_files = [have.get(i, none) for i in range(len(sizes))]
    return level


_PHRASE = "m int, state long, key array<long>, a long, l long, r long, score long"


def scored_phrases(spark, level: Level, levels: dict[int, Level], manifest, least: int, contain_percent: int):
    """Two tables from the counted trie ``level``: its phrases with their lowest-scoring
    cut, and the shorter phrases (m, state) that lie in one of them often enough to go."""

    def count_of(vocabulary, p: np.ndarray):
        if p.shape[1] == 1:
            return vocabulary.counts(p[:, 0]), None
        lower = levels[p.shape[1]]
        state = lower.states([p[:, k] for k in range(p.shape[1])])
        return lower.counts(state), state

    def phrases_of(i, vocabulary):
        n = np.asarray(level.load(i, "n")[0])
        local = np.flatnonzero(n >= least)
        return local + level.first[i], level.spell(local + level.first[i]), n[local]

    def score(batches):
        vocabulary = Vocabulary(manifest)
        for b in batches:
            for i in b.column(0).to_pylist():
                state, p, a = phrases_of(i, vocabulary)
                best = None
                for k in range(1, level.m):
                    left, right = count_of(vocabulary, p[:, :k])[0], count_of(vocabulary, p[:, k:])[0]
                    # whole numbers of any length
                    s = np.array([1_000_000 * x * x // (y * z) for x, y, z in
                                  zip(a.tolist(), left.tolist(), right.tolist())], dtype=np.int64)
                    if best is None:
                        best = [s, left, right]
                    else:
                        lower = s < best[0]
                        best = [np.where(lower, new, old) for new, old in zip((s, left, right), best)]
                keys = vocabulary.store.keys_at(p.reshape(-1)) if p.size else np.empty(0, np.int64)
                off = pa.array(np.arange(len(p) + 1) * level.m, pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "m": pa.array(np.full(len(p), level.m, np.int32)), "state": pa.array(state),
                    "key": pa.ListArray.from_arrays(off, pa.array(keys)), "a": pa.array(a),
                    "l": pa.array(best[1]), "r": pa.array(best[2]), "score": pa.array(best[0])})

    def dropped(batches):
        vocabulary = Vocabulary(manifest)
        for b in batches:
            for i in b.column(0).to_pylist():
                _, p, a = phrases_of(i, vocabulary)
                for m in range(2, level.m):
                    for k in range(level.m - m + 1):
                        n, state = count_of(vocabulary, p[:, k:k + m])
                        gone = np.unique(state[100 * a >= contain_percent * n])
                        yield pa.RecordBatch.from_pydict({"m": pa.array(np.full(len(gone), m, np.int32)),
                                                          "state": pa.array(gone)})

    shards = spark.range(len(level.files), numPartitions=min(len(level.files), 1 << 16)).select(F.col("id").cast("int"))
    return shards.mapInArrow(score, _PHRASE), shards.mapInArrow(dropped, "m int, state long")


def _spelled(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """The phrases with lang and text. Words are fetched by hash from several copies,
    each for a share of the phrases, so that a common word is no hot key."""

    def with_keys(batches):
        for b in batches:
            key, _ = word_keys(b.column(0), b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], ["k", "lang", "word"])

    words = (frequent.select("lang", "word").mapInArrow(with_keys, "k long, lang string, word string")
             .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(WORD_COPIES - 1)))))
    slots = phrases.withColumn("copy", F.pmod(F.xxhash64("m", "state"), F.lit(WORD_COPIES)).cast("int")).select(
        "m", "state", "copy", "a", "l", "r", "score", F.posexplode("key").alias("pos", "k"))
    return (slots.join(words.hint("merge"), ["k", "copy"])  # grows with the corpus: no broadcast
            .groupBy("m", "state", "a", "l", "r", "score")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), F.first("lang").alias("lang"))
            .withColumn("phrase", F.concat_ws(" ", F.col("w.word"))).drop("w"))


def mine_phrases(docs: DataFrame, max_words: int = 3, min_count: int = 10, contain_percent: int = 50,
                 top: int | None = 2000) -> DataFrame:
    """Collocations of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``a`` counts a phrase's occurrences, ``l`` and ``r`` those of its two parts at the
    lowest-scoring cut (the first of equals), ``n`` the language's words; score is
    floor(1000000 * a * a / (l * r)). Phrases that lie inside a longer one with at least
    ``contain_percent`` percent of their occurrences are left out; ``top`` of each
    language are returned, all if None.

    A null text has no words, a null language is ``und``; repeated rows count again;
    an empty table, or one without frequent phrases, gives no rows; other columns
    are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                       F.col("text").cast("string").alias("text"))
    counts = written(word_counts(docs), "phrase-words")
    langs = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    frequent = counts.filter(F.col("n") >= min_count)
    size, total = frequent.agg(F.count("*"), F.sum("n")).first()
    manifest = write_vocabulary(frequent, parts_for(size), "phrase-vocabulary")
    words = max(1, size)
    ids = written(encoded(docs, manifest), "phrase-ids")
    levels: dict[int, Level] = {}
    out = drops = None
    for m in range(2, max_words + 1):
        below = levels.get(m - 1)
        if m > 2 and below is None:
            break
        shards = max(1, -(-(total or 0) // FILTER_SHARD))
        found = written(candidates(ids, m, below, words, min_count, shards), f"phrase-candidates-{m}")
        n = found.agg(F.sum("n")).first()[0] or 0
        if not n:
            break
        tries = max(1, -(-n // TRIE_PHRASES))
        levels[m] = count_level(ids, Level(m, words, *write_tries(found, m, words, tries, f"phrase-tries-{m}")),
                                below, min_count)
        rows, gone = scored_phrases(spark, levels[m], dict(levels), manifest, min_count, contain_percent)
        out = rows if out is None else out.unionByName(rows)
        if m > 2:
            drops = gone if drops is None else drops.unionByName(gone)
    if out is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    if drops is not None:
        out = out.join(drops.distinct().hint("merge"), ["m", "state"], "left_anti")  # no broadcast: grows with the corpus
    rows = _spelled(out, frequent)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # the best of each sub-group first, so that no task sorts a whole language
        sub = Window.partitionBy("lang", "salt").orderBy(*order)
        rows = (rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
                .withColumn("rank", F.row_number().over(sub)).filter(F.col("rank") <= top).drop("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.filter(F.col("rank") <= top)
    return (rows.join(broadcast_if_small(langs, _MAX_LANGS), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_phrases(spark, sf_dir):
    """The 2000 best collocations of two or three words of each language."""
    prepare(spark)
    return mine_phrases(table(spark, sf_dir, "documents"))


_WORDS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS piece, piece AS body
  FROM (SELECT lang, doc_id, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), parts AS (
  SELECT lang, piece, list_filter(regexp_split_to_array(body, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), w AS (
  SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM parts
), t AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM w
  WINDOW p AS (PARTITION BY piece ORDER BY i)
), f1 AS (SELECT lang, w1, count(*) AS n FROM t GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang)
"""
OP12_SQL = _WORDS + r""", c2 AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.n AS a, x.n AS l, y.n AS r,
         (1000000::HUGEINT * p.n * p.n) // (x.n::HUGEINT * y.n) AS score, p.w1, p.w2
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE p.n >= 10
), k3 AS (
  SELECT q.lang, q.w1 || ' ' || q.w2 || ' ' || q.w3 AS phrase, q.n AS a, b.n AS b, x.n AS x, c.n AS c, z.n AS z,
         (1000000::HUGEINT * q.n * q.n) // (x.n::HUGEINT * c.n) AS s1,
         (1000000::HUGEINT * q.n * q.n) // (b.n::HUGEINT * z.n) AS s2
  FROM f3 q JOIN f2 b ON b.lang = q.lang AND b.w1 = q.w1 AND b.w2 = q.w2
  JOIN f2 c ON c.lang = q.lang AND c.w1 = q.w2 AND c.w2 = q.w3
  JOIN f1 x ON x.lang = q.lang AND x.w1 = q.w1 JOIN f1 z ON z.lang = q.lang AND z.w1 = q.w3
), c3 AS (
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN x ELSE b END AS l, CASE WHEN s1 <= s2 THEN c ELSE z END AS r,
         least(s1, s2) AS score FROM k3
), kept AS (
  SELECT lang, phrase, a, l, r, score FROM c2 WHERE NOT EXISTS (
    SELECT 1 FROM f3 q WHERE q.lang = c2.lang AND q.w1 = c2.w1 AND q.w2 = c2.w2 AND 100 * q.n >= 50 * c2.a)
  AND NOT EXISTS (
    SELECT 1 FROM f3 q WHERE q.lang = c2.lang AND q.w2 = c2.w1 AND q.w3 = c2.w2 AND 100 * q.n >= 50 * c2.a)
  UNION ALL SELECT * FROM c3
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r,
       t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""

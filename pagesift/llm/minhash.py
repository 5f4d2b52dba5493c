"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. A task computes each document's distinct shingles, its minima under
   ``BANDS * ROWS`` hash functions, one hash per band of minima, and the minima's
   low bits packed into words. Documents with one shingle set form a class; only
   one row per class goes on, so copies never meet each other in pairs.
2. Classes that share a band hash are candidates. Each bucket offers its smallest
   class to all others (as many pairs as members). Packed signatures are compared
   by bit counts, corrected for chance agreement; what may reach the threshold is
   verified on the full sets, and links are joined into components.
3. A bucket whose members still lie in several components is searched in full:
   blocks of its members are compared in one task each, where only pairs across
   components are verified, each pair in its first shared bucket alone, and only
   links that join two components are emitted.
   Hence no link between different texts is lost, and no bucket emits its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagesift.llm.arrays import _GOLD, batch_words, distinct_per_row, mix, raw_bytes, shingles, word_hashes
from pagesift.llm.common import prepare, table, written, scratch
from pagesift.llm.components import components
from pagesift.llm.hash_store import SortedArrays, write_sorted, parts_for

# 32 bands of 4 minima: a pair at 0.8 is missed with probability 5e-8
BANDS, ROWS = 32, 4
BITS = 2  # kept of each minimum
_N = BANDS * ROWS
_WORDS = _N * BITS // 64
# distance below the threshold at which an estimate still counts: over 5 deviations
MARGIN = 0.22
BLOCK = 2048  # members of a bucket compared by one task
SIGS = [f"s{i}" for i in range(_WORDS)]
_LOW = sum(1 << (BITS * i) for i in range(64 // BITS))

_rng = np.random.default_rng(20240229)
_MULT = _rng.integers(0, 1 << 63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, _N, dtype=np.uint64)


def shingle_sets(texts: pa.Array, n: int):
    """Distinct ``n``-word shingle hashes of each text, sorted, and offsets."""
    codes, row, distinct = batch_words(texts, lower=True)
    values, at = shingles(codes, row, word_hashes(distinct), n)
    return distinct_per_row(values, at, len(texts))


def set_keys(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit key of each non-empty set."""
    full = np.flatnonzero(np.diff(offsets))
    view = raw_bytes(values)
    return [xxhash.xxh3_128_digest(view[8 * offsets[i]:8 * offsets[i + 1]]) for i in full.tolist()]


def signatures(values: np.ndarray, offsets: np.ndarray):
    """(band hashes, packed low bits) of each non-empty set."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][full]
    minima = np.empty((len(full), _N), dtype=np.uint64)
    for k in range(_N if len(full) else 0):
        minima[:, k] = np.minimum.reduceat(values * _MULT[k] + _ADD[k], starts)
    bands = np.empty((len(full), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        acc = np.full(len(full), np.uint64(b + 1))
        for k in range(ROWS):
            acc = mix(acc * _GOLD + minima[:, ROWS * b + k])
        bands[:, b] = acc
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    packed = np.zeros((len(full), _WORDS), dtype=np.uint64)
    for k in range(_N):
        packed[:, k // per] |= low[:, k] << np.uint64(BITS * (k % per))
    return bands, packed


def document_signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, cls, bands, s0.. of each row."""

    def run(batches):
        for b in batches:
            values, offsets = shingle_sets(b.column(2), n)
            sizes = np.diff(offsets)
            full_at = np.cumsum(sizes > 0) - 1
            pick = pa.array(np.where(sizes > 0, full_at, 0), mask=sizes == 0)
            bands, packed = signatures(values, offsets)
            cls = pa.array(set_keys(values, offsets), pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()),
                                             pa.array(bands.ravel().view(np.int64)))
            out = {"doc_id": b.column(0), "th": b.column(1), "n_shingles": pa.array(sizes.astype(np.int64)),
                   "cls": cls.take(pick), "bands": lists.take(pick)}
            for i, s in enumerate(SIGS):
                out[s] = pa.array(packed[:, i].view(np.int64)).take(pick)
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, th long, n_shingles long, cls binary, bands array<long>, " + ", ".join(f"{s} long" for s in SIGS)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"),
                       F.col("text").cast("string")).mapInArrow(run, schema)


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed signatures of aliases ``a`` and ``b``: the share
    of agreeing minima, corrected for low bits that agree by chance."""
    low = F.lit(_LOW - (1 << 64) if _LOW >> 63 else _LOW)
    differ = F.lit(0)
    for s in SIGS:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for k in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")), k))
        differ = differ + F.bit_count(x.bitwiseAND(low))
    chance = 1.0 / (1 << BITS)
    return ((F.lit(1.0) - differ / F.lit(float(_N))) - chance) / (1 - chance)


def full_sets(docs: DataFrame, n: int, classes: DataFrame) -> DataFrame:
    """(cls, shingles) for the given classes, from the whole texts. Tasks look the
    classes up in a memory-mapped array, so other texts' sets never leave them."""
    key = classes.select(F.xxhash64("cls").alias("key")).distinct()
    key = written(key, "wanted-keys")
    manifest = write_sorted(key, "key", {}, parts_for(key.count()), "wanted")

    def run(batches):
        wanted, seen = SortedArrays(manifest, {}), set()
        for b in batches:
            values, offsets = shingle_sets(b.column(0), n)
            keys = set_keys(values, offsets)
            full = np.flatnonzero(np.diff(offsets))
            hit = wanted.find(np.fromiter((_spark_hash(k) for k in keys), np.int64, len(keys))) >= 0
            rows = [(k, values[offsets[i]:offsets[i + 1]].tobytes())
                    for k, i, h in zip(keys, full.tolist(), hit) if h and k not in seen]
            rows = list(dict(rows).items())
            seen.update(k for k, _ in rows)
            if len(seen) > 1_000_000:
                seen.clear()
            if rows:
                yield pa.RecordBatch.from_pydict({"cls": pa.array([k for k, _ in rows], pa.binary()),
                                                  "shingles": pa.array([v for _, v in rows], pa.binary())})

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "cls binary, shingles binary")
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles")).join(classes.distinct(), "cls", "left_semi")


def _spark_hash(key: bytes) -> int:
    """Spark's xxhash64 of a binary value (seed 42) as a signed number."""
    h = xxhash.xxh64_intdigest(key, 42)
    return h - (1 << 64) if h >> 63 else h


@F.arrow_udf(LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
           for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(out, pa.int64())


def linked(common, a, b, percent: int):
    """Whether sets of sizes ``a`` and ``b`` with ``common`` shared values link."""
    return 100 * common >= percent * (a + b - common)


def _block_links(percent: int):
    """Links across components between two blocks of one bucket."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cls", "ascending")])
        cls, comp = t.column("cls").to_pylist(), t.column("comp").to_pylist()
        side, bi = t.column("side").to_numpy(), t.column("bi")[0].as_py()
        # bands before this one: a pair that shares one is verified there
        bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[:, :bi]
        sig = np.stack([t.column(s).to_numpy() for s in SIGS], axis=1).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        parent = {c: c for c in comp}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        left, right = np.flatnonzero(side < 2), np.flatnonzero((side == 0) | (side == 2))
        least = percent / 100 - MARGIN
        out = []
        for i in left.tolist():
            x = sig[right] ^ sig[i]
            y = x.copy()
            for k in range(1, BITS):
                y |= x >> np.uint64(k)
            differ = np.bitwise_count(y & np.uint64(_LOW)).sum(axis=1)
            est = ((1 - differ / _N) - 2.0 ** -BITS) / (1 - 2.0 ** -BITS)
            near = (est >= least) & (np.minimum(sizes[right], sizes[i]) * 100 >= percent * np.maximum(sizes[right], sizes[i]))
            near[near] &= ~(bands[right[near]] == bands[i]).any(axis=1)
            for j in right[near].tolist():
                a, b = root(comp[i]), root(comp[j])
                if a != b and linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)),
                                     sizes[i], sizes[j], percent):
                    parent[a] = b
                    out.append((cls[i], cls[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()),
                         "b": pa.array([y for _, y in out], pa.binary())})

    return run


def link_classes(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, root) components over classes (cls, n_shingles, bands, s0..)."""
    bands = written(classes.select(F.posexplode("bands").alias("bi", "band"), "cls"), "bands")
    buckets = written(bands.groupBy("band").agg(F.min("cls").alias("center"), F.count("*").alias("m"))
                      .filter("m > 1"), "buckets")
    members = written(bands.join(buckets, "band"), "members")
    sigs = classes.select("cls", "n_shingles", "bands", *SIGS)
    pairs = members.filter("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b")).distinct()
    sized = (pairs.join(sigs.alias("x"), F.col("a") == F.col("x.cls"))
             .join(sigs.alias("y"), F.col("b") == F.col("y.cls"))
             .filter((estimate("x", "y") >= percent / 100 - MARGIN)
                     & (100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")))
             .select("a", "b", F.col("x.n_shingles").alias("na"), F.col("y.n_shingles").alias("nb")))
    sized = written(sized, "pairs")
    sets = written(full_sets(docs, n, members.select("cls")), "sets")
    links = (sized.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
             .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
             .withColumn("c", _common("sa", "sb"))
             .filter(linked(F.col("c"), F.col("na"), F.col("nb"), percent)).select("a", "b"))
    links = written(links, "links")
    first = components(links)
    # buckets that still hold several components, one of those with equal members
    inside = written(members.join(first.withColumnRenamed("node", "cls"), "cls", "left")
                     .withColumn("comp", F.coalesce("root", "cls")).select("bi", "band", "m", "cls", "comp"), "inside")
    mixed = (inside.groupBy("bi", "band", "m").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                             F.expr("bit_xor(xxhash64(cls))").alias("f1"),
                                             F.expr("bit_xor(xxhash64(cls, 7))").alias("f2"))
             .filter("x <> y").groupBy("m", "f1", "f2").agg(F.min_by("band", "bi").alias("band")).select("band"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    # a member's block meets every block; side 0: same block, 1 and 2: the two blocks of a pair
    left = (inside.join(written(mixed, "mixed"), "band").withColumn("nb", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("bi", "band", "cls", "comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")))
    rest = (left.join(sigs.drop("n_shingles"), "cls").join(sets, "cls").groupBy("band", "i", "j")
            .applyInArrow(_block_links(percent), "a binary, b binary"))
    rest = written(rest, "more-links")
    return components(first.selectExpr("node AS a", "root AS b").unionByName(rest))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), n_shingles,
    component_id (smallest doc_id reachable over links) and kept.

    Links need ``100 * intersection >= percent * union`` of distinct ``n``-word
    shingles (lower-cased words; a shorter text is one shingle). Null, empty and
    blank texts have no shingles and link with nothing. Rows with equal sets
    are linked; repeated rows get equal results. A component with no doc_id at
    all has a null component_id; there, as for a null id alone, kept compares
    nulls as equal. An empty table gives no rows; other columns are ignored."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(written(document_signatures(docs, n), "signatures"))
        known = keep(_class_components(docs, rows, n, percent))
    out = rows.select("doc_id", "th", "n_shingles", "cls").join(known, "cls", "left").withColumn(
        "component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        "doc_id", "th", "n_shingles", "component_id", "kept")


def _class_components(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(cls, component_id) of the distinct sets of signature rows, written."""
    classes = written(rows.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        *[F.first(s).alias(s) for s in SIGS]), "classes")
    roots = written(link_classes(docs, classes, n, percent), "roots")
    of = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "root", F.coalesce("root", "cls"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(of.join(ids, "root").select("cls", "component_id"), "class-components")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns; documents without words
    all stay. Of rows that repeat the kept id and text, one stays."""
    with scratch(docs.sparkSession) as keep:
        verdict = keep(written(near_duplicates(docs, n, percent).filter("kept")
                               .groupBy("doc_id", "th").agg(F.max("n_shingles").alias("words")), "kept"))
    verdict = verdict.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "words")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"),
                       F.xxhash64("text").alias("_hash"))
    rows = rows.join(verdict, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
    blank = F.when(F.col("words") == 0, F.monotonically_increasing_id())
    return rows.withColumn("_blank", blank).dropDuplicates(["_doc", "_hash", "_blank"]).select("row.*")


def op10_near_duplicates(spark, sf_dir):
    """Near-duplicate groups of all documents (three words, 85 percent)."""
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 85).drop("th")

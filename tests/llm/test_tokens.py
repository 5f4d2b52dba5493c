import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagesift.llm import packing, token_files
from pagesift.llm.common import fresh_path
from pagesift.llm.token_ids import ChunkTokenizer

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BITS = [" ", "é", "don't", "D'S", "x'll", "Ünï", "a1b2", "×", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "　", "\xa0", "a", "Σ", "ß", "é", "́",
        "it's", "12", "!!", "日本", "<|endoftext|>", "<|", "İ", " ", "word", "😀", "\x00", "​", "\r\n"]


def whole(path, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,cut", [(WORD, "spaces"), (BYTE, "space_prefix")])
def test_chunked_ids_equal_whole_text_ids(path, cut):
    r = random.Random(5)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 12))) for _ in range(1500)] + [None, "", " "]
    ids, off = ChunkTokenizer(path, cut).encode(pa.array(texts, pa.string()))
    assert [list(ids[a:b]) for a, b in zip(off, off[1:])] == whole(path, texts)


TEXTS = [None, "", "one two three", "one two three", "x " * 5000, "ab cd " * 300, " \n ", "NULLID"] + [
    f"text {i} " * (i % 60) for i in range(200)]


def test_packing_covers_every_id_once(docs):
    d = docs(TEXTS).withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = packing.pack_documents(d, WORD, end_id=1, window=256, group_pieces=64, keep_ids=True)
    got = [r.asDict() for r in rows.collect()]
    expect = {i: x + [1] for i, x in enumerate(whole(WORD, TEXTS))}
    expect[None] = expect.pop(TEXTS.index("NULLID"))
    by_doc, by_seq = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expect)
    for k, v in by_doc.items():
        v.sort(key=lambda r: r["start"])
        assert sum((r["ids"] for r in v), []) == expect[k]
        assert all(r["doc_tokens"] == len(expect[k]) for r in v)
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(map(len, expect.values()))
    assert total / (256 * len(by_seq)) > 0.97
    seqs = packing.sequences(packing.pack_documents(d, WORD, window=256, keep_ids=True), 256)
    assert seqs.filter(F.size("ids") != 256).count() == 0


def test_best_fit_takes_the_tightest_window():
    r = random.Random(1)
    fit, free = packing.BestFit(100), {}
    for _ in range(2000):
        n = r.randint(1, 100)
        fits = [f for f in free.values() if f >= n]
        w, off = fit.place(n)
        if fits:
            assert free[w] == min(fits) and off == 100 - free[w]
        else:
            assert w not in free and off == 0
        free[w] = 100 - off - n


def test_token_files_round_trip(spark, docs):
    d = docs(TEXTS, start=50).repartition(5).withColumn("part", F.lit("clash"))
    path = fresh_path(spark, "t")
    token_files.write_token_files(d, path, BYTE)
    rows = token_files.read_token_files(spark, path).collect()
    expect = {i + 50: x + [0] for i, x in enumerate(whole(BYTE, TEXTS))}
    expect[None] = expect.pop(50 + TEXTS.index("NULLID"))
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == expect
    at = 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        assert r["start"] == at
        at += len(r["ids"])
    digest = token_files.ids_digest(token_files.read_token_files(spark, path)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in digest} == {
        k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in expect.items()}


def test_empty_tables(spark, docs):
    assert packing.pack_documents(docs([]), WORD).count() == 0
    path = fresh_path(spark, "t")
    token_files.write_token_files(docs([]), path, BYTE)
    assert token_files.read_token_files(spark, path).count() == 0

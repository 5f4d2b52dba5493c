"""Page stream with static programs and exactly-once intake."""

import shutil

import pytest
from pyspark.sql import functions as F

from pagesift.plans.common import keyed_pages, site_programs
from pagesift.streaming import extract
from pagesift.streaming.extract import page_stream, run_extraction

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of page files; ``add`` writes one file of the pages below a bound."""
    folder = tmp_path / "in"
    folder.mkdir()
    pages = keyed_pages(spark, SF).select("page_id", "url", "html")

    def add(lo, hi):
        n = len(list(folder.iterdir()))
        pages.filter(F.col("page_id").between(lo, hi)).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        part = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        shutil.copy(part, folder / f"p{n}.parquet")

    return str(folder), add


def drain(spark, folder, progs, out, checkpoint, **kw):
    q = run_extraction(spark, page_stream(spark, folder, SCHEMA), progs, out, checkpoint, **kw)
    q.awaitTermination()
    return q


def held(spark, out):
    rows = spark.read.parquet(out).select("page_id", "field").collect()
    return sorted((r.page_id, r.field) for r in rows)


def test_repeats_restart_and_lost_checkpoint(spark, tmp_path, feed):
    folder, add = feed
    pages = keyed_pages(spark, SF)
    progs = site_programs(pages, [("title", "/html/body/article/h1")]).drop("lang")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c1")
    add(0, 9)
    add(5, 14)       # repeats five pages in the next batch
    drain(spark, folder, progs, out, ckpt)
    assert held(spark, out) == [(i, "title") for i in range(15)]
    add(0, 19)       # after a restart, with the state of the first run
    drain(spark, folder, progs, out, ckpt)
    assert held(spark, out) == [(i, "title") for i in range(20)]
    add(15, 24)      # the checkpoint is lost: the sink's keys start the new state
    drain(spark, folder, progs, out, str(tmp_path / "c2"))
    assert held(spark, out) == [(i, "title") for i in range(25)]
    drain(spark, folder, progs, out, str(tmp_path / "c2"))
    assert held(spark, out) == [(i, "title") for i in range(25)]


def test_replayed_batch_replaces_its_folder(spark, tmp_path, feed, monkeypatch):
    folder, add = feed
    progs = site_programs(keyed_pages(spark, SF), [("title", "/html/body/article/h1")]).drop("lang")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "c")
    add(0, 9)
    whole = extract.extract_batch

    def fails_after_writing(*a, **k):
        whole(*a, **k)
        raise RuntimeError("lost before the batch was committed")

    monkeypatch.setattr(extract, "extract_batch", fails_after_writing)
    with pytest.raises(Exception, match="lost before"):
        drain(spark, folder, progs, out, ckpt)
    monkeypatch.setattr(extract, "extract_batch", whole)
    add(5, 12)
    drain(spark, folder, progs, out, ckpt)
    assert held(spark, out) == [(i, "title") for i in range(13)]


def test_pages_without_a_program_are_recorded(spark, tmp_path, feed):
    folder, add = feed
    add(0, 9)
    progs = site_programs(keyed_pages(spark, SF).filter("page_id = 3"), [("title", "/html/body/article/h1")]).drop("lang")
    drain(spark, folder, progs, str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.page_id for r in rows) == list(range(10))
    assert all(r["values"] == [] for r in rows if r.field is None)
    assert any(r.field is None for r in rows) and any(r.page_id == 3 and r.field == "title" for r in rows)


def test_a_batch_does_not_read_the_sink(spark, tmp_path, feed, monkeypatch):
    folder, add = feed
    progs = site_programs(keyed_pages(spark, SF), [("title", "/html/body/article/h1")]).drop("lang")
    out, plans = str(tmp_path / "out"), []
    whole = extract.extract_batch

    def seen(batch, *a, **k):
        plans.append(batch._jdf.queryExecution().toString())
        whole(batch, *a, **k)

    monkeypatch.setattr(extract, "extract_batch", seen)
    add(0, 4)
    add(3, 9)
    drain(spark, folder, progs, out, str(tmp_path / "c"))
    assert len(plans) == 2 and not any(out in p for p in plans)


def test_batches_broadcast_no_tables_of_their_own(spark, tmp_path, feed, monkeypatch):
    """Joins inside a batch must not collect the batch's tables on the driver; the
    setting stays with the stream."""
    folder, add = feed
    progs = site_programs(keyed_pages(spark, SF), [("title", "/html/body/article/h1")]).drop("lang")
    add(0, 9)
    before, used, whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], extract.extract_batch

    def seen(df, *args, **kw):
        whole(df, *args, **kw)
        used.append(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))

    monkeypatch.setattr(extract, "extract_batch", seen)
    out = str(tmp_path / "out")
    drain(spark, folder, progs, out, str(tmp_path / "c"))
    assert used == ["-1"] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert held(spark, out) == [(i, "title") for i in range(10)]

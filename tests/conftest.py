import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagesift.session import get_spark
    s = get_spark("tests", cpus="*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_pages(spark):
    def _make(htmls, site="s.example.com"):
        rows = [(i, f"http://{site}/en/{i}", h) for i, h in enumerate(htmls)]
        from pyspark.sql import functions as F
        return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
            "site", F.lit(site))
    return _make


@pytest.fixture(scope="session")
def explode(spark, make_pages):
    from pagesift.operators.dom import explode_dom

    def _explode(htmls, site="s.example.com"):
        return explode_dom(make_pages(htmls, site), keep=["site"]).cache()
    return _explode

"""The source "web" and the pipeline over it."""

import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from spindrift.sources import web, web_source


@pytest.fixture(scope="module")
def source(spark):
    web_source.register(spark)
    return lambda **o: spark.read.format("web").options(interval=0, jitter=0, **o).load()


def test_pages_and_errors(spark, source, tmp_path):
    urls = ["http://a.org/1", "http://A.org/2", "no url", "http://[bad", "http://a.org/1", None]
    spark.createDataFrame([("http://a.org/1", "<p>1"), ("http://A.org/2", None), ("no url", "")], "url string, html string").write.parquet(str(tmp_path / "archive"))
    got = sorted((r.url, r.html, bool(r.error)) for r in source(urls=json.dumps(urls), archive=str(tmp_path / "archive")).collect())
    assert got == [("http://A.org/2", None, True), ("http://[bad", None, True), ("http://a.org/1", "<p>1", False), ("http://a.org/1", "<p>1", False), ("no url", "", False)]
    assert source(urls="[]").collect() == []


def test_a_table_of_urls_in_any_number_of_tasks(spark, source, tmp_path):
    urls = [(f"http://h{i % 13}.org/{i}", i) for i in range(400)]
    spark.createDataFrame(urls, "link string, n int").repartition(4).write.parquet(str(tmp_path / "urls"))
    for n in (1, 3, 20):
        rows = source(table=str(tmp_path / "urls"), column="link", get="html:escape", concurrency=n).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(r.url for r in rows) == sorted(u for u, _ in urls) and all(r.html == r.url for r in rows)
        of = {}
        for r in rows:
            of.setdefault(web_source.host_of(r.url), set()).add(r.task)
        assert all(len(t) == 1 for t in of.values())  # a host is one task's
    assert all(r.error for r in source(table=str(tmp_path / "urls"), column="link", get="json:loads").collect())


def test_filters_on_url_come_before_fetching(source):
    reader = web_source.WebReader({"urls": json.dumps(["a", "b", "c"]), "get": "html:escape", "interval": "0", "jitter": "0"})
    left = list(reader.pushFilters([In(("url",), ("a", "b")), EqualTo(("url",), "a"), GreaterThan(("url",), "0")]))
    assert left == [GreaterThan(("url",), "0")] and reader.only == {"a"}
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[{"url": "a", "html": "a", "error": None}]]
    assert [r.url for r in source(urls='["x", "y"]', get="html:escape").where("url = 'y'").collect()] == ["y"]


def test_each_host_keeps_its_pace(monkeypatch):
    asked = []
    monkeypatch.setattr(web, "get_page", lambda url: asked.append((web_source.host_of(url), time.monotonic())) or "x")
    urls = [f"http://h{i % 4}.org/{i}" for i in range(16)]
    reader = web_source.WebReader({"urls": json.dumps(urls), "concurrency": "1", "interval": "0.05", "jitter": "0"})
    began = time.monotonic()
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 16
    assert time.monotonic() - began < 16 * 0.05  # hosts wait at the same time
    for host in {h for h, _ in asked}:
        at = [t for h, t in asked if h == host]
        assert all(b - a >= 0.049 for a, b in zip(at, at[1:], strict=False))


def test_options():
    for o in ({}, {"urls": "[]", "table": "x"}):
        with pytest.raises(ValueError):
            web_source.WebReader(o)


def test_pipeline_of_other_parts(spark, source):
    """Search, extractor and chunker are the caller's; pages that fail are left out."""
    found = [("t1", "http://a.org/apple pear"), ("t2", "http://b.org/pear pear plum"), ("t3", None)]
    pipeline = web.Pipeline(
        search=lambda q, n: spark.createDataFrame(found[:n], "title string, url string"), fetch=lambda urls: source(urls=json.dumps([r.url for r in urls.collect()]), get="html:escape"),
        limit=3, extract=lambda html: F.regexp_replace(html, "^.*org/", ""), chunk=lambda t: F.split(t, " "), least=4,
    )
    rows = pipeline.run("plum").orderBy("rank").collect()
    assert rows[0].text == "plum" and {r.text for r in rows} <= {"apple", "pear", "plum"} and len(rows) == 3
    assert pipeline.pages("x").count() == 2
    with pytest.raises(ValueError):
        web.Pipeline(search=pipeline.search, fetch=pipeline.fetch, limit=0).run("x")


def test_every_page_of_an_archive_that_has_several_of_a_url(spark, source, tmp_path):
    """A table of pages that is its own archive gives each of its rows, those without html too."""
    rows = [("http://a.org/1", "x"), ("http://a.org/1", "y"), ("http://b.org/1", None), ("http://c.org/1", "z"), ("http://a.org/1", "x")]
    at = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "url string, html string").repartition(3).write.parquet(at)
    key = lambda r: (r[0], r[1] or "")
    got = source(table=at, archive=at, nulls="keep").collect()
    assert sorted(((r.url, r.html) for r in got), key=key) == sorted(rows, key=key) and not any(r.error for r in got)
    again = source(urls=json.dumps(["http://c.org/1"] * 3 + ["http://a.org/1"] * 7 + ["http://b.org/1"]), archive=at).collect()
    counts = [sum(r.html == h for r in again) for h in ("x", "y", "z", None)]
    assert counts in ([5, 2, 3, 1], [4, 3, 3, 1]) and [r.url for r in again if r.error] == ["http://b.org/1"]
    with pytest.raises(ValueError):
        web_source.WebReader({"urls": "[]", "nulls": "x"})


def test_an_archive_is_read_once_however_many_urls(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "pages.parquet")
    urls = [f"http://h{i}.org/" for i in range(3_000)]
    spark.createDataFrame([(u, u) for u in urls], "url string, html string").write.parquet(at)
    reader = web_source.WebReader({"table": at, "archive": at, "concurrency": "1"})
    opened = []
    dataset = web_source.ds.dataset
    monkeypatch.setattr(web_source.ds, "dataset", lambda *a: (opened.append(1), dataset(*a))[1])
    assert sorted(u for b in reader.read(reader.partitions()[0]) for u in b.column(1).to_pylist()) == sorted(urls)
    assert len(opened) == 2  # the urls, and their pages

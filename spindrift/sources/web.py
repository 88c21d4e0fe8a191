"""Web search results and pages. Search and fetch are functions that the caller gives; without a
network the pages of a table take their place."""

from __future__ import annotations

import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.chunking import WEB_CAP, WEB_MIN, web_chunks
from spindrift.functions.html import html_text
from spindrift.functions.text import clean_url
from spindrift.operators.bm25 import select_top
from spindrift.session import ship

#: Tasks that fetch at once, and seconds from one page of a task to the next, the second of them at random.
CONCURRENCY, INTERVAL, JITTER = 5, 0.5, 0.3
#: Where a search is asked for, and the class of its results' links.
SEARCH, LINK = "https://html.duckduckgo.com/html/?q=", "result__a"


def get_page(url: str, timeout: float = 10) -> str:
    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class _Links(HTMLParser):
    """(title, href) of the links of class LINK."""

    def __init__(self):
        super().__init__()
        self.found, self.href, self.title = [], None, []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "a" and LINK in (named.get("class") or "").split():
            self.href, self.title = named.get("href") or "", []

    def handle_data(self, data):
        self.title.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.found.append(("".join(self.title).strip(), self.href))
            self.href = None


def search_web(spark: SparkSession, query: str, limit: int, get: Callable[[str], str] = get_page) -> DataFrame:
    """(title, url) of the first results of a web search, limit at most."""
    links = _Links()
    links.feed(get(SEARCH + quote_plus(query)))
    return results(spark.createDataFrame(links.found, "title string, url string"), limit)


def web_pages(spark: SparkSession, query: str, limit: int, get: Callable[[str], str] = get_page, interval: float = INTERVAL, jitter: float = JITTER) -> DataFrame:
    """(page_id, url, html) of the pages that a web search finds; those that can't be fetched are left out."""
    got = fetch(search_web(spark, query, limit, get), get, interval, jitter).where("error is null")
    return got.select(F.row_number().over(Window.orderBy("url")).cast("long").alias("page_id"), "url", "html")  # limit rows


def fetch(urls: DataFrame, get: Callable[[str], str], interval: float = INTERVAL, jitter: float = JITTER) -> DataFrame:
    """(url, html, error) of every url: at most CONCURRENCY tasks, all urls of a host in one, each with its own pace; a url
    that fails has an error and no html. For functions that aren't in a module; others go through the source "web"."""
    ship(urls.sparkSession)
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                try:
                    out.append((u, get(u), None))
                except Exception as e:  # noqa: BLE001  reported in the row
                    out.append((u, None, str(e) or type(e).__name__))
                time.sleep(interval + random.uniform(0, jitter))
            yield pd.DataFrame(out, columns=["url", "html", "error"])

    return urls.select("url").repartition(CONCURRENCY, host).mapInPandas(run, "url string, html string, error string")


def results(rows: DataFrame, limit: int) -> DataFrame:
    """(title, url) of a search page's links: cleaned, without empty ones, limit at most."""
    return rows.where("url <> ''").select("title", clean_url(F.col("url")).alias("url")).limit(limit)


def page_chunks(pages: DataFrame, cap: int = WEB_CAP, least: int = WEB_MIN, extract: Callable[[Column], Column] = html_text, chunk: Callable[[Column], Column] | None = None) -> DataFrame:
    """(page_id, j, url, text) of the paragraphs' chunks of at least `least` bytes. extract makes a page's text, chunk an array of
    its parts (paragraphs up to `cap` bytes, if left out)."""
    ship(pages.sparkSession)
    t = pages.select("page_id", "url", extract(F.col("html")).alias("t"))
    c = t.select("page_id", "url", F.posexplode(chunk(F.col("t")) if chunk else web_chunks(F.col("t"), cap)).alias("j", "text"))
    return c.where(F.octet_length("text") >= least).select("page_id", "j", "url", "text")


@dataclass(frozen=True)
class Pipeline:
    """Search, fetch, extract, chunk and choose, each of which can be another.

    search(query, limit) gives (title, url); fetch(urls) gives (url, html, error); extract and chunk are column expressions: a
    page's text, and the array of its parts.
    """

    search: Callable[[str, int], DataFrame]
    fetch: Callable[[DataFrame], DataFrame]
    limit: int = 5
    extract: Callable[[Column], Column] = html_text
    chunk: Callable[[Column], Column] | None = None
    least: int = WEB_MIN

    def pages(self, query: str) -> DataFrame:
        """(page_id, url, html) of what a search finds; pages that can't be fetched are left out."""
        got = self.fetch(self.search(query, self.limit).select("url")).where("error is null")
        return got.select(F.row_number().over(Window.orderBy("url")).cast("long").alias("page_id"), "url", "html")  # limit rows

    def run(self, query: str) -> DataFrame:
        """The limit parts that suit the query best: chunk_id, text, score, rank."""
        if self.limit < 1:
            raise ValueError("limit must be positive")
        pages = self.pages(query).persist()  # each page is asked for once
        try:
            return select_top(keyed_chunks(pages, extract=self.extract, chunk=self.chunk, least=self.least), query, self.limit, "chunk_id")
        finally:
            pages.unpersist()


def keyed_chunks(pages: DataFrame, **how) -> DataFrame:
    """(chunk_id, text) of the pages' chunks; how: as for page_chunks()."""
    parts = (F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lpad(F.col("j").cast("string"), 6, "0"))
    return page_chunks(pages, **how).select(F.concat_ws(":", *parts).alias("chunk_id"), "text")


def answer_context(pages: DataFrame, query: str, most: int) -> DataFrame:
    """The most chunks of a few fetched pages that suit the query best, for variety's sake not too alike."""
    return select_top(keyed_chunks(pages), query, most, "chunk_id")

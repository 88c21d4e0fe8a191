"""Web pages as a Spark data source: spark.read.format("web").

Options:

- `urls`: a JSON list of urls, such as a search's results; or `table` (and `column`, "url"): the folder or file of
  a Parquet table of urls, of any size.
- `get`: "module:function" that gives the page of a url (web.get_page, if left out); or `archive`: a Parquet table (url, html)
  of pages fetched before, which takes the place of the network. No host is asked then, so none has a pace. The k-th fetch of a
  url gives the k-th page that the archive has of it, and begins anew after the last. `nulls` ("error"): with "keep", a row
  without html is a page too, of neither html nor error.
- `concurrency` (5): tasks that fetch at once. `interval` and `jitter`: seconds between two pages of one host.

Rows are url, html, error: a url that can't be fetched has an error and no html; one that the table has twice is fetched
twice. Null urls are passed over. All urls of a host are one task's, which keeps the pace of each of its hosts and goes on
with another host meanwhile; no list of urls is made on the driver. A filter on url is applied before anything is fetched.
"""

from __future__ import annotations

import importlib
import json
import random
import time
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from spindrift.session import ship
from spindrift.sources import web

SCHEMA = "url string, html string, error string"
#: Urls that a task looks at together: it can go on with another host while one has to wait.
WINDOW = 1_000
#: Urls that a task looks for in one reading of an archive, and rows that it reads at once.
SOUGHT, ROWS = 1 << 20, 256
NO_PAGE = "the archive has no such page"


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


class Share(InputPartition):
    """The hosts whose hash is number, of so many."""

    def __init__(self, number: int, of: int):
        self.number, self.of = number, of

    def has(self, url: str) -> bool:
        return zlib.crc32(host_of(url).encode()) % self.of == self.number


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        return WebReader(dict(self.options))


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        # Spark hands options on in lower case
        self.urls, self.table, self.column = options.get("urls"), options.get("table"), options.get("column", "url")
        if (self.urls is None) == (self.table is None):
            raise ValueError("the option urls or the option table must be given")
        self.get, self.archive, self.nulls = options.get("get"), options.get("archive"), options.get("nulls", "error")
        if self.nulls not in ("error", "keep"):
            raise ValueError("nulls must be error or keep")
        self.concurrency = int(options.get("concurrency", web.CONCURRENCY))
        self.interval, self.jitter = (float(options.get(k, d)) for k, d in (("interval", web.INTERVAL), ("jitter", web.JITTER)))
        self.only: set[str] | None = None
        self.until: dict[str, float] = {}  # when a host may be asked again

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("url",):
                yield f
            else:
                self.only = wanted if self.only is None else self.only & wanted

    def partitions(self) -> list[InputPartition]:
        return [Share(k, self.concurrency) for k in range(self.concurrency)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for urls in self._windows(partition, WINDOW if self.archive is None else SOUGHT):
            for rows in self._paced(urls) if self.archive is None else self._stored(urls):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["url", "html", "error"])

    def _windows(self, share: Share, size: int) -> Iterator[list[str]]:
        """The share's urls, size at a time."""
        held = []
        for batch in [json.loads(self.urls)] if self.urls is not None else (b.column(0).to_pylist() for b in ds.dataset(self.table).to_batches(columns=[self.column])):
            for url in batch:
                if url is not None and share.has(url) and (self.only is None or url in self.only):
                    held.append(url)
                    if len(held) >= size:
                        yield held
                        held = []
        if held:
            yield held

    def _paced(self, urls: list[str]) -> Iterator[list[tuple[str, str | None, str | None]]]:
        """Rows of some urls: of the hosts that may be asked, the one that has waited longest comes next."""
        get = self._getter()
        waiting: dict[str, deque] = {}
        for u in urls:
            waiting.setdefault(host_of(u), deque()).append(u)
        free = {h: self.until.get(h, 0.0) for h in waiting}
        rows = []
        while waiting:
            host = min(waiting, key=free.__getitem__)
            if (rest := free[host] - time.monotonic()) > 0:
                if rows:
                    yield rows
                    rows = []
                time.sleep(rest)
            url = waiting[host].popleft()
            if not waiting[host]:
                del waiting[host]
            try:
                rows.append((url, get(url), None))
            except Exception as e:  # noqa: BLE001  reported in the row
                rows.append((url, None, str(e) or type(e).__name__))
            free[host] = self.until[host] = time.monotonic() + self.interval + random.uniform(0, self.jitter)
            if len(rows) >= 100:
                yield rows
                rows = []
        if rows:
            yield rows

    def _getter(self) -> Callable[[str], str]:
        if self.get is None:
            return web.get_page
        module, _, name = self.get.partition(":")
        return getattr(importlib.import_module(module), name)

    def _stored(self, urls: list[str]) -> Iterator[list[tuple[str, str | None, str | None]]]:
        """Rows of some urls from the archive, in its order. One reading of it serves, unless it has fewer pages of a url than
        are asked for; a second one then gives its pages again."""
        times, seen = Counter(urls), Counter()
        for rows in self._pages(times):
            out = []
            for url, html in rows:
                if seen[url] < times[url]:
                    out.append((url, html, None))
                seen[url] += 1
            if out:
                yield out
        none = [u for u in times if not seen[u]]
        for i in range(0, len(none), ROWS):
            yield [(u, None, NO_PAGE) for u in none[i : i + ROWS] for _ in range(times[u])]
        short = {u: n for u, n in times.items() if 0 < seen[u] < n}
        if not short:
            return
        at = Counter()
        for rows in self._pages(short):
            for url, html in rows:
                for _ in range((short[url] - 1 - at[url]) // seen[url]):
                    yield [(url, html, None)]
                at[url] += 1

    def _pages(self, wanted: dict[str, int]) -> Iterator[list[tuple[str, str | None]]]:
        """(url, html) of the archive's pages of some urls, ROWS rows of it at a time."""
        found = ds.dataset(self.archive)
        for name in found.files:
            with found.filesystem.open_input_file(name) as f:
                for b in pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20).iter_batches(ROWS, columns=["url", "html"], use_threads=False):
                    urls, html = b.column(0).to_pylist(), b.column(1)
                    at = [i for i, u in enumerate(urls) if u in wanted and (self.nulls == "keep" or html[i].is_valid)]
                    if at:
                        yield list(zip((urls[i] for i in at), html.take(pa.array(at)).to_pylist(), strict=True))


def register(spark: SparkSession) -> None:
    """Make format("web") known to the session. Filters on url reach the source."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSource)

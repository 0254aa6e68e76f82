"""Paged JSON services as a Spark data source: a partition a page, retries within it, filters in the request.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").schema("id string, hits array<string>").option("url", ...).option("total", 1200).load()

Pages are read by the executors from `url` with the page's size and offset put in, by POST where there is a `body`, which
takes both too. Rows come from the list at `rows` (a dotted path) and each field of the schema is the value of that name,
nested values as JSON text. How many rows there are is told by `total`, or found at `totalAt` in the answer for the first
page while the job is planned; where that grows meanwhile the last partition reads on, and without either one partition
reads until a page is short. `limit` asks for the first rows only. A page of more rows than asked for is an error. So is
a service that fails, after the retries; with onError=empty it gives a line in the log and, where the schema has a field
`_error`, a row with it: what wasn't read is never a count of 0.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def equals(**fields: str | list[str]) -> dict:
    """A filter tree: all fields have one of their values."""
    leaf = lambda k, v: {"op": "in", "content": {"field": k, "value": v if isinstance(v, list) else [v]}}
    return {"op": "and", "content": [leaf(k, v) for k, v in fields.items()]}


def fetch(url: str, timeout: float = 20, attempts: int = 3, pause: float = 1.0, body: str | None = None) -> object:
    """JSON of a URL, by POST where there is a body; waits pause, then twice that, between attempts."""
    for attempt in range(1, attempts + 1):
        try:
            ask = urllib.request.Request(url, body.encode() if body is not None else None, {"Content-Type": "application/json"} if body is not None else {})  # noqa: S310
            with urllib.request.urlopen(ask, timeout=timeout) as answer:  # noqa: S310
                return json.loads(answer.read())
        except OSError:
            if attempt == attempts:
                raise
            time.sleep(pause * attempt)
    raise AssertionError


def at_path(document: object, path: str) -> object:
    for key in [k for k in path.split(".") if k]:
        document = document.get(key) if isinstance(document, dict) else None
    return document


class Page(InputPartition):
    """A page; the last of a plan reads on where the service has more."""

    def __init__(self, offset: int, size: int, last: bool):
        super().__init__((offset, size))
        self.offset, self.size, self.last = offset, size, last


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]):
        self.names, self.options = [f.name for f in schema.fields], {k.lower(): v for k, v in dict(options).items()}
        self.size = int(self.options.get("size", "100"))
        if not 1 <= self.size <= 5000:
            raise ValueError("a page has 1 to 5000 rows")

    def page(self, offset: int, size: int) -> object:
        o, put = self.options, lambda text: text.replace("{offset}", str(offset)).replace("{size}", str(size))
        return fetch(put(o["url"]), float(o.get("timeout", "20")), int(o.get("attempts", "3")), float(o.get("pause", "1")), put(o["body"]) if "body" in o else None)

    def total(self, document: object) -> int | None:
        """What an answer says at totalAt; None without that option."""
        if "totalat" not in self.options:
            return None
        value = at_path(document, self.options["totalat"])
        if value is None:
            raise ValueError(f"no total at {self.options['totalat']}")
        return int(value)

    def partitions(self) -> list[Page]:
        """A partition a page of the total, which is told or taken from the answer for the first page. Without either one
        partition reads page after page."""
        total = int(self.options["total"]) if "total" in self.options else self.total(self.page(0, self.size)) if "totalat" in self.options else 0
        limit = int(self.options["limit"]) if "limit" in self.options else None
        if limit is not None:
            total = min(total, limit)
        starts = list(range(0, total, self.size)) or [0]
        return [Page(at, self.size, at == starts[-1]) for at in starts]

    def rows(self, page: Page) -> Iterator[object]:
        at, limit = page.offset, int(self.options.get("limit", 1 << 62))
        told = int(self.options["total"]) if "total" in self.options else None
        while at < limit:
            size = min(page.size, limit - at, told - at if told is not None else page.size)
            if size <= 0:
                return
            document = self.page(at, size)
            found = at_path(document, self.options.get("rows", ""))
            found = found if isinstance(found, list) else [] if found is None else [found]
            if len(found) > size:
                raise ValueError(f"a page of {size} rows at {at} has {len(found)}")
            yield from found
            at += size
            total = told if told is not None else self.total(document)
            if not page.last or (at >= total if total is not None else len(found) < size):
                return

    def read(self, page: Page) -> Iterator[tuple]:
        values = lambda row: [at_path(row, n.replace("__", ".")) for n in self.names]
        try:
            made = [tuple(json.dumps(v, sort_keys=True) if isinstance(v, dict | list) else None if v is None else str(v) for v in values(row)) for row in self.rows(page)]
        except OSError as e:
            if self.options.get("onerror") != "empty":
                raise
            print(f"page at {page.offset} was not read: {e}", file=sys.stderr)
            made = [tuple(str(e) if n == "_error" else None for n in self.names)] if "_error" in self.names else []
        yield from made


class PagedJson(DataSource):
    """All fields of the schema are strings; nested JSON is cast with from_json."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)

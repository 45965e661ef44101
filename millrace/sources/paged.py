"""A paged REST source: one partition per page of rows, read on the executors.

``format("paged_rest")`` with options ``url`` (with {offset} and {length}), ``total`` or ``total_url``, ``page`` (rows a
page), ``rows_key`` and ``schema``. Any URL that urllib can open will do, file URLs included.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def fetch(url: str, tries: int = 4, wait: float = 0.5) -> dict:
    """JSON of a URL, tried again with growing pauses."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as r:
                return json.loads(r.read().decode("utf-8"))
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise RuntimeError(url)


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema):
        return _Reader(schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.options = [f.name for f in schema.fields], dict(options)

    def partitions(self):
        o = self.options
        total = int(o["total"]) if "total" in o else int(fetch(o["total_url"])[o.get("total_key", "num_rows_total")])
        page = int(o.get("page", 100))
        return [Page(k, min(page, total - k)) for k in range(0, total, page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        body = fetch(self.options["url"].format(offset=partition.offset, length=partition.length))
        for r in body[self.options.get("rows_key", "rows")]:
            row = r.get("row", r)
            yield tuple(row.get(n) for n in self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRest)

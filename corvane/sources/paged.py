"""A paged search service as a Spark data source: each query is a partition that follows cursors page by page.

Pages come from a `fetch(query, cursor, size) -> (rows, next_cursor)` callable named by a dotted path, so that the source
works with any client; `corvane.sources.paged:json_pages` reads pages from a JSON file and serves tests.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Quota(Exception):
    """The service will not answer any more; retrying is of no use."""


def json_pages(query: str, cursor: str | None, size: int, options: dict) -> tuple[list[dict], str | None]:
    """Pages of {query: [{doc_id, score}, ...]}, given as JSON text (`rows`) or in a file that every executor can open."""
    if "rows" in options:
        rows = json.loads(options["rows"]).get(query, [])
    else:
        with open(options["file"]) as f:
            rows = json.load(f).get(query, [])
    at = int(cursor or 0)
    return rows[at : at + size], str(at + size) if at + size < len(rows) else None


def with_retries(call, attempts: int = 3, wait: float = 0.1):
    """The call's result; a failure is tried again with growing waits, a spent quota is not."""
    for k in range(attempts):
        try:
            return call()
        except Quota:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in json.loads(self.options["queries"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, name = self.options["fetch"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        size, most, pages = (int(self.options.get(k, v)) for k, v in (("size", 500), ("target", 1000), ("pages", 100)))
        seen: set[int] = set()
        cursor: str | None = None
        for page in range(pages):
            rows, cursor = with_retries(lambda at=cursor: fetch(partition.value, at, size, self.options))
            for pos, row in enumerate(rows):
                if row["doc_id"] not in seen and len(seen) < most:
                    seen.add(row["doc_id"])
                    yield partition.value, int(row["doc_id"]), float(row["score"]), len(seen), page * size + pos
            if cursor is None or len(seen) >= most:
                return


class PagedSearch(DataSource):
    """spark.dataSource.register(PagedSearch); spark.read.format("paged_search").options(queries=json, fetch=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "query string, doc_id long, score double, rank int, position int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

"""A batch data source that answers planned queries from a local folder of pages.

It stands where a search service would be read: one partition per planned query, bounded
attempts, and a cache folder that is looked up before anything is fetched. Without a
network the pages come from JSON files named by the hash of the request.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers after which a request is tried again.
RETRY = frozenset((429, 500, 502, 503, 504))
SCHEMA = "query string, rank int, id string, title string"


def request_key(query: str, size: int) -> str:
    return hashlib.sha256(json.dumps({"q": query, "n": size}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def wait_before(attempt: int, retry_after: str | None, base: float = 0.5, jitter: float = 0.25) -> float:
    """Seconds before the next attempt: what the answer asks for, else doubling and a random part."""
    if retry_after and retry_after.isdigit():
        return float(retry_after)
    return base * 2**attempt + random.uniform(0, jitter)


def sanitized(query: str) -> str:
    """The query's letters and digits only."""
    return " ".join("".join(c if c.isalnum() else " " for c in query).split())


class _Query(InputPartition):
    def __init__(self, text: str):
        self.text = text


class LocalSearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.queries = json.loads(options.get("queries", "[]"))
        self.size = int(options.get("size", "50"))
        if not 1 <= self.size <= 100:
            raise ValueError("size must be 1 to 100")
        self.attempts = int(options.get("attempts", "3"))
        self.base = float(options.get("base", "0.5"))
        self.since, self.until = options.get("since", ""), options.get("until", "9999")

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def page(self, query: str) -> dict:
        path = os.path.join(self.folder, request_key(query, self.size) + ".json")
        try:
            with open(path, encoding="utf-8-sig") as f:
                return json.load(f)
        except FileNotFoundError as problem:
            raise FileNotFoundError(f"no cached page for {query!r}: {path}") from problem
        except ValueError as problem:
            raise ValueError(f"broken page for {query!r}: {path}") from problem

    def fetch(self, query: str) -> dict:
        """A query's page: tried again while the answer asks for that, and once with its letters only if it is refused."""
        asked = query
        for attempt in range(self.attempts):
            page = self.page(asked)
            status = page.get("status", 200)
            if status == 400 and asked == query and sanitized(query) != query:
                asked = sanitized(query)
            elif status not in RETRY:
                break
            elif attempt + 1 < self.attempts:
                time.sleep(wait_before(attempt, page.get("retry_after"), self.base))
        if page.get("status", 200) >= 400:
            raise RuntimeError(f"{query!r} is answered with status {page['status']}")
        return page

    def read(self, partition: _Query) -> Iterator[tuple]:
        if partition is None:
            return
        results = [r for r in self.fetch(partition.text).get("results", []) if self.since <= (r.get("publication_date") or self.since) <= self.until]
        for i, r in enumerate(results[: self.size]):
            yield partition.text, i + 1, r.get("id"), r.get("title") or r.get("display_name")


class LocalSearch(DataSource):
    """``spark.dataSource.register(LocalSearch)``, then format ``local_search`` with path, queries (JSON list) and size."""

    @classmethod
    def name(cls) -> str:
        return "local_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LocalSearchReader(self.options)

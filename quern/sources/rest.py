"""A paged REST collection as a Spark data source: one input partition a page."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedRest(DataSource):
    """``spark.read.format("paged_rest")`` with url, and filter, sort, expand, fields and perPage as the server takes them."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def _get(self, page: int) -> dict:
        own = {k: v for k, v in self.options.items() if k in ("filter", "sort", "expand", "fields")}
        size = self.options.get("perpage") or self.options.get("perPage") or 200
        query = urllib.parse.urlencode(own | {"page": page, "perPage": size})
        for wait in (1, 4, None):  # a page that fails is asked for again before the task is
            try:
                with urllib.request.urlopen(f"{self.options['url']}?{query}", timeout=120) as r:
                    return json.load(r)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if wait is None or isinstance(e, urllib.error.HTTPError) and e.code < 500:
                    raise
                time.sleep(wait)
        raise AssertionError("unreachable")

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(1, int(self._get(1).get("totalPages", 1)) + 1)]

    def read(self, partition: Page) -> Iterator[tuple[str]]:
        for item in self._get(partition.number)["items"]:
            yield (json.dumps(item, ensure_ascii=False),)

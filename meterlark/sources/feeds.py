"""Paged feeds as a Spark data source: one task a feed, its pages read inside the task.

SRC17, SRC25 to SRC27.  A feed is a resource's window of time.  It begins at ``<path>/resource=<name>/window=<name>/<first>`` and
goes on at the page that each page's ``NextPageLink`` names, an address below ``path`` or relative to the feed, until a page names none.  Pages are JSON
documents {Items: [...], NextPageLink}.  A feed that goes on past ``max_pages`` or ``max_items``, that names a page it has had, or an
address outside ``path`` is an error, never cut short; so is a page that isn't there.

    spark.dataSource.register(PagedFeeds)
    rows = spark.read.format("paged_feeds").option("path", "s3://bucket/feeds").load()

Rows are (resource, window, page, position, item), the item as JSON text, pages and positions from 1.  Feeds that
filters on resource or window leave out aren't read.  ``fetch`` names another function (module:name) that gives a page's text for an address; it
is imported in the tasks.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "resource string, window string, page int, position int, item string"


def stored_page(address: str) -> str:
    """A page's text from any store that Arrow reads; of a folder, that of its one file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(address)
    info = store.get_file_info(path)
    if info.type == fs.FileType.Directory:
        files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        if len(files) != 1:
            raise ValueError(f"a page's folder holds {len(files)} files: {address}")
        path = files[0].path
    with store.open_input_stream(path) as file:
        return file.read().decode()


def stored_feeds(path: str) -> list[tuple[str, str]]:
    """The (resource, window) folders below a path."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)

    def named(folder: str, kind: str) -> list[tuple[str, str]]:
        return sorted((f.base_name.removeprefix(f"{kind}="), f.path) for f in store.get_file_info(fs.FileSelector(folder)) if not f.is_file and f.base_name.startswith(f"{kind}="))

    return [(resource, window) for resource, at in named(root, "resource") for window, _ in named(at, "window")]


@dataclass
class Feed(InputPartition):
    resource: str
    window: str


class PagedFeeds(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "paged_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return FeedReader(self.options)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        if "://" not in self.root:
            self.root = self.root.replace("file:", "", 1) if self.root.startswith("file:") else self.root
            self.root = f"file://{self.root}"
        self.first = options.get("first", "page=1")
        self.max_pages, self.max_items = int(options.get("max_pages", 40)), int(options.get("max_items", 40_000))
        self.fetch = options.get("fetch", f"{__name__}:stored_page")
        self.feeds = [tuple(x) for x in json.loads(options["feeds"])] if "feeds" in options else None
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: Sequence[Any]) -> Iterator[Any]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else ""
            if column in ("resource", "window"):
                self.wanted[column] = self.wanted.get(column, set(values)) & set(values)
            else:
                yield f

    def partitions(self) -> Sequence[Feed]:
        found = self.feeds if self.feeds is not None else stored_feeds(self.root)
        keep = lambda column, value: column not in self.wanted or value in self.wanted[column]
        return [Feed(r, w) for r, w in found if keep("resource", r) and keep("window", w)]

    def read(self, partition: Feed) -> Iterator[tuple]:
        module, function = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), function)
        feed = f"{self.root}/resource={partition.resource}/window={partition.window}"
        at, page, items, had = f"{feed}/{self.first}", 0, 0, set()
        while at:
            if not at.startswith(self.root + "/") or "/../" in at:
                raise ValueError(f"a page's address isn't below the feeds: {at}")
            if page >= self.max_pages:
                raise ValueError(f"the feed has more than {self.max_pages} pages: {feed}")
            if at in had:
                raise ValueError(f"the feed names a page again: {at}")
            had.add(at)
            document = json.loads(fetch(at))
            page += 1
            rows = document.get("Items") or []
            items += len(rows)
            if items > self.max_items:
                raise ValueError(f"the feed has more than {self.max_items} items: {feed}")
            for position, item in enumerate(rows, 1):
                yield partition.resource, partition.window, page, position, json.dumps(item, ensure_ascii=False)
            link = document.get("NextPageLink")
            at = link if not link or "://" in link else f"{feed}/{link}"


def read_feeds(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The items of all feeds below a path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFeeds)
    return spark.read.format("paged_feeds").options(path=path, **{k: str(v) for k, v in options.items()}).load()

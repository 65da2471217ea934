"""Paged listings as a data source: pages are fetched in ranges side by side, each until its first empty page.

`Pages` leaves open where a page comes from; `StagedPages` reads pages that a job has staged as JSON-lines files.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "page int, pos int, item string"


class PageRange(InputPartition):
    """Pages from `first` up to but without `end`; `end` None: as many as there are."""

    def __init__(self, first: int, end: int | None):
        super().__init__((first, end))
        self.first, self.end = first, end


class PageReader(DataSourceReader):
    """Reads ranges of pages. A page that fails is fetched again, after a pause that doubles, and after `retries` times fails the task.

    An empty page gives one row without an item, as the mark where the listing ends. Options: `tasks`, `pages_per_task`,
    `most_pages`, `retries`, `pause` in seconds. The last range goes on until its first empty page.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tasks, self.width = int(options.get("tasks", "8")), int(options.get("pages_per_task", "16"))
        self.retries, self.pause = int(options.get("retries", "5")), float(options.get("pause", "1"))
        self.most = int(options["most_pages"]) if "most_pages" in options else None

    def fetch(self, page: int) -> list[str]:
        """The items of a page, as texts; an exception where it can't be had now."""
        raise NotImplementedError

    def partitions(self) -> list[PageRange]:
        starts = [1 + i * self.width for i in range(self.tasks)]
        last = None if self.most is None else self.most + 1
        ranges = [PageRange(a, a + self.width) for a in starts[:-1]] + [PageRange(starts[-1], None)]
        cut = lambda end: last if end is None else end if last is None else min(end, last)
        return [PageRange(r.first, cut(r.end)) for r in ranges if last is None or r.first < last]

    def read(self, partition: PageRange) -> Iterator[tuple[int, int | None, str | None]]:
        page = partition.first
        while partition.end is None or page < partition.end:
            items = self._fetched(page)
            if not items:
                yield page, None, None
                return
            for pos, item in enumerate(items):
                yield page, pos, item
            page += 1

    def _fetched(self, page: int) -> list[str]:
        wait = self.pause
        for attempt in range(self.retries + 1):
            try:
                return self.fetch(page)
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(wait)
                wait *= 2
        return []


class StagedReader(PageReader):
    """Pages staged as folders `page=<n>` of text files with one item a line, in a store that pyarrow opens; a page without a folder is empty.

    A file busy.json in a folder says why its page can't be had now.
    """

    def fetch(self, page: int) -> list[str]:
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.options["path"]))
        held = files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
        if busy := [f for f in held if f.base_name == "busy.json"]:
            with files.open_input_stream(busy[0].path) as f:
                raise ConnectionError(json.loads(f.read()).get("reason", "busy"))
        out: list[str] = []
        for info in sorted(held, key=lambda f: f.path):
            if info.base_name.startswith("part-"):
                with files.open_input_stream(info.path) as f:
                    out += f.read().decode().splitlines()
        return out


class StagedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "staged_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StagedReader(self.options)


def listing(spark: SparkSession, source: type[DataSource], **options: str | int | float) -> DataFrame:
    """page, pos, item of a paged listing up to its first empty page.

    Ranges are read side by side, so those behind the first empty page may have been read in vain; they are left out by
    the smallest page that was marked empty, which is one row.
    """
    spark.dataSource.register(source)
    rows = spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load()
    stop = rows.where("item is null").agg(F.min("page").alias("_stop"))
    return rows.where("item is not null").crossJoin(F.broadcast(stop)).where("_stop is null or page < _stop").drop("_stop")

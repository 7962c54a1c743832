"""`spark.read.format("ebook")`: events of books under a path, as a Python data source.

The source lists and opens files itself, so its path must be one that every machine mounts. For
object stores and HDFS use `read_books`, which reads through Spark's own file systems.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import astuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagecrest.sources.books import EVENTS, FULL, METADATA, book_events
from pagecrest.sources.events import Event


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class EbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("pathglobfilter") or options.get("pathGlobFilter") or "*"
        self.parsers = METADATA if str(options.get("metadataonly", options.get("metadataOnly", ""))).lower() == "true" else FULL
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", 64)))

    def partitions(self) -> list[Files]:
        if os.path.isfile(self.path):
            found = [self.path]
        else:
            found = sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if fnmatch.fnmatch(f, self.glob))
        return [Files(found[i : i + self.per_task]) for i in range(0, len(found), self.per_task)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                kind, events = book_events(path, f.read(), self.parsers)
            for e in events or [Event("none")]:
                yield (path, kind, *astuple(e))


class EbookDataSource(DataSource):
    """Options: path, pathGlobFilter, metadataOnly, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "ebook"

    def schema(self) -> str:
        return EVENTS

    def reader(self, schema) -> EbookReader:
        return EbookReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EbookDataSource)

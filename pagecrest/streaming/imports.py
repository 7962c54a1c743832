"""A folder of books as a stream: each new file is parsed once, and its rows are added to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagecrest.sources.books import Books, parse_events

TABLES = ("books", "chapters", "blocks", "images")


def stream_events(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """Events of files as they arrive under path. Parsing keeps no state, so there is nothing to expire."""
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return parse_events(files)


def import_folder(spark: SparkSession, path: str, out: str, checkpoint: str, fallback_language: str, glob: str | None = None) -> StreamingQuery:
    """Adds the tables of new books to Parquet folders under out, until all files there are done.

    A batch overwrites its own folder, so one that runs again after a failure leaves no rows twice."""

    def add(batch: DataFrame, number: int) -> None:
        books = Books(batch, fallback_language).persist()
        for name in TABLES:
            getattr(books, name)().write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        books.events.unpersist()

    events = stream_events(spark, path, glob)
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

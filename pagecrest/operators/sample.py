"""A sample of each book's body text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecrest.functions.text import u16


def body_sample(blocks: DataFrame, *order: str, key: str = "book_id", max_chars: int = 4000) -> DataFrame:
    """(key, sample): paragraphs in order, each with a line feed, up to and including the one that
    reaches max_chars UTF-16 units; the empty string for books without paragraphs."""
    size = F.when(F.col("kind") == "p", u16(F.col("text")) + 1).otherwise(0)
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("_before", F.coalesce(F.sum(size).over(running), F.lit(0)))
    taken = F.when((F.col("kind") == "p") & (F.col("_before") < max_chars), F.struct(*order, F.concat("text", F.lit("\n")).alias("line")))
    parts = F.transform(F.array_sort(F.collect_list(taken)), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(parts, "").alias("sample"))

"""Chapters out of a reading order and a table of contents, as joins and windows.

Inputs, all keyed by book_id:
  spine    pos, path, has_bytes, n_blocks    documents in reading order
  nav      seq, path, label, depth, fragment, decoded    entries of the table of contents
  anchors  pos, id, idx    block before which an id stands, once for each id and document
  toc      path    documents declared to be the table of contents
Output: chapter_index, title, level, pos, from_block, to_block; a chapter has the blocks of its
document from from_block up to, not including, to_block.

All shuffles are by book_id, and a book is bounded, so no window meets a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved_entries(spine: DataFrame, nav: DataFrame, anchors: DataFrame) -> DataFrame:
    """Entries at the first document of their path, with the block at which each begins: 0 without a
    fragment, null if the fragment, as written or decoded, names no anchor there."""
    first = spine.groupBy("book_id", "path").agg(F.min("pos").alias("pos"))
    at = nav.join(first, ["book_id", "path"])
    raw = anchors.select("book_id", "pos", F.col("id").alias("fragment"), F.col("idx").alias("raw_idx"))
    late = anchors.select("book_id", "pos", F.col("id").alias("decoded"), F.col("idx").alias("late_idx"))
    at = at.join(raw, ["book_id", "pos", "fragment"], "left").join(late, ["book_id", "pos", "decoded"], "left")
    whole = F.coalesce(F.col("fragment"), F.lit("")) == ""
    return at.select("book_id", "pos", "seq", "label", "depth", F.when(whole, 0).otherwise(F.coalesce("raw_idx", "late_idx")).alias("point"))


def assemble(spine: DataFrame, nav: DataFrame, anchors: DataFrame, toc: DataFrame) -> DataFrame:
    entries = resolved_entries(spine, nav, anchors)
    doc = Window.partitionBy("book_id", "pos")
    counted = entries.groupBy("book_id", "pos").agg(F.count("*").alias("n"), F.count("point").alias("n_resolved"), F.min("point").alias("first_point"))
    declared = toc.select("book_id", "path", F.lit(True).alias("is_toc")).distinct()
    docs = spine.join(counted, ["book_id", "pos"], "left").join(declared, ["book_id", "path"], "left")
    docs = docs.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("n_resolved", F.coalesce("n_resolved", F.lit(0))).withColumn("is_toc", F.coalesce("is_toc", F.lit(False)))
    split = F.col("has_bytes") & (F.col("n") > 1) & (F.col("n_resolved") > 0)

    # Documents that stay whole and untitled: not navigated to, or by no anchor that exists.
    plain = docs.where(F.col("has_bytes") & (F.col("n_blocks") > 0) & (((F.col("n") == 0) & ~F.col("is_toc")) | ((F.col("n") > 1) & (F.col("n_resolved") == 0))))
    untitled = [F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("lvl")]
    # The documents' own order comes first, then entries by where they begin and their order.
    whole = plain.select("book_id", "pos", F.lit(-1).alias("rk"), *untitled, F.lit(0).alias("from_block"), F.col("n_blocks").alias("to_block"))
    before = docs.where(split & (F.col("first_point") > 0)).select("book_id", "pos", F.lit(-1).alias("rk"), *untitled, F.lit(0).alias("from_block"), F.col("first_point").alias("to_block"))

    at = entries.join(docs.select("book_id", "pos", "has_bytes", "n_blocks", "n", "n_resolved"), ["book_id", "pos"])
    titled = ["book_id", "pos", "rk", "label", F.col("depth").alias("lvl")]
    missing = at.where(~F.col("has_bytes")).withColumn("rk", F.col("seq")).select(*titled, F.lit(0).alias("from_block"), F.lit(0).alias("to_block"))
    single = at.where(F.col("has_bytes") & (F.col("n") == 1)).withColumn("rk", F.col("seq")).select(*titled, F.lit(0).alias("from_block"), F.col("n_blocks").alias("to_block"))
    by_point = doc.orderBy("point", "seq")
    following = F.min("point").over(doc.orderBy("point").rangeBetween(1, Window.unboundedFollowing))
    several = at.where(split & F.col("point").isNotNull()).withColumn("rk", F.row_number().over(by_point)).withColumn("next", F.lead("point").over(by_point)).withColumn("end", F.coalesce(following, F.col("n_blocks")))
    owns = F.col("next").isNull() | (F.col("next") != F.col("point"))
    several = several.select(*titled, F.col("point").alias("from_block"), F.when(owns, F.col("end")).otherwise(F.col("point")).alias("to_block"))

    every = whole.unionByName(before).unionByName(missing).unionByName(single).unionByName(several)
    book = Window.partitionBy("book_id").orderBy("pos", "rk")
    earlier = F.last("lvl", ignorenulls=True).over(book.rowsBetween(Window.unboundedPreceding, -1))
    return every.select(
        "book_id", (F.row_number().over(book) - 1).alias("chapter_index"), F.nullif(F.col("label"), F.lit("")).alias("title"),
        F.coalesce("lvl", earlier, F.lit(0)).alias("level"), "pos", "from_block", "to_block",
    )


def chapter_blocks(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks (book_id, pos, idx, ...) in their chapters, with chapter_index and block_index."""
    where = chapters.where("to_block > from_block").select("book_id", "pos", "chapter_index", "from_block", "to_block")
    met = blocks.join(where, ["book_id", "pos"]).where("idx >= from_block and idx < to_block")
    return met.withColumn("block_index", F.col("idx") - F.col("from_block")).drop("pos", "idx", "from_block", "to_block")

"""python examples/open_books.py PATH: what the books under a path are, and how they begin."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagecrest.sources.books import read_books


def main(path: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    books = read_books(spark, path, fallback_language="en").persist()
    books.books().select("book_id", "ok", "failure.kind", "failure.message", "metadata.title", "metadata.authors", "metadata.source_language_code").show(truncate=60)
    books.chapters().where("title is not null").orderBy("book_id", "chapter_index").show(50, truncate=60)
    first = F.struct("chapter_index", "block_index", "sentence_index", "text")
    begin = F.transform(F.slice(F.array_sort(F.collect_list(first)), 1, 3), lambda s: s["text"])
    opening = books.sentences().where("chapter_index < 3").groupBy("book_id").agg(begin.alias("first_sentences"))
    opening.show(truncate=200)


if __name__ == "__main__":
    main(sys.argv[1])

"""Books as tables: a corpus of EPUB and FB2 files, plain or alone in a zip.

One Python pass over the files emits flat events; books, chapters, blocks and images are DataFrame
queries over them. A book that cannot be read is a row with its failure, never an error of the job.
The metadata path is another pass, which reads no more of a file than metadata needs.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagecrest.functions.segment import Segmenter, sentence_rows, word_rows
from pagecrest.functions.text import normalize_language, reduced_language
from pagecrest.plans.chapters import assemble, chapter_blocks
from pagecrest.sources import epub, fb2
from pagecrest.sources.archive import route
from pagecrest.sources.events import NAMES, SCHEMA, Event, Failure

FULL = {"epub": epub.parse, "fb2": fb2.parse}
METADATA = {"epub": epub.parse_metadata, "fb2": fb2.parse_metadata}
EVENTS = f"book_id string, format string, {SCHEMA}"
#: Files beyond this size, packed, are a failure instead of a danger to their executor, unless the
#: caller says otherwise (most_bytes). Arrow holds two GiB in a cell.
MOST_BYTES = 1 << 30
#: A parser of the caller: bytes in, events out; it raises Failure.
Parser = Callable[[bytes], Iterable[Event]]


def book_events(path: str, data: bytes, parsers: dict[str, Parser]) -> tuple[str | None, list[Event]]:
    """Format and events of one file; all of them or a single failure. A caller's parser has the files
    with the extension that it is named by."""
    kind = None
    try:
        own = posixpath.splitext(path)[1][1:].lower()
        kind, payload = (own, data) if own in parsers and own not in FULL else route(path, data)
        if kind is None:
            return None, []
        return kind, list(parsers[kind](payload))
    except Failure as e:
        return kind, [e.event()]
    except Exception as e:  # whatever a damaged file provokes is its own failure
        return kind, [Failure("corrupt", f"the {kind or 'book'} file is damaged", str(e)).event()]


def unread(size: int | None) -> Event:
    """The failure of a file whose bytes are missing or too many."""
    return Failure("corrupt", "the file has no content" if size is None else f"the file has {size} bytes, more than are read", None).event()


def parse_events(files: DataFrame, metadata_only: bool = False, most_bytes: int = MOST_BYTES, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Events of files (path, content and, if the content was left out for its size, size): one row each,
    keyed by book_id, the path. Files that are no books have a single row of kind none; files of over
    most_bytes and those without content have a failure. parsers has a caller's own by extension."""
    parsers, schema = (METADATA if metadata_only else FULL) | (parsers or {}), StructType.fromDDL(EVENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                path, data, size = (batch.column(i)[k].as_py() for i in (0, 1, 2))
                kind, events = book_events(path, data, parsers) if data is not None else (None, [unread(size)])
                events = events or [Event("none")]
                for at in range(0, len(events), 2000):
                    part = events[at : at + 2000]
                    cols = [[path] * len(part), [kind] * len(part), *([getattr(e, n) for e in part] for n in NAMES)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    size = F.coalesce(F.octet_length("content").cast("long"), F.col("size") if "size" in files.columns else F.lit(None))
    return files.select("path", F.when(size <= most_bytes, F.col("content")).alias("content"), size.alias("size")).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under a path as (path, content, size). All files count unless a glob is given, such as
    archive.IMPORT_GLOB: wrong and missing extensions are common, and the bytes tell what a file is. Of
    files of over most_bytes the content is never read, as the source takes a filter on the length."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    small = found.where(F.col("length") <= most_bytes).select("path", "content", F.col("length").alias("size"))
    return small.unionByName(found.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.col("length").alias("size")))


@dataclass
class Books:
    """Views over a corpus's events. Each view that is run parses the files anew unless the events are
    kept: `persist` keeps them in this application, `store` for good, which is what a large corpus wants."""

    events: DataFrame
    fallback_language: str

    def __post_init__(self):
        if reduced_language(self.events.sparkSession, self.fallback_language) is None:
            raise ValueError(f"fallback language {self.fallback_language!r} is not an ISO 639-1 language")

    def persist(self) -> Books:
        """Keeps the events, so that several tables cost one parse."""
        self.events = self.events.persist()
        return self

    def store(self, path: str) -> Books:
        """Writes the events once, in a folder for each kind, so that every table reads its own kinds
        only: text queries never touch the bytes of images. Returns the books as stored."""
        self.events.write.mode("overwrite").partitionBy("kind").parquet(path)
        return stored_books(self.events.sparkSession, path, self.fallback_language)

    def _of(self, kind: str, fmt: str | None = None) -> DataFrame:
        rows = self.events.where(F.col("kind") == kind)
        return rows.where(F.col("format") == fmt) if fmt else rows

    def _language(self, tag: Column) -> Column:
        return normalize_language(self.events.sparkSession, tag, self.fallback_language)

    def books(self) -> DataFrame:
        """book_id, format, ok, failure and metadata of every book."""
        meta = self._of("meta").select("book_id", F.struct(F.col("text").alias("title"), F.col("authors"), self._language(F.col("name")).alias("source_language_code"), F.col("cover").alias("cover_image_id")).alias("metadata"))
        bad = self._of("failure").select("book_id", F.struct(F.col("sub").alias("kind"), "message", "cause").alias("failure"))
        heads = self.events.where(F.col("kind").isin("meta", "failure")).select("book_id", "format").distinct()
        rows = heads.join(meta, "book_id", "left").join(bad, "book_id", "left")
        read = self._of("full").select("book_id").withColumn("full", F.lit(True))
        filled = self._epub_chapters().where("to_block > from_block").select("book_id").distinct().withColumn("filled", F.lit(True))
        rows = rows.join(read, "book_id", "left").join(filled, "book_id", "left")
        empty = F.col("full") & F.col("filled").isNull() & F.col("failure").isNull()
        none = F.struct(F.lit("emptyDocument").alias("kind"), F.lit("no document of the book has any text or image").alias("message"), F.lit(None).cast("string").alias("cause"))
        failure = F.when(empty, none).otherwise(F.col("failure"))
        return rows.select("book_id", "format", failure.isNull().alias("ok"), failure.alias("failure"), F.when(failure.isNull(), F.col("metadata")).alias("metadata"))

    def _epub_chapters(self) -> DataFrame:
        spine = self._of("spine", "epub").select("book_id", "pos", F.col("name").alias("path"), F.col("flag").alias("has_bytes"), F.col("n").alias("n_blocks"))
        nav = self._of("nav", "epub").select("book_id", "seq", F.col("name").alias("path"), F.col("text").alias("label"), F.col("level").alias("depth"), "fragment", "decoded")
        anchors = self._of("anchor", "epub").select("book_id", "pos", F.col("name").alias("id"), "idx")
        return assemble(spine, nav, anchors, self._of("toc", "epub").select("book_id", F.col("name").alias("path")))

    def chapters(self) -> DataFrame:
        """book_id, chapter_index, title, level; a book without any block has none."""
        packed = self._epub_chapters()
        filled = packed.where("to_block > from_block").select("book_id").distinct()
        mine = self._of("chapter").select("book_id", F.col("pos").alias("chapter_index"), F.col("text").alias("title"), "level")
        return packed.join(filled, "book_id", "left_semi").select("book_id", "chapter_index", "title", "level").unionByName(mine)

    def blocks(self) -> DataFrame:
        """book_id, chapter_index, block_index, kind, text, heading_level, image_id."""
        rows = self._of("block").select("book_id", "format", "pos", "idx", F.col("sub").alias("block_kind"), "text", F.col("level").alias("heading_level"), F.col("name").alias("image_id"))
        packed = chapter_blocks(self._epub_chapters(), rows.where("format = 'epub'"))
        flat = rows.where("format <> 'epub'").withColumnsRenamed({"pos": "chapter_index", "idx": "block_index"})
        names = ["book_id", "chapter_index", "block_index", F.col("block_kind").alias("kind"), "text", "heading_level", "image_id"]
        return packed.select(*names).unionByName(flat.select(*names))

    def images(self) -> DataFrame:
        """book_id, image_id, media_type, bytes of the images that covers and blocks name."""
        return self._of("image").select("book_id", F.col("name").alias("image_id"), (F.coalesce("sub", F.lit("block")) == "cover").alias("as_cover"), F.col("media").alias("media_type"), F.col("data").alias("bytes"))

    def sentences(self, abbreviations: tuple[str, ...] = (), segmenter: Segmenter | None = None) -> DataFrame:
        """Sentences of paragraphs, by the rules for the book's language or by a caller's segmenter."""
        meta = self._of("meta").select("book_id", self._language(F.col("name")).alias("lang"))
        rows = self.blocks().where("kind = 'p'").join(meta, "book_id")
        keys = ("book_id", "chapter_index", "block_index", "lang")
        return sentence_rows(rows, *keys, lang=F.col("lang"), abbreviations=abbreviations, segmenter=segmenter)

    def words(self, abbreviations: tuple[str, ...] = (), segmenter: Segmenter | None = None, word_segmenter: Segmenter | None = None) -> DataFrame:
        """Words of sentences; word_segmenter is a caller's, from the text of a sentence."""
        return word_rows(self.sentences(abbreviations, segmenter), "book_id", "chapter_index", "block_index", lang=F.col("lang"), segmenter=word_segmenter)

    def register(self, prefix: str = "") -> None:
        """The tables as temporary views, for SQL. The events are kept first, so six views cost one parse."""
        self.persist()
        for name in ("books", "chapters", "blocks", "images", "sentences", "words"):
            getattr(self, name)().createOrReplaceTempView(prefix + name)


def stored_books(spark: SparkSession, path: str, fallback_language: str) -> Books:
    """Books whose events were stored before."""
    return Books(spark.read.schema(EVENTS).parquet(path), fallback_language)


def read_books(spark: SparkSession, path: str, fallback_language: str, glob: str | None = None, most_bytes: int = MOST_BYTES, parsers: dict[str, Parser] | None = None) -> Books:
    return books_of(read_files(spark, path, glob, most_bytes), fallback_language, most_bytes=most_bytes, parsers=parsers)


def books_of(files: DataFrame, fallback_language: str, metadata_only: bool = False, most_bytes: int = MOST_BYTES, parsers: dict[str, Parser] | None = None) -> Books:
    """Books out of a table of (path, content)."""
    return Books(parse_events(files, metadata_only, most_bytes, parsers), fallback_language)


def read_book_metadata(spark: SparkSession, path: str, fallback_language: str, glob: str | None = None, most_bytes: int = MOST_BYTES, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """book_id, format, ok, failure, metadata, by the path that parses no contents."""
    return books_of(read_files(spark, path, glob, most_bytes), fallback_language, True, most_bytes, parsers).books()

"""Books to and from versioned JSON, images apart.

A document is {v, metadata: {title, authors, lang, cover}, chapters: [{title, level, blocks}]}; a block
is {t: p, text}, {t: h, text, level} or {t: img, ref, mediaType}. Images get the ids img0, img1, ... in
order: the cover, then each image block. Sentences are not stored; they follow from the language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecrest.functions.segment import Segmenter, sentence_rows

#: Fixed value: version of the shape; other versions are not read.
VERSION = 1
BLOCK = "struct<t:string,text:string,level:int,ref:string,mediaType:string>"
SHAPE = f"struct<v:int,metadata:struct<title:string,authors:array<string>,lang:string,cover:struct<ref:string,mediaType:string>>,chapters:array<struct<title:string,level:int,blocks:array<{BLOCK}>>>>"


def block_json(kind: Column, text: Column, level: Column, ref: Column, media: Column) -> Column:
    """One block as a variant that has only its own kind's keys."""
    shape = F.struct(
        kind.alias("t"), F.when(kind != "img", text).alias("text"), F.when(kind == "h", level).alias("level"),
        F.when(kind == "img", ref).alias("ref"), F.when(kind == "img", media).alias("mediaType"),
    )
    return F.parse_json(F.to_json(shape))


def encode_block(kind: Column, text: Column, level: Column, ref: Column, media: Column) -> Column:
    """One block with the version, as JSON text."""
    return F.to_json(F.struct(F.lit(VERSION).alias("v"), block_json(kind, text, level, ref, media).alias("block")))


def decode_block(json: Column) -> Column:
    """struct<kind,text,heading_level,ref> of what encode_block gives, or null if it cannot be read or
    has another version. The caller looks the image up by ref."""
    read = F.from_json(json, f"struct<v:int,block:{BLOCK}>", {"mode": "PERMISSIVE"})
    sound = F.coalesce((read["v"] == VERSION) & sound_block(read["block"]), F.lit(False))
    b = read["block"]
    return F.when(sound, F.struct(b["t"].alias("kind"), b["text"].alias("text"), b["level"].alias("heading_level"), b["ref"].alias("ref")))


def sound_block(b: Column) -> Column:
    """Whether a block has what its kind needs."""
    named = b["text"].isNotNull()
    return ((b["t"] == "p") & named) | ((b["t"] == "h") & named & b["level"].isNotNull()) | ((b["t"] == "img") & b["ref"].isNotNull())


def image_refs(books: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, ref, image_id, media_type, bytes, chapter_index, block_index); the cover has indices -1."""
    cover = books.where("metadata.cover_image_id is not null").select("book_id", F.lit(-1).alias("chapter_index"), F.lit(-1).alias("block_index"), F.col("metadata.cover_image_id").alias("image_id"))
    used = cover.unionByName(blocks.where("kind = 'img'").select("book_id", "chapter_index", "block_index", "image_id"))
    order = Window.partitionBy("book_id").orderBy("chapter_index", "block_index")
    numbered = used.withColumn("ref", F.concat(F.lit("img"), F.row_number().over(order) - 1))
    # A cover may have a media type of its own.
    best = Window.partitionBy("book_id", "image_id", "ref").orderBy(F.col("as_cover") != (F.col("block_index") == -1))
    found = numbered.join(images, ["book_id", "image_id"]).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return found.select("book_id", "ref", "image_id", "media_type", "bytes", "chapter_index", "block_index")


def encode(books: DataFrame, chapters: DataFrame, blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(book_id, json) of every book that was read. refs is what image_refs returns."""
    named = refs.select("book_id", "chapter_index", "block_index", "ref", "media_type")
    rows = blocks.join(named, ["book_id", "chapter_index", "block_index"], "left")
    one = F.struct("block_index", F.to_json(block_json(F.col("kind"), F.col("text"), F.col("heading_level"), F.col("ref"), F.col("media_type"))).alias("json"))
    per_chapter = rows.groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    parsed = lambda a: F.transform(a, lambda b: F.parse_json(b["json"]))
    whole = chapters.join(per_chapter, ["book_id", "chapter_index"], "left")
    item = F.struct("chapter_index", "title", "level", F.coalesce("blocks", F.array().cast("array<struct<block_index:int,json:string>>")).alias("blocks"))
    per_book = whole.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("chapters"))
    cover = named.where("chapter_index = -1").select("book_id", F.struct("ref", F.col("media_type").alias("mediaType")).alias("cover"))
    rows = books.where("ok").join(per_book, "book_id", "left").join(cover, "book_id", "left")
    metadata = F.struct(F.col("metadata.title").alias("title"), F.col("metadata.authors").alias("authors"), F.col("metadata.source_language_code").alias("lang"), F.col("cover"))
    listed = F.transform(F.coalesce("chapters", F.array().cast(per_book.schema["chapters"].dataType)), lambda c: F.struct(c["title"].alias("title"), c["level"].alias("level"), parsed(c["blocks"]).alias("blocks")))
    document = F.struct(F.lit(VERSION).alias("v"), metadata.alias("metadata"), listed.alias("chapters"))
    return rows.select("book_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def decode(documents: DataFrame, images: DataFrame) -> DataFrame:
    """documents (book_id, json) as (book_id, ok, metadata, chapters); images has book_id, ref and
    media_type. ok is false, and the rest null, where the JSON cannot be read, has another version or
    names an image that is not there. Image blocks take their media type from images."""
    read = documents.select("book_id", F.from_json("json", SHAPE, {"mode": "PERMISSIVE"}).alias("d"))
    sound = F.forall("d.chapters", lambda c: c["level"].isNotNull() & c["blocks"].isNotNull() & F.forall(c["blocks"], lambda b: F.coalesce(sound_block(b), F.lit(False))))
    shaped = (F.col("d.v") == VERSION) & F.col("d.metadata.lang").isNotNull() & F.col("d.metadata.authors").isNotNull() & F.col("d.chapters").isNotNull() & sound
    refs = F.flatten(F.transform("d.chapters", lambda c: F.transform(F.filter(c["blocks"], lambda b: b["t"] == "img"), lambda b: b["ref"])))
    wanted = F.array_distinct(F.array_compact(F.concat(refs, F.array("d.metadata.cover.ref"))))
    known = images.groupBy("book_id").agg(F.map_from_entries(F.collect_set(F.struct("ref", "media_type"))).alias("media"))
    rows = read.withColumn("shaped", F.coalesce(shaped, F.lit(False))).join(known, "book_id", "left")
    media = F.coalesce("media", F.create_map().cast("map<string,string>"))
    resolved = F.coalesce(F.size(F.array_except(wanted, F.map_keys(media))) == 0, F.lit(False))
    rows = rows.withColumn("media", media).withColumn("ok", F.col("shaped") & resolved)

    def typed(b: Column) -> Column:
        return F.struct(b["t"].alias("kind"), b["text"].alias("text"), b["level"].alias("heading_level"), b["ref"].alias("ref"), F.when(b["t"] == "img", F.try_element_at(F.col("media"), b["ref"])).alias("media_type"))

    chapters = F.transform("d.chapters", lambda c, i: F.struct(i.alias("chapter_index"), c["title"].alias("title"), c["level"].alias("level"), F.transform(c["blocks"], typed).alias("blocks")))
    return rows.select("book_id", "ok", F.when(F.col("ok"), F.col("d.metadata")).alias("metadata"), F.when(F.col("ok"), chapters).alias("chapters"))


def decoded_sentences(decoded: DataFrame, abbreviations: tuple[str, ...] = (), segmenter: Segmenter | None = None) -> DataFrame:
    """Sentences of what decode returns, by the rules for each document's language or by a caller's
    segmenter: they are not stored, so they are cut anew."""
    lang = decoded.where("ok").select("book_id", F.col("metadata.lang").alias("lang"))
    rows = decoded_blocks(decoded).where("kind = 'p'").join(lang, "book_id")
    return sentence_rows(rows, "book_id", "chapter_index", "block_index", "lang", lang=F.col("lang"), abbreviations=abbreviations, segmenter=segmenter)


def decoded_blocks(decoded: DataFrame) -> DataFrame:
    """Block rows of what decode returns; chapters are numbered anew."""
    each = decoded.where("ok").select("book_id", F.explode("chapters").alias("c"))
    rows = each.select("book_id", "c.chapter_index", F.posexplode("c.blocks").alias("block_index", "b"))
    return rows.select("book_id", "chapter_index", "block_index", "b.*")

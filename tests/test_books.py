"""Whole books, from bytes to tables and back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from builders import OTHER_PICTURE, PICTURE, binary, epub, fb2, zipped
from pagecrest.operators import codec
from pagecrest.operators.sample import body_sample
from pagecrest.sources.books import books_of, read_book_metadata, read_books


def corpus(spark, files, metadata_only=False, fallback="en"):
    table = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary").coalesce(2)
    return books_of(table, fallback, metadata_only)


def outline(books):
    """Per book its chapters as (title, level, texts)."""
    out = {}
    rows = books.chapters().join(books.blocks().groupBy("book_id", "chapter_index").agg(F.array_sort(F.collect_list(F.struct("block_index", "kind", "text", "heading_level"))).alias("b")), ["book_id", "chapter_index"], "left")
    for r in sorted(rows.collect(), key=lambda r: (r["book_id"], r["chapter_index"])):
        out.setdefault(r["book_id"], []).append((r["title"], r["level"], [(x["kind"], x["text"]) for x in r["b"] or []]))
    return out


def status(books):
    return {r["book_id"]: ("ok" if r["ok"] else r["failure"]["kind"], r["metadata"]) for r in books.books().collect()}


def test_fb2_structure(spark):
    bodies = (
        "<body><title><p>The</p><p>Book</p></title><epigraph><p>Wise <strong>words</strong>.</p></epigraph>"
        "<section><title><p>One</p></title><p>A  b</p><section><subtitle>Sub</subtitle><empty-line/>"
        "<poem><title><p>Poem</p></title><stanza><v>line 1</v><v> line 2 </v></stanza></poem></section><p>after</p></section>"
        "<section/><section><table><tr><td>a</td><th>b</th></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table></section></body>"
        '<body name="notes"><section><title><p>1</p></title><p>note</p></section></body>'
    )
    got = outline(corpus(spark, {"a.fb2": fb2(bodies)}))["a.fb2"]
    assert got == [
        ("The Book", 0, [("h", "The Book"), ("p", "Wise words.")]),
        ("One", 0, [("h", "One"), ("p", "A b"), ("p", "after")]),
        (None, 1, [("h", "Sub"), ("h", "Poem"), ("p", "line 1\nline 2")]),
        (None, 0, [("p", "a b"), ("p", "in")]),
        ("1", 0, [("h", "1"), ("p", "note")]),
    ]


def test_epub_chapters(spark):
    docs = [("c/a.xhtml", '<h1 id="x">A</h1><p>a1<p>a2<h2 id="y">B</h2><p>b1</p>'), ("c/b.xhtml", "<p>loose</p>"), ("c/c.xhtml", None), ("c/toc.xhtml", "<p>contents</p>")]
    nav = [("Before", "c/a.xhtml#y", 0), ("First", "c/a.xhtml#x", 1), ("Lost", "c/a.xhtml#nope", 0), ("Gone", "c/c.xhtml", 1)]
    for modern in (False, True):
        got = outline(corpus(spark, {"a.epub": epub(docs, nav, modern=modern, guide="c/toc.xhtml")}))["a.epub"]
        assert got == [
            ("First", 1, [("h", "A"), ("p", "a1"), ("p", "a2")]),
            ("Before", 0, [("h", "B"), ("p", "b1")]),
            (None, 0, [("p", "loose")]),
            ("Gone", 1, []),
        ]


def test_xhtml_rules(spark):
    body = (
        "<div>one<br/>two <b>bold</div><ul><li>x<li>y</ul><p>a<img src='i.png'/>b</p><table><caption>C</caption><tr><td>1<td>2</table>"
        "<ruby>漢<rt>kan</rt></ruby><script>no()</script><svg><image xlink:href='i.png'/><text>t</text></svg><h3>H <br>x</h3>"
    )
    books = corpus(spark, {"a.epub": epub([("a.xhtml", body)], files={"i.png": PICTURE})})
    kinds = [(r["kind"], r["text"] or r["image_id"]) for r in sorted(books.blocks().collect(), key=lambda r: r["block_index"])]
    assert kinds == [
        ("p", "one\ntwo bold"), ("p", "x"), ("p", "y"), ("p", "a"), ("img", "i.png"), ("p", "b"), ("p", "C"), ("p", "1 2"), ("p", "漢"),
        ("img", "i.png"), ("h", "H x"),
    ]


def test_failures(spark):
    good, rng = epub([("a.xhtml", "<p>x</p>")]), random.Random(3)
    flipped = bytearray(good)
    for k in range(len(good) - 40, len(good) - 20):
        flipped[k] ^= 0xFF
    deep = "<section>" * 3000 + "<p>deep</p>" + "</section>" * 3000
    locked = '<encryption xmlns:e="x"><e:EncryptedData><e:EncryptionMethod Algorithm="aes"/><e:CipherData><e:CipherReference URI="{}"/></e:CipherData></e:EncryptedData></encryption>'
    bomb = fb2().replace(b"<FictionBook", b'<!DOCTYPE x [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;&a;">]><FictionBook', 1).replace(b"A short line.", b"&b;")
    files = {
        "good.epub": good, "cut.epub": good[:100], "half.epub": good[: len(good) // 2], "flipped.epub": bytes(flipped), "bad.fb2": fb2()[:-30],
        "wrong.fb2": b"<html/>", "enc.fb2": fb2(declared="ebcdic-x", codec="utf-8"), "empty.fb2": fb2("<body><section/></body>"), "empty.epub": epub([("a.xhtml", "")]),
        "no.container.epub": zipped({"mimetype": "x"}), "drm.epub": epub([("a.xhtml", "<p>x</p>")], files={"META-INF/encryption.xml": locked.format("a.xhtml")}),
        "font.epub": epub([("a.xhtml", "<p>x</p>")], files={"META-INF/encryption.xml": locked.format("f.TTF")}), "rights.epub": epub([("a.xhtml", "<p>x</p>")], files={"META-INF/rights.xml": "x"}),
        "deep.fb2": fb2(f"<body>{deep}</body>"), "bomb.fb2": bomb, "junk.bin": rng.randbytes(512), "none.zip": zipped({"a.txt": "x"}),
    }
    got = {k: v[0] for k, v in status(corpus(spark, files)).items()}
    assert got == {
        "good.epub": "ok", "cut.epub": "corrupt", "half.epub": "corrupt", "flipped.epub": "corrupt", "bad.fb2": "corrupt", "wrong.fb2": "unsupportedFormat",
        "enc.fb2": "encoding", "empty.fb2": "emptyDocument", "empty.epub": "emptyDocument", "no.container.epub": "corrupt", "drm.epub": "drmProtected",
        "font.epub": "ok", "rights.epub": "drmProtected", "deep.fb2": "ok", "bomb.fb2": "ok",
    }


def test_metadata_paths_agree(spark):
    pics = binary("c", PICTURE, "image/png") + binary("c", OTHER_PICTURE, "image/gif")
    files = {
        "a.fb2": fb2(cover="#c", binaries=pics, lang="fr-FR"), "b.fb2": fb2(cover="#none"), "c.fb2": fb2(lang=None, writer="<author><nickname>Nick</nickname></author>"),
        "early.fb2": fb2(cover="#c").replace(b"<description>", pics.encode() + b"<description>"), "d.epub": epub([("a.xhtml", "<p>x</p>")], picture=("p/c.png", PICTURE, 'id="k" media-type="image/png"', '<meta name="cover" content="k"/>'), head="<language>ger</language>"),
        "e.epub": epub([("a.xhtml", "<p>x</p>")], picture=("c.png", PICTURE, 'id="k" properties="cover-image"', ""), head=""), "f.epub": epub([("a.xhtml", "<p>x</p>")], picture=("c.xhtml", b"x", 'id="cover" media-type="application/xhtml+xml"', "")),
        "zip.fb2.zip": zipped({"__MACOSX/x.fb2": "no", "dir/book.fb2": fb2(cover="#c", binaries=pics)}),
    }
    full, cheap = corpus(spark, files), corpus(spark, files, metadata_only=True)
    assert status(full) == status(cheap)
    meta = {k: v[1] for k, v in status(full).items()}
    assert meta["a.fb2"]["source_language_code"] == "fr" and meta["d.epub"]["source_language_code"] == "de" and meta["c.fb2"]["authors"] == ["Nick"]
    assert meta["zip.fb2.zip"]["cover_image_id"] == "c" and meta["f.epub"]["cover_image_id"] is None and meta["b.fb2"]["cover_image_id"] is None
    covers = lambda b: {r["book_id"]: (r["media_type"], bytes(r["bytes"])) for r in b.images().collect()}
    assert covers(full) == covers(cheap)
    assert covers(full)["early.fb2"] == ("image/png", PICTURE)


def test_metadata_ignores_damage_after_cover(spark):
    damaged = fb2()[:-40] + b"<p>"
    assert status(corpus(spark, {"a.fb2": damaged}))["a.fb2"][0] == "corrupt"
    assert status(corpus(spark, {"a.fb2": damaged}, metadata_only=True))["a.fb2"][0] == "ok"
    read = corpus(spark, {"a.epub": epub([("a.xhtml", "<p>x</p>")], picture=("c.png", PICTURE, 'id="k" media-type="image/png"', '<meta name="cover" content="k"/>'))}, metadata_only=True)
    assert {r["name"] for r in read.events.where("kind = 'entry'").collect()} == {"META-INF/container.xml", "pkg.opf", "c.png"}


def test_encodings(spark):
    russian = "<body><section><p>Он пришёл домой и лёг спать.</p></section></body>"
    files = {
        "1251": fb2(russian, declared="windows-1251"), "koi": fb2(russian, declared="koi8-r"), "16": fb2(russian, declared="utf-16"),
        "lie": fb2(russian, codec="windows-1251"), "lie2": fb2(russian, codec="koi8-r"), "bom": b"\xef\xbb\xbf" + fb2(russian),
    }
    books = corpus(spark, {f"{k}.fb2": v for k, v in files.items()})
    assert {r["text"] for r in books.blocks().collect()} == {"Он пришёл домой и лёг спать."}
    assert books.blocks().count() == len(files)


def test_greek_language_seeds_sentences(spark):
    books = corpus(spark, {"a.fb2": fb2("<body><section><p>Τι ώρα είναι; Είναι αργά.</p></section></body>", lang="el")})
    assert [r["text"] for r in books.sentences().orderBy("sentence_index").collect()] == ["Τι ώρα είναι;", "Είναι αργά."]
    custom = books.sentences(segmenter=lambda text, lang: F.array(F.struct(F.lower(text).alias("text"), F.lit(0).alias("start"), F.length(text).alias("end"))))
    assert custom.count() == 1


def test_codec_round_trip(spark):
    body = '<body><section><title><p>One</p></title><p>First. Second.</p><image l:href="#pic"/><p>After.</p></section><section><p>Two</p></section></body>'
    books = corpus(spark, {"a.fb2": fb2(body, cover="#cover", binaries=binary("cover", OTHER_PICTURE, "image/jpeg") + binary("pic", PICTURE, "image/png"))}).persist()
    refs = codec.image_refs(books.books(), books.blocks(), books.images())
    made = codec.encode(books.books(), books.chapters(), books.blocks(), refs)
    assert json.loads(made.first()["json"]) == {
        "v": 1, "metadata": {"title": "Hills", "authors": ["Ida Field"], "lang": "en", "cover": {"ref": "img0", "mediaType": "image/jpeg"}},
        "chapters": [
            {"title": "One", "level": 0, "blocks": [{"t": "h", "text": "One", "level": 1}, {"t": "p", "text": "First. Second."}, {"t": "img", "ref": "img1", "mediaType": "image/png"}, {"t": "p", "text": "After."}]},
            {"title": None, "level": 0, "blocks": [{"t": "p", "text": "Two"}]},
        ],
    }
    back = codec.decode(made, refs)
    assert back.first()["ok"]
    texts = [(r["kind"], r["text"], r["media_type"]) for r in codec.decoded_blocks(back).orderBy("chapter_index", "block_index").collect()]
    assert texts == [("h", "One", None), ("p", "First. Second.", None), ("img", None, "image/png"), ("p", "After.", None), ("p", "Two", None)]
    assert not codec.decode(made, refs.where("ref = 'img0'")).first()["ok"]
    for broken in (F.replace("json", F.lit('"v":1'), F.lit('"v":2')), F.lit("{"), F.lit('{"v":1}'), F.lit('{"v":1,"metadata":"x","chapters":[]}')):
        assert not codec.decode(made.withColumn("json", broken), refs).first()["ok"]


def test_stored_books(spark, tmp_path):
    files = {"a.fb2": fb2(), "b.epub": epub([("a.xhtml", "<p>One. Two.</p><img src='i.png'/>")], [("A", "a.xhtml", 0)], files={"i.png": PICTURE}), "c.fb2": b"<x/>", "d": b"no book"}
    books = corpus(spark, files).persist()
    kept = books.store(str(tmp_path / "events"))
    for name in ("books", "chapters", "blocks", "sentences", "words"):
        assert sorted(map(str, getattr(kept, name)().collect())) == sorted(map(str, getattr(books, name)().collect()))
    assert {bytes(r["bytes"]) for r in kept.images().collect()} == {PICTURE}
    plan = kept.blocks()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_block_codec(spark):
    rows = [("p", "a", None, None, None), ("h", "b", 2, None, None), ("img", None, None, "img3", "image/png")]
    made = spark.createDataFrame(rows, "kind string, text string, level int, ref string, media string").withColumn("json", codec.encode_block(*map(F.col, ("kind", "text", "level", "ref", "media"))))
    assert [json.loads(r["json"])["block"] for r in made.collect()] == [{"t": "p", "text": "a"}, {"t": "h", "text": "b", "level": 2}, {"t": "img", "ref": "img3", "mediaType": "image/png"}]
    back = [r[0] for r in made.select(codec.decode_block(F.col("json"))).collect()]
    assert [(b["kind"], b["text"], b["heading_level"], b["ref"]) for b in back] == [r[:4] for r in rows]
    for broken in ('{"v":2,"block":{"t":"p","text":"a"}}', '{"v":1,"block":{"t":"p"}}', "{", '{"v":1}'):
        assert made.select(codec.decode_block(F.lit(broken))).first()[0] is None


def test_body_sample(spark):
    rows = [("a", 0, "p", "12345"), ("a", 1, "h", "head"), ("a", 2, "p", "6789"), ("a", 3, "p", "x"), ("b", 0, "h", "h")]
    blocks = spark.createDataFrame(rows, "book_id string, block_index int, kind string, text string")
    for most, want in ((1, "12345\n"), (6, "12345\n"), (7, "12345\n6789\n"), (99, "12345\n6789\nx\n")):
        got = {r["book_id"]: r["sample"] for r in body_sample(blocks, "block_index", max_chars=most).collect()}
        assert got == {"a": want, "b": ""}


def test_files_and_views(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "book.without.ending").write_bytes(fb2())
    (tmp_path / "b.epub").write_bytes(epub([("a.xhtml", "<p>One. Two.</p>")]))
    (tmp_path / "note.txt").write_text("no book")
    books = read_books(spark, str(tmp_path), "en").persist()
    books.register("t_")
    assert spark.sql("select count(*) n from t_books where ok").first()["n"] == 2
    assert spark.sql("select count(*) n from t_sentences").first()["n"] == 3
    assert read_book_metadata(spark, str(tmp_path), "en", glob="*.epub").count() == 1
    with pytest.raises(ValueError):
        read_books(spark, str(tmp_path), "nonsense")

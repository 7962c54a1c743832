"""Queries over files that are made from the benchmark's texts, a file an item, and read by `books_of`.

Each has templates, in which {n} stands for the item's n-th word, counted round; the item's number says
which template its file is made from. The SQL fills the words into what must come out.
"""

from __future__ import annotations

import base64
import io
import re
import warnings
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecrest.operators import codec
from pagecrest.queries import QUERIES, SQL, documents, query, quoted, table
from pagecrest.sources import archive
from pagecrest.sources.books import Books, books_of
from pagecrest.sources.events import Event
from pagecrest.sources.writing import CONTAINER

__all__ = ["QUERIES", "SQL"]

PLACE = re.compile(r"\{(b?)(\d+)\}")
Expected = dict[int, list[tuple]]


def filled(template: str, words: list[str]) -> str:
    """XML with the words in it, or their base64 where the place says b."""

    def word(m: re.Match) -> str:
        w = words[(int(m[2]) - 1) % len(words)]
        return base64.b64encode(w.encode()).decode() if m[1] else escape(w)

    return PLACE.sub(word, template)


def sql_text(template: str) -> str:
    parts = [quoted(x) if k % 3 == 0 else f"w[({x} - 1) % len(w) + 1]" for k, x in enumerate(PLACE.split(template)) if k % 3 != 1 and (x or k % 3)]
    return "(" + " || ".join(parts or ["''"]) + ")"


def sql_rows(cases: Expected, names: str) -> str:
    """What must come out: for each item the rows of its template. names: name and type, by commas."""
    columns = [n.split() for n in names.split(",")]
    cell = lambda x: "NULL" if x is None else sql_text(x) if isinstance(x, str) else str(x).lower()
    rows = ["SELECT item_id, " + ", ".join(f"{cell(x)}::{t} AS {quoted_name(n)}" for x, (n, t) in zip(r, columns)) + f" FROM s WHERE item_id % {len(cases)} = {k}" for k, found in cases.items() for r in found]
    return f"WITH s AS (SELECT item_id, regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark) {' UNION ALL '.join(rows)}"


def quoted_name(n: str) -> str:
    return f'"{n}"'


def files_of(spark: SparkSession, sf_dir: str, kinds: int, build: Callable[[int, list[str]], bytes | None], ending: Callable[[int], str] | str) -> DataFrame:
    """(path, content) of a file for each item: build has its kind and its words."""
    name = ending if callable(ending) else lambda k: f".{ending}"

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"{i}{name(i % kinds)}", build(i % kinds, t.split())) for i, t in zip(b["item_id"], b["text"])]
            yield pd.DataFrame({"path": [r[0] for r in rows], "content": pd.Series([r[1] for r in rows], dtype=object)})

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(made, "path string, content binary")


def item(column: str = "book_id"):
    return F.regexp_extract(column, r"^\d+", 0).cast("long").alias("item_id")


def blocks_and_chapters(books: Books) -> DataFrame:
    rows = books.persist().blocks().join(books.chapters(), ["book_id", "chapter_index"])
    return rows.select(item(), "chapter_index", "title", "level", "block_index", "kind", "text", "heading_level")


def zipped(entries: list[tuple[str, str | bytes]]) -> bytes:
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        warnings.simplefilter("ignore")  # some cases have a name twice
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def novel(body: str, head: str = "", rest: str = "") -> str:
    return f'<FictionBook xmlns:l="http://www.w3.org/1999/xlink"><description><title-info>{head}</title-info></description>{body}{rest}</FictionBook>'


def volume(documents: dict[str, str], items: str = "", spine: str | None = None, extra: list[tuple[str, str | bytes]] = (), guide: str = "", head: str = "", toc: str = "") -> bytes:
    """An EPUB whose package lies in content.opf; documents has bodies by path."""
    listed = "".join(f'<item id="x{k}" href="{p}" media-type="application/xhtml+xml"/>' for k, p in enumerate(documents))
    spine = spine if spine is not None else "".join(f'<itemref idref="x{k}"/>' for k in range(len(documents)))
    package = f"<package><metadata>{head}</metadata><manifest>{listed}{items}</manifest><spine{toc}>{spine}</spine>{guide}</package>"
    pages = [(p, f"<html><body>{body}</body></html>") for p, body in documents.items()]
    return zipped([("META-INF/container.xml", CONTAINER), ("content.opf", package), *pages, *extra])


# Which files are books

ARCHIVES: dict[int, tuple] = {
    0: ("EpubArchive", "", ["mimetype", "a.fb2"]), 1: ("EpubArchive", "", ["x/META-INF/container.xml"]), 2: ("WrappedBook", "a.fb2", ["a.fb2", "__MACOSX/b.fb2", ".c.fb2", "readme.txt"]),
    3: ("NoBookInside", "", ["readme.txt", "d/.fb2"]), 4: ("SeveralBooksInside", "a.FB2,b.epub", ["a.FB2", "d/b.epub"]), 5: ("WrappedBook", "f.Epub", ["d/e/f.Epub", "g/"]),
    6: ("NotAnArchive", "", "PK\x03\x04{1}"), 7: ("NotAnArchive", "", "{1} {2}"), 8: ("NotAnArchive", "", None),
}


@query(sql_rows({k: [(c[0], c[1])] for k, c in ARCHIVES.items()}, "outcome VARCHAR, names VARCHAR"))
def archive_classify(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes | None:
        what = ARCHIVES[kind][2]
        return what if what is None else filled(what, words).encode() if isinstance(what, str) else zipped([(n, " ".join(words)) for n in what])

    found = archive.inspected(files_of(spark, sf_dir, len(ARCHIVES), build, "zip"))
    return found.select(item("path"), "outcome", F.array_join("names", ",").alias("names"))


PAGE = "<body><section><p>{1}</p></section></body>"
#: Path's ending, how the bytes are made, format and status.
ROUTES: dict[int, tuple] = {
    0: (".bin", lambda f, e: f, "fb2", "ok"), 1: ("", lambda f, e: b"\xff\xfe" + f.decode().encode("utf-16-le"), "fb2", "ok"), 2: (".fb2", lambda f, e: e, "epub", "ok"),
    3: (".EPUB", lambda f, e: b"junk", "epub", "corrupt"), 4: (".Fb2", lambda f, e: b"junk", "fb2", "corrupt"), 5: (".txt", lambda f, e: b"junk", None, None), 6: (".zip", lambda f, e: zipped([("a.txt", f)]), None, None),
    7: (".zip", lambda f, e: b"PK\x03\x04junk", "epub", "corrupt"), 8: (".zip", lambda f, e: zipped([("d/a.FB2", f), ("__MACOSX/a.fb2", "x")]), "fb2", "ok"), 9: (".fb2.zip", lambda f, e: zipped([("b.epub", e)]), "epub", "ok"),
    10: (".zip", lambda f, e: zipped([("a.fb2", f), ("b.epub", e)]), None, None), 11: (".odt", lambda f, e: zipped([("mimetype", "x")]), "epub", "corrupt"), 12: (".epub", lambda f, e: f, "fb2", "ok"), 13: (".zip", lambda f, e: zipped([("a.epub", "junk")]), "epub", "corrupt"),
}


@query(sql_rows({k: [(r[2], r[3])] for k, r in ROUTES.items()}, "format VARCHAR, status VARCHAR"))
def format_detect(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes:
        return ROUTES[kind][1](filled(novel(PAGE), words).encode(), volume({"a.xhtml": filled("<p>{1}</p>", words)}))

    made = files_of(spark, sf_dir, len(ROUTES), build, lambda k: ROUTES[k][0])
    found = books_of(made, "en").persist().books().select(item(), "format", F.coalesce("failure.kind", F.lit("ok")).alias("status"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(found, "item_id", "left")


@query(sql_rows({0: [("ok", None)], 1: [("corrupt", "the file has no content")], 2: [("corrupt", "the file has 20000 bytes, more than are read")]}, "status VARCHAR, message VARCHAR"))
def unread_files(spark, sf_dir):
    page = lambda words: filled(novel(PAGE), words).encode()
    made = files_of(spark, sf_dir, 3, lambda k, words: [page(words), None, page(words).ljust(20_000)][k], "fb2")
    return books_of(made, "en", most_bytes=19_999).books().select(item(), F.coalesce("failure.kind", F.lit("ok")).alias("status"), "failure.message")


# Text out of bytes

CYRILLIC = ("aeionrtsATEO", "аеионртсАТЕО")
#: Letters that stand for others, mark before the bytes, declared name, codec of the bytes.
ENCODINGS: dict[int, tuple] = {
    0: (CYRILLIC, b"", "utf-8", "utf-8"), 1: (CYRILLIC, b"\xef\xbb\xbf", "UTF8", "utf-8"), 2: (CYRILLIC, b"\xff\xfe", "windows-1251", "utf-16-le"), 3: (CYRILLIC, b"\xfe\xff", "utf-8", "utf-16-be"),
    4: (CYRILLIC, b"", "Windows-1251", "cp1251"), 5: (CYRILLIC, b"", "koi8-r", "koi8-r"), 6: (CYRILLIC, b"", "utf-8", "cp1251"), 7: (CYRILLIC, b"", None, "koi8-r"), 8: (("aeo", "äéø"), b"", "iso-8859-1", "latin-1"),
    9: (("aeo", "€éš"), b"", "cp1252", "cp1252"), 10: (("aeo", "ąęő"), b"", "windows-1250", "cp1250"), 11: (("aeio", "аеїґ"), b"", "koi8u", "koi8-u"), 12: (CYRILLIC, b"", "us-ascii", "utf-8"), 13: (CYRILLIC, b"\n ", "x-cp1251", "cp1251"),
}
PLAIN = "trim(regexp_replace(text, '[^!-~]+', ' ', 'g'))"
SQL_SWAPPED = " ".join(f"WHEN {k} THEN translate(t, {quoted(e[0][0])}, {quoted(e[0][1])})" for k, e in ENCODINGS.items())


def plain(words: list[str]) -> str:
    return re.sub("[^!-~]+", " ", " ".join(words)).strip()


@query(f"SELECT item_id, CASE item_id % {len(ENCODINGS)} {SQL_SWAPPED} END AS text FROM (SELECT item_id, {PLAIN} AS t FROM benchmark)")
def encodings(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes:
        (letters, others), mark, declared, name = ENCODINGS[kind]
        text = plain(words).translate(str.maketrans(letters, others))
        prolog = f"<?xml version='1.0' encoding='{declared}'?>" if declared else ""
        return mark + (prolog + novel(f"<body><section><p>{escape(text)}</p></section></body>")).encode(name) + b"\x00" * (kind == 2)

    return books_of(files_of(spark, sf_dir, len(ENCODINGS), build, "fb2"), "en").blocks().select(item(), "text")


@query(f"""SELECT item_id, i::BIGINT AS block_index, CASE item_id % 3 WHEN 0 THEN t WHEN 1 THEN CASE WHEN i = 0 THEN '�' ELSE '' END || t ELSE replace(t, 'e', 'я') END AS text
    FROM (SELECT item_id, {PLAIN} AS t FROM benchmark), range(5) r(i)""")
def utf8_damage(spark, sf_dir):
    # A bad byte in a text is a mark of damage; where every e is one, the text was never UTF-8.
    def build(kind: int, words: list[str]) -> bytes:
        line = escape(plain(words)).encode()
        lines = [line.replace(b"&gt;", b">") if kind < 2 else line.replace(b"e", b"\xff")] * 5
        lines[0] = b"\xff" * (kind == 1) + lines[0]
        return novel("<body><section>{}</section></body>").encode().replace(b"{}", b"".join(b"<p>" + x + b"</p>" for x in lines))

    return books_of(files_of(spark, sf_dir, 3, build, "fb2"), "en").blocks().select(item(), "block_index", "text")


# FB2

FB2_SHAPE = (
    "<body><title><p>{1}</p><p>{2}</p></title><epigraph><p>{3} <strong>{4}</strong></p><text-author>{5}</text-author></epigraph>"
    "<section><title><p>{6}</p></title><p>{7}  {8}</p><subtitle>{9}</subtitle><empty-line/><poem><title><p>{10}</p></title><stanza><v>{11}</v><v> {12} </v></stanza></poem>"
    "<cite><p>{13}</p></cite><section><title>{14}</title><code>{15}</code></section><p>{16}</p></section><section><empty-line/></section>"
    "<section><table><tr><td>{17}</td><th> </th><th>{18}</th></tr><tr><td>{19}<table><tr><td>{20}</td></tr></table></td></tr></table><annotation><p>{21}</p></annotation><unknown>{22}</unknown></section></body>"
    '<body name="notes"><section><title><p>{23}</p></title><p>{24}</p></section></body>'
)
FB2_BLOCKS = [
    (0, "{1} {2}", 0, 0, "h", "{1} {2}", 1), (0, "{1} {2}", 0, 1, "p", "{3} {4}", None), (0, "{1} {2}", 0, 2, "p", "{5}", None),
    (1, "{6}", 0, 0, "h", "{6}", 1), (1, "{6}", 0, 1, "p", "{7} {8}", None), (1, "{6}", 0, 2, "h", "{9}", 2), (1, "{6}", 0, 3, "h", "{10}", 2), (1, "{6}", 0, 4, "p", "{11}\n{12}", None),
    (1, "{6}", 0, 5, "p", "{13}", None), (1, "{6}", 0, 6, "p", "{16}", None), (2, "{14}", 1, 0, "h", "{14}", 2), (2, "{14}", 1, 1, "p", "{15}", None),
    (3, None, 0, 0, "p", "{17} {18}", None), (3, None, 0, 1, "p", "{19}{20}", None), (3, None, 0, 2, "p", "{21}", None), (3, None, 0, 3, "p", "{22}", None), (4, "{23}", 0, 0, "h", "{23}", 1), (4, "{23}", 0, 1, "p", "{24}", None),
]
BLOCK_COLUMNS = "chapter_index BIGINT, title VARCHAR, level BIGINT, block_index BIGINT, kind VARCHAR, text VARCHAR, heading_level BIGINT"


@query(sql_rows({0: FB2_BLOCKS, 1: FB2_BLOCKS}, BLOCK_COLUMNS))
def fb2_structure(spark, sf_dir):
    # The second kind has a prefix before every name.
    prefixed = lambda xml: re.sub(r"<(/?)(?=\w)", r"<\1fb:", xml)
    made = files_of(spark, sf_dir, 2, lambda k, words: filled(prefixed(novel(FB2_SHAPE)) if k else novel(FB2_SHAPE), words).encode(), "fb2")
    return blocks_and_chapters(books_of(made, "en"))


BINARIES = (
    '<binary id="a" content-type="image/png">{b1}</binary><binary id="a" content-type="image/gif">{b2}</binary><binary id="b">\n {b3} \n</binary><binary id="c" content-type="image/png">*</binary>'
    '<binary xml:id="d">{b4}</binary><binary id="e" content-type="image/jpeg">{b5}</binary><binary id="f">{b6}</binary><binary id="g"/>'
)
FB2_PICTURES = "<body><section><p>{1}<image l:href='#f'/></p>" + "".join(f'<image l:href="{h}"/>' for h in ("#a", "#b", "#c", "#d", "a", "#z", "#g", "")) + "<p>{2}</p></section></body>"


@query(sql_rows({0: [("p", "{1}", None, None), ("img", None, "a", "image/png {1}"), ("img", None, "b", "application/octet-stream {3}"), ("p", "{2}", None, None), ("cover", None, "e", "image/jpeg {5}")]}, "kind VARCHAR, text VARCHAR, image_id VARCHAR, image VARCHAR"))
def fb2_images(spark, sf_dir):
    book = novel(FB2_PICTURES, '<coverpage><image l:href="#e"/></coverpage>', BINARIES)
    books = books_of(files_of(spark, sf_dir, 1, lambda k, words: filled(book, words).encode(), "fb2"), "en").persist()
    images = books.images().select("book_id", "image_id", F.concat_ws(" ", "media_type", F.decode("bytes", "UTF-8")).alias("image"))
    cover = books.books().select("book_id", F.lit("cover").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("metadata.cover_image_id").alias("image_id"))
    rows = books.blocks().select("book_id", "kind", "text", "image_id").unionByName(cover)
    return rows.join(images, ["book_id", "image_id"], "left").select(item(), "kind", "text", "image_id", "image")


AUTHORS: dict[int, tuple] = {
    0: ("<author><first-name>{1}</first-name><middle-name> {2} </middle-name><last-name>{3}</last-name><nickname>{4}</nickname></author><book-title> {5}\n{6} </book-title><lang>fre-CA</lang>", "{1} {2} {3}", "{5} {6}", "fr"),
    1: ("<author><first-name> </first-name><nickname>{4}</nickname></author><author/><author><last-name>{1}</last-name></author><lang>el</lang><lang>de</lang>", "{4},{1}", None, "el"),
    2: ("<book-title>{1}</book-title><book-title>{2}</book-title><lang>zz</lang>", "", "{1}", "en"),
}


@query(sql_rows({k: [(*a[1:], True)] for k, a in AUTHORS.items()}, "authors VARCHAR, title VARCHAR, lang VARCHAR, same BOOLEAN"))
def author_names(spark, sf_dir):
    made = files_of(spark, sf_dir, len(AUTHORS), lambda k, words: filled(novel(PAGE, AUTHORS[k][0]), words).encode(), "fb2").persist()
    full, cheap = (books_of(made, "en", metadata_only=m).books().select("book_id", F.col("metadata").alias(n)) for m, n in ((False, "m"), (True, "c")))
    return full.join(cheap, "book_id").select(item(), F.array_join("m.authors", ",").alias("authors"), "m.title", F.col("m.source_language_code").alias("lang"), F.col("m").eqNullSafe(F.col("c")).alias("same"))


# EPUB

TWO = {"a.xhtml": "<p>{1}</p>", "b.xhtml": '<p id="s">{2}</p>'}
NAV = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="x nav"/>'
NCX = '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'


def nav(body: str) -> tuple[str, str]:
    return "nav.xhtml", f"<html><body>{body}</body></html>"


def point(label: str, src: str, below: str = "") -> str:
    return f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{src}"/>{below}</navPoint>'


def ncx(points: str) -> tuple[str, str]:
    return "toc.ncx", f"<ncx><navMap>{points}</navMap></ncx>"


#: Manifest items, files, the rest of the package, and what must come out: title and level.
CONTENTS: dict[int, tuple] = {
    0: (NAV, [nav('<nav epub:type="toc"><h1>x</h1><ol><li><a href="a.xhtml">{1}  {2}</a><ol><li><span>{3}</span></li><li><a href="b.xhtml#s">{4}</a></li></ol></li></ol></nav>')], {}, [("{1} {2}", 0), ("{4}", 1)]),
    1: (NAV, [nav('<nav><ol><li><a href="b.xhtml">{1}</a></li></ol></nav><nav role="x doc-toc"><ol><li><a href="a.xhtml">{3}</a></li></ol></nav>')], {}, [("{3}", 0), (None, 0)]),
    2: (NAV + NCX, [nav("<nav></nav>"), ncx(point("{1}", "a.xhtml"))], {"toc": ' toc="ncx"'}, [(None, 0), (None, 0)]),
    3: (NCX, [ncx(point("{1}", "a.xhtml") + point("{2}", "", point("{3}", "b.xhtml")))], {}, [("{1}", 0), ("{3}", 1)]),
    4: (NCX, [("toc.ncx", "<ncx><navMap>")], {"toc": ' toc="ncx"'}, [(None, 0), (None, 0)]),
    5: (NAV, [nav('<nav epub:type="toc"><ol><li><a href="a.xhtml">{1}</a></li></ol></nav><nav epub:type="landmarks"><ol><li><a epub:type="toc" href="b.xhtml#x">{2}</a></li></ol></nav>')], {}, [("{1}", 0)]),
    6: (NCX, [ncx(point("{1}", "b.xhtml"))], {"guide": '<guide><reference type="TOC" href="a.xhtml"/></guide>'}, [("{1}", 0)]),
    7: (NAV, [nav('<nav><ol><li><a href="gone.xhtml">{1}</a></li><li><a href="b.xhtml#s">{2}</a></li></ol></nav>')], {"spine": '<itemref idref="x0"/><itemref idref="nav"/><itemref idref="x1"/><itemref idref="none"/>'}, [(None, 0), ("{2}", 0)]),
}


@query(sql_rows({k: [(i, *r) for i, r in enumerate(c[3])] for k, c in CONTENTS.items()}, "chapter_index BIGINT, title VARCHAR, level BIGINT"))
def epub_navigation(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes:
        items, files, rest, _ = CONTENTS[kind]
        return volume({p: filled(b, words) for p, b in TWO.items()}, items, extra=[(n, filled(x, words)) for n, x in files], **rest)

    return books_of(files_of(spark, sf_dir, len(CONTENTS), build, "epub"), "en").persist().chapters().select(item(), "chapter_index", "title", "level")


#: Body, and what must come out: kind, text and heading level.
BODIES: dict[int, tuple] = {
    0: ("<p>{1}<br/> {2}</p><h2>{3}<br>{4}</h2><p><br></p>", [("p", "{1}\n{2}", None), ("h", "{3} {4}", 2)]),
    1: ("<table><caption>{1}</caption><thead><tr><th>{2}</th><th>{3}</th></tr></thead><tr><td>{4}<td> <td>{5}</table>", [("p", "{1}", None), ("p", "{2} {3}", None), ("p", "{4} {5}", None)]),
    2: ("<p><ruby>{1}<rp>(</rp><rt>{2}</rt></ruby></p><script>{3}</script><style/><title/><p>{4}</p><textarea/><p>{5}</p>", [("p", "{1}", None), ("p", "{4}", None), ("p", "{5}", None)]),
    3: ('<p>{1}<img src="i.png"/>{2}</p><svg><text>{3}</text><image xlink:href="i.png"/></svg><p><b><svg><text>{4}</text></svg></b></p>', [("p", "{1}", None), ("img", None, None), ("p", "{2}", None), ("img", None, None), ("p", "{4}", None)]),
    4: ("<b>{1}<p>{2}</p>{3}</b><hr/>{4}", [("p", "{1}", None), ("p", "{2}", None), ("p", "{3}", None), ("p", "{4}", None)]),
    5: ("<ul><li>{1}<li>{2}<ul><li>{3}</ul>{4}</ul><p><i>{5}<p>{6}</i> {7}</p>", [("p", "{1}", None), ("p", "{2}", None), ("p", "{3}", None), ("p", "{4}", None), ("p", "{5}", None), ("p", "{6} {7}", None)]),
    6: ("<table>{1}<tr><td>{2}</td></tr><p>{3}</p></table>{4}", [("p", "{1}", None), ("p", "{3}", None), ("p", "{2}", None), ("p", "{4}", None)]),
    7: ("<div><p>{1}<span>{2}<div>{3}</span>{4}</div></div>", [("p", "{1}{2}", None), ("p", "{3}{4}", None)]),
    8: ("<h1>{1}<img src='i.png'></h1><h3> </h3><dl><dt>{2}<dd>{3}</dl><blockquote>{4}<p>{5}</blockquote>", [("h", "{1}", 1), ("p", "{2}", None), ("p", "{3}", None), ("p", "{4}", None), ("p", "{5}", None)]),
}


@query(sql_rows({k: [(i, *r) for i, r in enumerate(b[1])] for k, b in BODIES.items()}, "block_index BIGINT, kind VARCHAR, text VARCHAR, heading_level BIGINT"))
def xhtml_rules(spark, sf_dir):
    made = files_of(spark, sf_dir, len(BODIES), lambda k, words: volume({"a.xhtml": filled(BODIES[k][0], words)}, extra=[("i.png", "x")]), "epub")
    return books_of(made, "en").persist().blocks().select(item(), "block_index", "kind", "text", "heading_level")


PICTURES = '<p>{1}</p><img src="../i/a.png"/><img src="b%20c.JPG#x"/><img src="none.png"/><img src=""/><p>{2}<image href="../i/d"/></p><img src="e.webp"/>'
PICTURE_ITEMS = '<item id="p0" href="i/a.png" media-type=""/><item id="p1" href="i/a.png" media-type="image/x-own"/><item id="p2" href="./i/../i/a.png" media-type="image/png"/>'


@query(sql_rows({0: [("i/a.png", "image/x-own {3}"), ("t/b c.JPG", "image/jpeg {4}"), ("i/d", "application/octet-stream {5}"), ("t/e.webp", "image/webp {6}")]}, "image_id VARCHAR, image VARCHAR"))
def epub_images(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes:
        files = [(n, words[k % len(words)]) for n, k in (("i/a.png", 2), ("t/b c.JPG", 3), ("i/d", 4), ("t/e.webp", 5))]
        return volume({"t/a.xhtml": filled(PICTURES, words)}, PICTURE_ITEMS, extra=files)

    books = books_of(files_of(spark, sf_dir, 1, build, "epub"), "en").persist()
    named = books.blocks().where("kind = 'img'").select("book_id", "image_id")
    return named.join(books.images(), ["book_id", "image_id"]).select(item(), "image_id", F.concat_ws(" ", "media_type", F.decode("bytes", "UTF-8")).alias("image"))


PATHS = {"t%20x/a.xhtml": "O/t x/a.xhtml", "./b/../c.xhtml": "O/c.xhtml", "d%2Fe.xhtml": "O/d%2Fe.xhtml", "/f.xhtml": "f.xhtml", "100%.xhtml": "O/100%.xhtml", "%C3%A9.xhtml": "O/é.xhtml"}


@query(sql_rows({0: [(k, f"{{{k + 1}}}") for k in range(len(PATHS))]}, "chapter_index BIGINT, text VARCHAR"))
def epub_paths(spark, sf_dir):
    def build(kind: int, words: list[str]) -> bytes:
        listed = "".join(f'<item id="x{k}" href="{h}" media-type="application/xhtml+xml"/>' for k, h in enumerate(PATHS))
        refs = "".join(f'<itemref idref="x{k}"/>' for k in range(len(PATHS)))
        package = f"<package><manifest>{listed}</manifest><spine>{refs}</spine></package>"
        pages = [(p, filled(f"<body>{{{k + 1}}}</body>", words)) for k, p in enumerate(PATHS.values())]
        return zipped([("META-INF/container.xml", CONTAINER.replace("content.opf", "O/content.opf")), ("O/content.opf", package), *pages])

    return books_of(files_of(spark, sf_dir, 1, build, "epub"), "en").persist().blocks().select(item(), "chapter_index", "text")


SOUND = volume({"a.xhtml": "<p>x</p>"})
#: Bytes of a book, and its status.
DAMAGE: dict[int, tuple] = {
    0: (SOUND, "ok"), 1: (zipped([("mimetype", "x"), ("content.opf", "<package/>")]), "corrupt"), 2: (zipped([("META-INF/container.xml", "<container><rootfiles/></container>")]), "corrupt"),
    3: (zipped([("META-INF/container.xml", CONTAINER)]), "corrupt"), 4: (zipped([("META-INF/container.xml", CONTAINER), ("content.opf", "<package>")]), "corrupt"), 5: (volume({"a.xhtml": "<hr/> <p></p>"}), "emptyDocument"),
    6: (volume({"a.xhtml": "<img src='i.png'/>"}, extra=[("i.png", "x")]), "ok"), 7: (SOUND[: len(SOUND) // 2], "corrupt"), 8: (volume({"a.xhtml": "<p>x</p>"}, extra=[("META-INF/rights.xml", "x")]), "drmProtected"),
    9: (volume({}), "emptyDocument"), 10: (volume({"a.xhtml": "<div>" * 3000 + "x"}), "ok"), 11: (zipped([("META-INF/container.xml", "<container"), ("content.opf", "<package/>")]), "corrupt"),
}


@query(sql_rows({k: [(d[1],)] for k, d in DAMAGE.items()}, "status VARCHAR"))
def epub_failures(spark, sf_dir):
    found = books_of(files_of(spark, sf_dir, len(DAMAGE), lambda k, words: DAMAGE[k][0], "epub"), "en").persist().books()
    return found.select(item(), F.coalesce("failure.kind", F.lit("ok")).alias("status"))


@query(sql_rows({0: [("META-INF/container.xml", "{2}"), ("content.opf", "{2}"), ("c.png", "{2}")]}, "entry VARCHAR, title VARCHAR"))
def epub_entries_read(spark, sf_dir):
    # The last of two entries of a name counts, and the metadata path reads three entries only.
    package = '<package><metadata><title>{2}</title></metadata><manifest><item id="c" href="c.png" properties="cover-image"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>'
    files = [("content.opf", "<package><metadata><title>{1}</title></metadata></package>"), ("META-INF/container.xml", CONTAINER), ("./content.opf", package), ("c.png", "x"), ("a.xhtml", "<p>{3}</p>")]
    made = files_of(spark, sf_dir, 1, lambda k, words: zipped([(n, filled(x, words)) for n, x in files]), "epub")
    events = books_of(made, "en", metadata_only=True).persist().events
    return events.where("kind = 'entry'").select("book_id", F.col("name").alias("entry")).join(events.where("kind = 'meta'").select("book_id", F.col("text").alias("title")), "book_id").select(item(), "entry", "title")


# What callers may bring


def by_commas(text, lang):
    """A segmenter of a caller: pieces between commas, with the language in front."""
    return F.transform(F.split(text, ","), lambda x: F.struct(F.concat(lang, F.lit(":"), x).alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")))


def by_colon(text, lang):
    return F.transform(F.split(text, ":"), lambda x, i: F.struct(x.alias("text"), i.alias("start"), (i + 1).alias("end")))


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT item_id, unnest(range(len(l)))::BIGINT AS sentence_index, 'el:' || unnest(l) AS x FROM (SELECT item_id, string_split({FLAT}, ',') AS l FROM benchmark))
    SELECT item_id, sentence_index, unnest(range(len(g)))::BIGINT AS word_index, unnest(g) AS text, unnest(range(len(g)))::BIGINT AS start_at FROM (SELECT *, string_split(x, ':') AS g FROM p)""")
def custom_segmenters(spark, sf_dir):
    book = novel("<body><section><p>{}</p></section></body>", "<lang>el</lang>")
    made = files_of(spark, sf_dir, 1, lambda k, words: book.replace("{}", escape(" ".join(words))).encode(), "fb2")
    rows = books_of(made, "en").persist().words(segmenter=by_commas, word_segmenter=by_colon)
    return rows.select(item(), "sentence_index", "word_index", "text", F.col("start").alias("start_at"))


def text_file(data: bytes) -> Iterator[Event]:
    """A parser of a caller: a line is a paragraph, a book a chapter."""
    lines = data.decode().split("\n")
    yield Event("meta", text=lines[0], name="de", authors=[])
    yield Event("chapter", pos=0, text=lines[0], level=0)
    for k, line in enumerate(lines):
        yield Event("block", sub="p", pos=0, idx=k, text=line)


@query("""SELECT item_id, 'txt' AS format, 'de' AS lang, (i - 1)::BIGINT AS block_index, l[i] AS text FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS l, unnest(range(1, len(l) + 1)) AS i FROM benchmark)""")
def custom_parser(spark, sf_dir):
    made = files_of(spark, sf_dir, 1, lambda k, words: "\n".join(words).encode(), "TXT")
    books = books_of(made, "en", parsers={"txt": text_file}).persist()
    found = books.books().where("ok").select("book_id", "format", F.col("metadata.source_language_code").alias("lang"))
    return books.blocks().join(found, "book_id").select(item(), "format", "lang", "block_index", "text")


# Single blocks as JSON


@query("""SELECT conv_id::VARCHAR AS book_id, (turn // 4)::BIGINT AS chapter_index, (turn % 4)::BIGINT AS block_index, 1::BIGINT AS version, CASE WHEN turn % 3 = 2 THEN 'img' WHEN role = 'user' THEN 'h' ELSE 'p' END AS kind,
    CASE WHEN turn % 3 <> 2 THEN text END AS text, CASE WHEN turn % 3 <> 2 AND role = 'user' THEN 1::BIGINT END AS heading_level, CASE WHEN turn % 3 = 2 THEN 'pic' || turn END AS ref FROM conversations""")
def block_codec(spark, sf_dir):
    _, _, blocks, _ = documents(spark, sf_dir)
    made = codec.encode_block(F.col("kind"), F.col("text"), F.col("heading_level"), F.col("image_id"), F.lit("image/png"))
    rows = blocks.select("book_id", "chapter_index", "block_index", made.alias("json")).withColumn("b", codec.decode_block(F.col("json")))
    return rows.select("book_id", "chapter_index", "block_index", F.get_json_object("json", "$.v").cast("long").alias("version"), "b.kind", "b.text", "b.heading_level", "b.ref")

"""Books out of tables: small EPUB and FB2 files, as a sink and as input for tests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">'
    '<rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def lines_as_xml(text: str, tag: str = "p") -> str:
    return "".join(f"<{tag}>{escape(x)}</{tag}>" for x in text.split("\n") if x.strip())


def epub_bytes(title: str, lang: str, authors: Iterable[str], parts: list[tuple[str | None, int, str, str]]) -> bytes:
    """parts: (title in the table of contents or None, depth, heading, text); one document each."""
    items = "".join(f'<item id="d{i}" href="t/{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(parts)))
    refs = "".join(f'<itemref idref="d{i}"/>' for i in range(len(parts)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr("META-INF/container.xml", CONTAINER)
        makers = "".join(f"<dc:creator>{escape(a)}</dc:creator>" for a in authors)
        z.writestr("content.opf", (
            '<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
            f"<dc:title>{escape(title)}</dc:title>{makers}<dc:language>{escape(lang)}</dc:language></metadata>"
            f'<manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{refs}</spine></package>'
        ))
        points, open_points = "", 0
        for i, (label, depth, _, _) in enumerate(parts):
            if label is None:
                continue
            while open_points > depth:
                points, open_points = points + "</navPoint>", open_points - 1
            points += f"<navPoint><navLabel><text>{escape(label)}</text></navLabel><content src={quoteattr(f't/{i}.xhtml')}/>"
            open_points += 1
        z.writestr("toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}{"</navPoint>" * open_points}</navMap></ncx>')
        for i, (_, _, heading, text) in enumerate(parts):
            z.writestr(f"t/{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title/></head><body><h2>{escape(heading)}</h2>{lines_as_xml(text)}</body></html>')
    return out.getvalue()


def fb2_bytes(title: str, lang: str, authors: Iterable[str], parts: list[tuple[str | None, int, str, str]]) -> bytes:
    """The same book as sections; depth is the nesting of a section in the one before it."""
    body, at = "", 0
    for label, depth, heading, text in parts:
        depth = min(depth, at)
        body += "</section>" * (at - depth)
        named = f"<title><p>{escape(label)}</p></title>" if label is not None else ""
        body += f"<section>{named}<subtitle>{escape(heading)}</subtitle>{lines_as_xml(text)}"
        at = depth + 1
    makers = "".join(f"<author><nickname>{escape(a)}</nickname></author>" for a in authors)
    return (
        '<?xml version="1.0" encoding="utf-8"?><FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0"><description><title-info>'
        f"{makers}<book-title>{escape(title)}</book-title><lang>{escape(lang)}</lang></title-info></description><body>{body}{'</section>' * at}</body></FictionBook>"
    ).encode()


WRITERS = {"epub": epub_bytes, "fb2": fb2_bytes}


def as_files(parts: DataFrame, fmt: str, lang: str = "en") -> DataFrame:
    """(path, content) of a file for each book of parts (book_id, seq, label, depth, heading, text)."""

    def write(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("seq")
        rows = [(None if pd.isna(x.label) else x.label, int(x.depth), x.heading, "" if pd.isna(x.text) else x.text) for x in book.itertuples()]
        name = str(book["book_id"].iloc[0])
        return pd.DataFrame({"path": [f"{name}.{fmt}"], "content": [WRITERS[fmt](f"Book {name}", lang, [f"Writer {name}"], rows)]})

    return parts.groupBy("book_id").applyInPandas(write, "path string, content binary")

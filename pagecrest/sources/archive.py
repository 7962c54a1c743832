"""What a file is: archive inspection and format routing."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Extensions of books, and of files worth importing.
BOOK_EXTENSIONS = ("epub", "fb2")
IMPORT_EXTENSIONS = (*BOOK_EXTENSIONS, "zip")
#: The same as a glob, in any letter case, for read_books(glob=...).
IMPORT_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in IMPORT_EXTENSIONS) + "}"
ZIP_MAGIC = b"PK\x03\x04"
OUTCOMES = ("NotAnArchive", "EpubArchive", "WrappedBook", "NoBookInside", "SeveralBooksInside")


def is_book_name(name: str) -> bool:
    base = posixpath.basename(name)
    return not name.startswith("__MACOSX/") and not base.startswith(".") and posixpath.splitext(base)[1][1:].lower() in BOOK_EXTENSIONS


def inspect(data: bytes) -> tuple[str, list[str], bytes | None]:
    """Outcome, base names of the books inside, and the bytes of the one book if there is one."""
    if data[:4] != ZIP_MAGIC:
        return "NotAnArchive", [], None
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        files = [i for i in archive.infolist() if not i.is_dir()]
        if any(i.filename == "mimetype" or i.filename.endswith("META-INF/container.xml") for i in files):
            return "EpubArchive", [], None
        books = [i for i in files if is_book_name(i.filename)]
        names = [posixpath.basename(i.filename) for i in books]
        if len(books) == 1:
            return "WrappedBook", names, archive.read(books[0])
        return ("SeveralBooksInside" if books else "NoBookInside"), names, None
    except Exception:  # an archive that cannot be listed is no archive
        return "NotAnArchive", [], None


def plain_format(path: str, data: bytes) -> str | None:
    if data[:4] == ZIP_MAGIC:
        return "epub"
    if b"<fictionbook" in data[:512].replace(b"\0", b"").lower():
        return "fb2"
    ending = posixpath.splitext(path)[1][1:].lower()
    return ending if ending in BOOK_EXTENSIONS else None


def route(path: str, data: bytes) -> tuple[str | None, bytes]:
    """Format of a file, or None if it is no book, and the bytes to parse: a book alone in a zip is
    taken out of it once."""
    outcome, names, inner = inspect(data)
    if outcome == "EpubArchive":
        return "epub", data
    if outcome == "WrappedBook":
        return plain_format(names[0], inner), inner
    if outcome in ("NoBookInside", "SeveralBooksInside"):
        return None, data
    return plain_format(path, data), data


def inspected(files: DataFrame) -> DataFrame:
    """(path, outcome, names) of files (path, content): what each archive is, and the base names of the
    books inside. A null content is no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file's bytes at a time
                outcome, names, _ = inspect(batch.column(1)[k].as_py() or b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([outcome]), pa.array([names], pa.list_(pa.string()))], ["path", "outcome", "names"])

    return files.select("path", "content").mapInArrow(run, "path string, outcome string, names array<string>")

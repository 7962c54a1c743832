"""The data source, the stream, and paths and encodings by example."""

import pytest

from builders import epub, fb2, zipped
from pagecrest.sources import archive, encoding
from pagecrest.sources.books import Books, read_files
from pagecrest.sources.datasource import register
from pagecrest.sources.epub import decode_full, resolve, split_fragment
from pagecrest.streaming.imports import import_folder


def test_data_source(spark, tmp_path):
    (tmp_path / "a.fb2").write_bytes(fb2())
    (tmp_path / "b.zip").write_bytes(zipped({"b.fb2": fb2()}))
    register(spark)
    events = spark.read.format("ebook").option("filesPerTask", "1").load(str(tmp_path))
    assert events.rdd.getNumPartitions() == 2
    assert Books(events, "en").blocks().count() == 4
    cheap = spark.read.format("ebook").option("metadataOnly", "true").option("pathGlobFilter", "*.fb2").load(str(tmp_path))
    assert [r["kind"] for r in cheap.collect()] == ["meta"]


def test_stream_imports_each_file_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.fb2").write_bytes(fb2())
    import_folder(spark, str(folder), out, check, "en").awaitTermination()
    (folder / "b.epub").write_bytes(epub([("a.xhtml", "<p>x</p>")]))
    import_folder(spark, str(folder), out, check, "en").awaitTermination()
    assert spark.read.parquet(f"{out}/books").where("ok").count() == 2
    assert spark.read.parquet(f"{out}/blocks").count() == 3


def test_paths():
    assert resolve("OEBPS/text", "../img/a%20b.png") == "OEBPS/img/a b.png"
    assert resolve("", "/a/./b/../c.xhtml") == "a/c.xhtml"
    assert decode_full("a%2Fb%C3%A9%23") == "a%2Fbé%23"
    assert decode_full("100%") == "100%" and decode_full("%FF") == "%FF"
    assert split_fragment("a#b#c") == ("a", "b#c") and split_fragment("a") == ("a", None) and split_fragment("a#") == ("a", "")


@pytest.mark.parametrize("head,want", [
    ('<?xml version="1.0" encoding="Windows-1251"?>', "windows-1251"), ("﻿ <?xml encoding='KOI8-R'?>", "koi8-r"),
    ('<?xmlx encoding="a"?>', None), ('<a encoding="b"/>', None), ("", None),
])
def test_declared_encoding(head, want):
    assert encoding.declared_encoding(head.encode()) == want


def test_unknown_encoding_is_a_failure():
    with pytest.raises(encoding.UnsupportedEncoding):
        encoding.decode_fb2(b'<?xml version="1.0" encoding="utf-16"?><a/>')


def test_routing():
    book = fb2()
    assert archive.route("x.bin", book)[0] == "fb2" and archive.route("x.fb2", b"junk")[0] == "fb2" and archive.route("x.txt", b"junk")[0] is None
    assert archive.route("x", epub([("a.xhtml", "")]))[0] == "epub"
    assert archive.route("x.zip", zipped({"d/a.fb2": book, ".b.fb2": b""})) == ("fb2", book)
    assert archive.inspect(zipped({"a.fb2": b"", "d/b.epub": b""}))[:2] == ("SeveralBooksInside", ["a.fb2", "b.epub"])
    assert archive.inspect(zipped({"a.txt": b""}))[0] == "NoBookInside"
    assert archive.inspect(b"PK\x03\x04junk")[0] == "NotAnArchive" and archive.route("x.zip", b"PK\x03\x04junk")[0] == "epub"


def test_import_glob(spark, tmp_path):
    for name in ("a.EPUB", "b.fb2", "c.Zip", "d.txt", "zip"):
        (tmp_path / name).write_bytes(fb2())
    found = read_files(spark, str(tmp_path), archive.IMPORT_GLOB).select("path").collect()
    assert {r["path"].rpartition("/")[2] for r in found} == {"a.EPUB", "b.fb2", "c.Zip"}


def test_example(spark, tmp_path, capsys):
    import runpy

    (tmp_path / "a.fb2").write_bytes(fb2())
    main = runpy.run_path("examples/open_books.py")["main"]
    main(str(tmp_path))
    assert "Hills" in capsys.readouterr().out

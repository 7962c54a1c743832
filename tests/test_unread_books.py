"""Files whose bytes are missing or too many are failures, not lost."""

import pytest

from builders import epub, fb2
from pagecrest.sources import books


@pytest.mark.parametrize("metadata_only", [False, True])
def test_large_and_null_files_are_failures(spark, metadata_only):
    small = fb2()
    large = fb2().replace(b"A short line.", b"Text of one, and more of it than the bound lets in.")
    packed = epub([("a.xhtml", "<p>x</p>")], files={"pad.txt": "".join(f"{k * 7919 % 10007} " for k in range(9000))})
    assert len(large) > len(small) < len(packed)
    files = [("small.fb2", bytearray(small)), ("large.fb2", bytearray(large)), ("large.epub", bytearray(packed)), ("null.fb2", None)]
    got = books.books_of(spark.createDataFrame(files, "path string, content binary"), "en", metadata_only, most_bytes=len(small)).books().collect()
    assert {r["book_id"]: r["ok"] or r["failure"]["kind"] for r in got} == {"small.fb2": True, "large.fb2": "corrupt", "large.epub": "corrupt", "null.fb2": "corrupt"}
    assert len(got) == 4


def test_large_files_are_not_read(spark, tmp_path):
    small = fb2()
    (tmp_path / "small.fb2").write_bytes(small)
    (tmp_path / "large.fb2").write_bytes(small + b" " * 100)
    files = books.read_files(spark, str(tmp_path), most_bytes=len(small))
    assert {r["path"].rpartition("/")[2]: r["content"] is None for r in files.collect()} == {"small.fb2": False, "large.fb2": True}
    assert "LessThanOrEqual(length," in files._jdf.queryExecution().executedPlan().toString()
    got = books.read_books(spark, str(tmp_path), "en", most_bytes=len(small)).books().collect()
    assert {r["book_id"].rpartition("/")[2]: r["ok"] for r in got} == {"small.fb2": True, "large.fb2": False}
    assert books.read_book_metadata(spark, str(tmp_path), "en", most_bytes=len(small)).where("not ok").count() == 1

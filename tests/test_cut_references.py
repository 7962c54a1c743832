"""Pages whose references were cut short, and references that are none."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagecrest import queries
from pagecrest.sources.xhtml import blocks_of

CUTS = ["The&a", "der&&am", "and&&&amp", "x &quo", "y &quot", "AT&T R&D; a&b", "&ampx; &copyx &notit;", "&# 1; a", "&#x; b", "&&amp;&amp;lt;", "&"]
PAGE = "<html><head><title>{0}</title></head><body><!-- {0} --><h1>{0}</h1><p>before {0}<br>after</p><div>{0} &copy; &middot; &quot;</div><p>last {0}</body></html>"


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    pq.write_table(pa.table({"page_id": list(range(len(CUTS))), "url": [""] * len(CUTS), "html": [PAGE.format(x) for x in CUTS]}), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["xhtml_headings", "xhtml_title_skipped", "xhtml_blocks"])
def test_query(spark, pages, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages}/pages.parquet')")
    df, rel = queries.QUERIES[name](spark, pages), con.sql(queries.SQL[name])
    assert Counter(map(tuple, df.select(*rel.columns).collect())) == Counter(rel.fetchall())


@pytest.mark.parametrize("html,want", [
    ("<p>The&a</p><p>AT&T</p><p>&amp &ampz &lt;</p>", ["The&a", "AT&T", "& &z <"]), ("<p>a &# b</p><p>c</p>", ["a &# b", "c"]),
    ("<p>a &#12ab</p><p>c</p>", ["a ab", "c"]), ("<p>x &a", ["x &a"]), ("<table>a&nbsp;b<tr><td>c</table>", ["a b", "c"]),
])
def test_books_read_references_as_html_does(html, want):
    assert [b.text for b in blocks_of(html).blocks] == want

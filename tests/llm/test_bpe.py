"""Prefix counts against the tokenizers library."""

import random

import duckdb
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from pagecrest.llm.bpe import Bpe

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\n\n\n b ", "\t x y", "it's we're they'll I'd 'tis !'re", "x  y", "\x1cq\x1f r", "déjà vu 12 3,4", "日本語 テスト", "😀😀 ok", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "a<|endof", "\r\n\r\nz", "aaaaaaaaaaaaaaaaaaaaaaaa" * 9, "     " * 7 + "end"]


@pytest.fixture(scope="module")
def both():
    return Bpe(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    bits = ODD + [" ", "\n", "'", "re", "ll", "the", "ing", " x", "9", "é", "　", "--"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300)]


def test_counts_and_ids(both):
    bpe, lib = both
    docs = [r[0] for r in duckdb.sql("select text from read_parquet('/root/testdata/sf0.001/documents.parquet')").fetchall()]
    for t in texts() + docs:
        want = lib.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t).tolist() == want, t
        assert bpe.count(t) == len(want), t


def test_every_prefix(both):
    bpe, lib = both
    for t in texts()[:150]:
        table = bpe.prefix_table(t)
        assert len(table) == len(t.encode()) + 1
        at = 0
        for i in range(len(t) + 1):
            assert table[at] == len(lib.encode(t[:i], add_special_tokens=False).ids), (t, i)
            at += len(t[i : i + 1].encode())


def test_truncate(both):
    bpe, lib = both
    for t in texts()[:80]:
        for budget in (0, 1, 5):
            got = bpe.truncate(t, budget)
            best = max(i for i in range(len(t) + 1) if len(lib.encode(t[:i], add_special_tokens=False).ids) <= budget)
            assert got == t[:best]


def test_columns(messy, none):
    from pyspark.sql import functions as F

    from pagecrest.llm import bpe

    lib = Tokenizer.from_file(PATH)
    out = bpe.truncated(bpe.with_token_counts(messy, PATH), PATH, 5)
    assert out.columns == [*messy.columns, "n_tokens", "truncated"]
    for r in out.collect():
        text = r["text"]
        assert r["n_tokens"] == len(lib.encode(text or "", add_special_tokens=False).ids)
        assert (r["truncated"] is None) == (text is None)
        assert text is None or text.startswith(r["truncated"])
    short = messy.where(F.length("text") < 60)
    for r in bpe.prefix_tables(short, PATH).collect():
        assert r["prefix_tokens"][-1] == len(lib.encode(r["text"], add_special_tokens=False).ids)
    assert bpe.with_token_counts(none, PATH).count() == 0

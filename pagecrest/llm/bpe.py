"""Byte-level BPE from a tokenizer file, with exact token counts of every prefix of a text.

Prefix dynamic programming: the encoding of a prefix ends in exactly one token that agrees with the
encoding of what stands before it, so the count at each byte is one more than the count where that
token starts. Two tokens agree if encoding their joined bytes gives the two back. Counts of a text
add up over its pre-tokens; where a prefix ends inside white space or a contraction the
pre-tokenizer would cut it otherwise than the whole text, and its count follows that.

Memory: pre-tokens' counts are kept in a cache of bounded size, texts are taken one at a time, and
a text's table has one number for each of its bytes.

Defined results: null and empty texts have no tokens; the strings of special tokens inside texts
are special tokens, as the library does by default; equal rows give equal results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: cuts of contractions of three bytes, which are two pre-tokens without the last.
CUT_CONTRACTIONS = {b"'r", b"'v", b"'l"}
#: White space next to white space or at a text's ends, or other than space and line feed.
UNEVEN = re.compile(r"[^\S \n]|\s\s|\s\Z|\A\s")
CACHE = 500_000


def _byte_of_char() -> dict[str, int]:
    """The files write each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    """Tokenizer of a .json file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, char = data["model"], _byte_of_char()
        special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.special = special
        self.split_special = re.compile("|".join(map(re.escape, special))) if special else None
        self.engine = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.longest = max(map(len, self.ranks))
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.agreed: dict[int, bool] = {}
        self.totals: dict[str, int] = {}

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Runs of ordinary text, each with the id of the special token after it."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizers library gives them without added tokens."""
        parts = []
        for run, special in self.segments(text):
            parts.append(np.array(self.engine.encode_ordinary(run), np.uint32))
            if special is not None:
                parts.append(np.array([special], np.uint32))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain BPE of a short piece: the lowest-ranked neighbours merge first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, a: int, b: int) -> bool:
        """Whether two tokens in a row stay as they are when their bytes are encoded."""
        if len(self.agreed) >= 4 * CACHE:
            self.agreed.clear()
        x, y = self.tokens[a], self.tokens[b]
        got = self.agreed[a << 20 | b] = self.merge(x + y) == [x, y]
        return got

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i from 0, by dynamic programming."""
        counts, last = [0], [0]
        rank_of, known = self.ranks.get, self.agreed.get
        for i in range(1, len(piece) + 1):
            for j in range(i - 1, max(-1, i - 1 - self.longest), -1):
                rank = rank_of(piece[j:i])
                if rank is None:
                    continue
                if j:
                    fits = known(last[j] << 20 | rank)
                    if not (self.agree(last[j], rank) if fits is None else fits):
                        continue
                counts.append(counts[j] + 1)
                last.append(rank)
                break
        return counts

    def prefix_table(self, text: str) -> np.ndarray:
        """Tokens of each prefix of the text's bytes, as encoding that prefix alone gives them; -1
        where a prefix ends inside a character."""
        out, total = [0], 0
        for run, special in self.segments(text):
            space = b""  # white space just before, which is one pre-token for a prefix that ends in it
            for m in self.pattern.finditer(run):
                piece = m[0].encode()
                counts = self.prefix_counts(piece)
                here = [total + c for c in counts[1:]]
                if len(piece) == 3 and piece[:2] in CUT_CONTRACTIONS:
                    here[1] = total + 2
                blank = len(m[0]) - len(m[0].lstrip())
                if space and blank:
                    joined = self.prefix_counts(space + piece[: len(m[0][:blank].encode())])[len(space) :]
                    before = total - self.prefix_counts(space)[-1]
                    for k, c in enumerate(joined[1:]):
                        here[k] = before + c
                out += here
                total += counts[-1]
                space = piece if blank == len(m[0]) else b""
            if special is not None:
                # A prefix that ends inside the special token's string is ordinary text.
                name = next(k for k, v in self.special.items() if v == special)
                for k in range(1, len(name.encode())):
                    out.append(int(self._plain_count(run + name[:k])) + total - self.count(run))
                total += 1
                out.append(total)
        table = np.array(out, np.int32)
        raw = np.frombuffer(text.encode(), np.uint8)
        table[1:][np.r_[(raw[1:] & 0xC0) == 0x80, np.zeros(min(1, len(raw)), bool)]] = -1
        return table

    def _plain_count(self, run: str) -> int:
        return sum(self.prefix_counts(m[0].encode())[-1] for m in self.pattern.finditer(run))

    def _total(self, piece: str) -> int:
        """Tokens of a piece of ordinary text, through the cache."""
        n = self.totals.get(piece)
        if n is None:
            if len(self.totals) >= CACHE:
                self.totals.clear()
            parts = self.pattern.findall(piece)
            n = sum(map(self._total, parts)) if len(parts) > 1 else self.prefix_counts(piece.encode())[-1]
            if len(piece) < 64:
                self.totals[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of prefix_table, by the same recurrence."""
        n = 0
        for run, special in self.segments(text):
            n += special is not None
            if UNEVEN.search(run):
                n += sum(self._total(m[0]) for m in self.pattern.finditer(run))
            elif run:  # each single space or line feed begins a pre-token
                head, *rest = run.replace("\n", " \n").split(" ")
                n += self._total(head)
                get, total = self.totals.get, self._total
                for w in rest:
                    w = w if w[:1] == "\n" else " " + w
                    c = get(w)
                    n += total(w) if c is None else c
        return n

    def truncate(self, text: str, budget: int) -> str:
        """Longest prefix of at most `budget` tokens."""
        table = self.prefix_table(text)
        fits = np.flatnonzero((table >= 0) & (table <= budget))
        return text.encode()[: fits[-1]].decode() if len(fits) else ""


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return texts.map(lambda t: bpe.count(t) if t else 0).astype("int64")

    return docs.withColumn(out, count(F.col(text)))


def truncated(docs: DataFrame, path: str, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """docs with the longest prefix of each text that has at most `budget` tokens; null for null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return texts.map(lambda t: None if t is None else bpe.truncate(t, budget))

    return docs.withColumn(out, cut(F.col(text)))


def prefix_tables(docs: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """docs with the token count of every prefix of each text, by bytes; null for null."""

    @F.pandas_udf("array<int>")
    def tables(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return texts.map(lambda t: None if t is None else bpe.prefix_table(t))

    return docs.withColumn(out, tables(F.col(text)))

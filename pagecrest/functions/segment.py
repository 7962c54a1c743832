"""Sentences and words as Catalyst expressions, by writing system.

Boundaries are found by one pattern, which puts a mark into the text after stops that white space or
the end follows, but not after initials or the caller's abbreviations, nor before a lower-case
letter; runs with a stop that needs no space are marked before that, in texts that have such stops.
The text is then split at the marks. Nothing here runs Python, and a query that selects no sentences
computes none.

Offsets count UTF-16 code units and are running sums of lengths, made stretch by stretch, so that a
text of one line takes time in proportion to its length. Control characters U+0001 and U+0002 serve as marks and count as
white space in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecrest.functions.text import WS, WS_CHARS, trim_ws, u16

#: Stops that need white space or the end after them, and stops that do not.
SPACED = ".!?\u2026\u0964\u0965\u061f\u06d4\u0589\u1362"
UNSPACED = "\u3002\uff01\uff1f\uff0e\u203c\u2047\u2048\u2049\u0f0d\u0f0e\u17d4\u104b\u104a"
#: Greek question marks.
GREEK = ";\u037e"
#: Closing marks that a boundary falls behind.
CLOSING = "\"'\u201d\u2019\u00bb\u203a)]}\u300d\u300f\u3009\u300b\u3015\u3011\uff09"
#: Ranges of scripts.
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
HIRAGANA = r"\x{3040}-\x{309F}"
KATAKANA = r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}"
NO_WORD_RULE = r"\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}"
APOSTROPHES = "'\u2019"
HARD, SOFT = "\x01", "\x02"
#: What a caller may put in the place of the rules: columns of text and language in, and out
#: array<struct<text,start,end>> with offsets in UTF-16 units.
Segmenter = Callable[[Column, Column], Column]


def in_class(chars: str) -> str:
    """Characters escaped for a character class."""
    return "".join("\\" + c if c in "\\]^-[&\"" else c for c in chars)


def hard_stop(greek: bool = False) -> str:
    """Runs with a stop that needs no space after it, and the closing marks behind them."""
    sp, un, cl = map(in_class, (SPACED + (GREEK if greek else ""), UNSPACED, CLOSING))
    return f"([{sp}{un}]*[{un}][{sp}{un}]*[{cl}]*)"


def soft_stop(greek: bool = False, abbreviations: Iterable[str] = ()) -> str:
    """Runs of other stops that end a sentence. A lone full stop behind an initial or an abbreviation
    does not, nor does any stop before a lower-case letter."""
    stops, cl = in_class(SPACED + (GREEK if greek else "")), in_class(CLOSING)
    held = "|".join(["\\p{L}", *sorted(re.escape(a.lower()) for a in abbreviations)])
    lone = f"[{stops}&&[^.]]|(?<!(?:^|[^\\p{{L}}])(?iu:{held}))\\."
    return f"((?=[{stops}])(?:[{stops}]{{2,}}+|{lone})[{cl}]*+)(?=[{WS}]|\\z)(?![{WS}]*\\p{{Ll}})"


def marked(text: Column, greek: bool = False, abbreviations: Iterable[str] = ()) -> Column:
    """The text with marks at its sentence boundaries."""
    out = F.when(F.rlike(text, F.lit(f"[{HARD}{SOFT}]")), F.translate(text, HARD + SOFT, "  ")).otherwise(text)
    # Stops of scripts without spaces all lie above Arabic; most texts have no such character.
    out = F.when(F.rlike(out, F.lit(r"[\x{0F00}-\x{FFFF}]")), F.regexp_replace(out, hard_stop(greek), f"$1{HARD}")).otherwise(out)
    return F.regexp_replace(out, soft_stop(greek, abbreviations), f"$1{SOFT}")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(values: Column) -> Column:
    """struct<out,s>: the sum before each value, and of all; the list is copied for each value."""
    first = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("s"))
    return F.aggregate(values, first, lambda a, x: F.struct(F.concat(a["out"], F.array(a["s"])).alias("out"), (a["s"] + x).alias("s")))


def _stretched(values: Column, stretch: int, inner) -> Column:
    """struct<out,s> as _sums has it, from the sums of stretches of the values, a lambda's variable."""
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / stretch).cast("int"))
    parts = F.transform(starts, lambda k: _let(F.slice(values, k * stretch + 1, F.lit(stretch)), inner))

    def whole(parts: Column) -> Column:
        return _let(_let(F.transform(parts, lambda p: p["s"]), inner), lambda base: moved(parts, base))

    def moved(parts: Column, base: Column) -> Column:
        out = F.zip_with(parts, base["out"], lambda p, b: F.transform(p["out"], lambda x: x + b))
        return F.struct(F.flatten(out).alias("out"), base["s"].alias("s"))

    return _let(parts, whole)


#: Values that are summed one after the other.
STRETCH = 64


def sums_before(values: Column) -> Column:
    """array<bigint>: the sum of the values before each one. Lists are copied for each value only within
    stretches, and in stretches of stretches beyond, so the time grows little faster than the values."""

    def of(v: Column) -> Column:
        two = lambda x: _stretched(x, STRETCH, _sums)
        return F.when(F.size(v) <= STRETCH, _sums(v)["out"]).when(F.size(v) <= STRETCH**2, two(v)["out"]).otherwise(_stretched(v, STRETCH**2, two)["out"])

    return _let(values, of)


def marked_for(text: Column, lang: Column | str | None, abbreviations: Iterable[str]) -> Column:
    if lang is None or isinstance(lang, str):
        return marked(text, lang == "el", abbreviations)
    return F.when(lang == "el", marked(text, True, abbreviations)).otherwise(marked(text, False, abbreviations))


def sentence_texts(text: Column, lang: Column | str | None = None, abbreviations: Iterable[str] = ()) -> Column:
    """array<string> of a paragraph's sentences, for queries that need no offsets."""
    pieces = F.split(marked_for(text, lang, abbreviations), f"[{HARD}{SOFT}]")
    return F.array_remove(F.transform(pieces, trim_ws), "")


def by_units(text: Column, cut) -> Column:
    """cut(size) with the size that counts UTF-16 units: beyond the basic plane a character is two,
    elsewhere its length is one."""
    return F.when(F.rlike(text, F.lit(r"[\x{10000}-\x{10FFFF}]")), cut(u16)).otherwise(cut(F.length))


def sentences(text: Column, lang: Column | str | None = None, abbreviations: Iterable[str] = ()) -> Column:
    """array<struct<text,start,end>> of a paragraph; offsets are UTF-16 and relative to it."""
    mark = marked_for(text, lang, abbreviations)

    def cut(size):
        """Sentences of the pieces, with lengths by `size`."""

        def of(pieces: Column, before: Column) -> Column:
            def one(p: Column, before: Column) -> Column:
                text = trim_ws(p)
                start = (before + size(p) - size(F.ltrim(p, F.lit(WS_CHARS)))).cast("int")
                return F.struct(text.alias("text"), start.alias("start"), (start + size(text)).alias("end"))

            return F.filter(F.zip_with(pieces, before, one), lambda s: s["text"] != "")

        return _let(F.split(mark, f"[{HARD}{SOFT}]"), lambda pieces: _let(sums_before(F.transform(pieces, size)), lambda before: of(pieces, before)))

    return by_units(text, cut)


def word_pattern(japanese: bool) -> str:
    other = f"[^{HAN}{HIRAGANA}{KATAKANA}{NO_WORD_RULE}]"
    spaced = f"[\\p{{L}}\\p{{N}}&&{other}][\\p{{L}}\\p{{N}}{APOSTROPHES}\\-&&{other}]*"
    return f"[{HAN}]{'+' if japanese else ''}|[{HIRAGANA}]+|[{KATAKANA}]+|{spaced}"


def words(sentence: Column, lang: Column | str | None = None, start: Column | int = 0) -> Column:
    """array<struct<text,start,end>> of a sentence; offsets begin at `start`. Han runs are one word in
    Japanese, else a word each; without a hint kana make a sentence Japanese."""
    lang = F.lit(lang) if lang is None or isinstance(lang, str) else lang
    known = F.coalesce(lang, F.lit(""))
    japanese = (known == "ja") | ((known != "zh") & F.rlike(sentence, F.lit(f"[{HIRAGANA}{KATAKANA}]")))
    start = F.lit(start) if isinstance(start, int) else start

    def of(pattern: str) -> Column:
        def cut(size):
            def placed(found: Column, gaps: Column) -> Column:
                before = sums_before(F.zip_with(found, gaps, lambda w, g: size(w) + size(g)))
                begin = F.zip_with(before, gaps, lambda b, g: (start + b + size(g)).cast("int"))
                return F.zip_with(found, begin, lambda w, b: F.struct(w.alias("text"), b.alias("start"), (b + size(w)).cast("int").alias("end")))

            # The text between words: one piece more than there are words, and the last is not needed.
            between = lambda found: F.slice(F.split(sentence, pattern, -1), F.lit(1), F.size(found))
            return _let(F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0)), lambda found: _let(between(found), lambda gaps: placed(found, gaps)))

        return by_units(sentence, cut)

    return F.when(japanese, of(word_pattern(True))).otherwise(of(word_pattern(False)))


def sentence_rows(blocks: DataFrame, *keys: str, text: str = "text", lang: Column | str | None = None, abbreviations: Iterable[str] = (), offsets: bool = True, segmenter: Segmenter | None = None) -> DataFrame:
    """One row for each sentence: the keys, sentence_index, text and, with offsets, start and end. A
    segmenter of the caller takes the place of the rules."""
    if segmenter is not None:
        cut = F.posexplode(segmenter(F.col(text), F.lit(lang) if lang is None or isinstance(lang, str) else lang)).alias("sentence_index", "s")
        return blocks.select(*keys, cut).select(*keys, "sentence_index", "s.text", "s.start", "s.end")
    if not offsets:
        return blocks.select(*keys, F.posexplode(sentence_texts(F.col(text), lang, abbreviations)).alias("sentence_index", "text"))
    cut = F.posexplode(sentences(F.col(text), lang, abbreviations)).alias("sentence_index", "s")
    return blocks.select(*keys, cut).select(*keys, "sentence_index", "s.text", "s.start", "s.end")


def word_rows(sentence_table: DataFrame, *keys: str, lang: Column | str | None = None, segmenter: Segmenter | None = None) -> DataFrame:
    """One row for each word of a sentence table; offsets are relative to the paragraph. A segmenter of
    the caller gives the words of a sentence, with offsets in it."""
    if segmenter is None:
        found = words(F.col("text"), lang, F.col("start"))
    else:
        own = segmenter(F.col("text"), F.lit(lang) if lang is None or isinstance(lang, str) else lang)
        found = F.transform(own, lambda w: F.struct(w["text"].alias("text"), (F.col("start") + w["start"]).alias("start"), (F.col("start") + w["end"]).alias("end")))
    cut = F.posexplode(found).alias("word_index", "w")
    return sentence_table.select(*keys, "sentence_index", cut).select(*keys, "sentence_index", "word_index", "w.text", "w.start", "w.end")


def paragraphs(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Lines of a text as blocks: the keys, block_index and text."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("block_index", "text"))

"""Segmentation: examples by writing system, and the expressions against a plain scan."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagecrest.functions import segment as S
from pagecrest.functions.text import PY_WS

SENTENCES = [
    ("First one. Second one! Third one?", None, (), ["First one.", "Second one!", "Third one?"]),
    ("J. R. R. Tolkien wrote it. И читал А. С. Пушкин.", None, (), ["J. R. R. Tolkien wrote it.", "И читал А. С. Пушкин."]),
    ("и т. д. Новая мысль.", None, (), ["и т. д. Новая мысль."]),
    ("Pi is 3.14 exactly. See example.com now.", None, (), ["Pi is 3.14 exactly.", "See example.com now."]),
    ("Mr. Smith met Dr. Jones. They left.", None, ("mr", "dr"), ["Mr. Smith met Dr. Jones.", "They left."]),
    ('"Wait!" he said. Then silence.', None, (), ['"Wait!" he said.', "Then silence."]),
    ("«Стой!» Он замер.", None, (), ["«Стой!»", "Он замер."]),
    ("这是第一句。这是第二句。", None, (), ["这是第一句。", "这是第二句。"]),
    ("هل تقرأ؟ نعم أقرأ.", None, (), ["هل تقرأ؟", "نعم أقرأ."]),
    ("Τι ώρα είναι; Είναι αργά.", None, (), ["Τι ώρα είναι; Είναι αργά."]),
    ("Τι ώρα είναι; Είναι αργά.", "el", (), ["Τι ώρα είναι;", "Είναι αργά."]),
    ("", None, (), []), ("   ", None, (), []), ("no end", None, (), ["no end"]),
]
WORDS = [
    ("Don't stop-gap it 42 times.", None, ["Don't", "stop-gap", "it", "42", "times"]),
    ("我读书", None, ["我", "读", "书"]), ("我读书", "ja", ["我読書"[0:1] + "读书"]), ("日本語を読む", None, ["日本語", "を", "読", "む"]),
    ("日本語を読む", "zh", ["日", "本", "語", "を", "読", "む"]), ("カタカナとabc", None, ["カタカナ", "と", "abc"]), ("ภาษาไทย", None, []),
]


def scan(text, lang=None, abbreviations=()):
    """Sentences by a plain walk over the text, with code-point offsets."""
    ws, letter = (lambda c: c in set(" \t\n\x0b\f\r\x85\xa0﻿  　")), (lambda c: unicodedata.category(c)[0] == "L")
    stops = S.SPACED + S.UNSPACED + (S.GREEK if lang == "el" else "")
    out, i, begin = [], 0, None
    while i < len(text):
        if begin is None:
            if ws(text[i]):
                i += 1
                continue
            begin = i
        if text[i] not in stops:
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in stops:
            j += 1
        run = text[i:j]
        k = j
        while k < len(text) and text[k] in S.CLOSING:
            k += 1
        ends = any(c in S.UNSPACED for c in run)
        if not ends and (k == len(text) or ws(text[k])):
            t = i
            while t and letter(text[t - 1]):
                t -= 1
            token = text[t:i]
            rest = text[k:].lstrip(PY_WS.replace(" - ", ""))
            held = run == "." and (len(token) == 1 or token.lower() in abbreviations)
            ends = not held and not (rest and unicodedata.category(rest[0]) == "Ll")
        if ends:
            out.append((text[begin:k], begin, k))
            begin = None
        i = k
    if begin is not None and (tail := text[begin:].rstrip()):
        out.append((tail, begin, begin + len(tail)))
    return out


def run(spark, cases):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return rows


def test_sentence_examples(spark):
    for text, lang, abbreviations, want in SENTENCES:
        got = run(spark, [text]).select(S.sentences(F.col("t"), lang, abbreviations).alias("s")).first()["s"]
        assert [s["text"] for s in got] == want


def test_word_examples(spark):
    for text, lang, want in WORDS:
        got = run(spark, [text]).select(S.words(F.col("t"), lang).alias("w")).first()["w"]
        assert [w["text"] for w in got] == want
        units = text.encode("utf-16-le")
        assert [units[2 * w["start"] : 2 * w["end"]].decode("utf-16-le") for w in got] == want


@pytest.mark.parametrize("lang,abbreviations", [(None, ()), ("el", ()), (None, ("mr", "etc"))])
def test_against_scan(spark, lang, abbreviations):
    rng = random.Random(7)
    bits = ["a", "B", "Mr", "etc", "слово", "字", " ", " ", "\n", "　", ".", ".", "!", "?", "…", "。", "！", '"', ")", "»", "3.14", ";", "é", "J", "ß"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    got = run(spark, cases).select("i", S.sentences(F.col("t"), lang, abbreviations).alias("s")).collect()
    for r in got:
        assert [(s["text"], s["start"], s["end"]) for s in r["s"]] == scan(cases[r["i"]], lang, abbreviations), cases[r["i"]]


def test_offsets_are_utf16(spark):
    text = "😀 One. 😀 Two."
    got = run(spark, [text]).select(S.sentences(F.col("t")).alias("s")).first()["s"]
    units = text.encode("utf-16-le")
    assert [units[2 * s["start"] : 2 * s["end"]].decode("utf-16-le") for s in got] == ["😀 One.", "😀 Two."]


@pytest.mark.parametrize("cut", [S.sentences, S.words])
def test_time_in_proportion_on_one_line(spark, cut):
    # Half a million characters and two million in one line: four times the work, not sixteen.
    def seconds(n: int) -> float:
        line = spark.range(1).select(F.repeat(F.lit("One line ran on. "), n).alias("t")).cache()
        line.count()
        began = time.perf_counter()
        last = line.select(F.explode(cut(F.col("t"))).alias("x")).agg(F.count("*"), F.max("x.end")).first()
        assert last[1] == 17 * n - 2 + (cut is S.sentences)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(128_000) < 10 * seconds(32_000)

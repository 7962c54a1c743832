import re
from collections import Counter

from pyspark.sql import functions as F

from pagecrest.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts(spark, real, messy):
    extra = ["a b c a b c a b c", "x x x x", "a\na\n \n \nb a\nb a", "#*$%&|<>", "a b c d a b c", "  lead", "a b c\x0ba b c"]
    docs = real.select("text").union(messy.select("text")).union(spark.createDataFrame([(t,) for t in extra], "text string"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.with_counts(docs, "text", "c").collect():
        assert tuple(r["c"][n] for n in names) == plain(r["text"]), r["text"]


def test_base_rule(real, labels):
    for r in quality.judge(real, labels).collect():
        c = r["counts"]
        assert r["base_failed"] == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] == 0)


def test_learns_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    taught = marks.where("doc_id % 2 = 0")
    judged = quality.judge(docs, taught).join(marks.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    right, n, clean_lost, clean = judged.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*"), F.sum((~F.col("kept") & (F.col("quality") == 1)).cast("int")), F.sum("quality")).first()
    assert right / n > 0.98 and clean_lost / clean < 0.01


def test_expression_agrees_with_rules(spark):
    rules = [(quality.Condition("upper_share", True, 0.5, 3), quality.Condition("symbols_per_word", False, 0.1, 1)), (quality.Condition("marks_per_word", True, 0.5, 2),)]
    rows = quality.with_counts(spark.createDataFrame([("ABC DEF",), ("A# B#",), ("a! b!",), ("A! B!",), ("a b",)], "text string"), "text", "c")
    assert [r[0] for r in rows.select(quality.verdict(rules, "c")).collect()] == [1, 0, 2, 1, 0]
    assert str(rules[0][0]) == "upper_share >= 0.5"


def test_edges(spark, messy, none, labels):
    no_labels = labels.where("false")
    judged = quality.judge(messy, no_labels)
    assert judged.count() == messy.count() and judged.where("rule > 0").count() == 0
    assert quality.judge(none, labels).count() == 0
    kept = quality.keep_good(messy, no_labels)
    assert kept.columns == messy.columns and kept.count() == judged.where("kept").count()
    nulls = spark.createDataFrame([(1, None), (None, 0), (6, 0)], "doc_id long, quality int")
    assert quality.judge(messy, nulls).count() == messy.count()


def test_no_python_on_the_path(real, labels):
    plan = quality.judge(real, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

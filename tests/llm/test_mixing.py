from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagecrest.llm import mixing


def water_fill(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    """Targets by the rule itself: over-full sources get their cap, the rest share the excess."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: cap * sizes[s] for s in over}


def checked(docs, near=0.1, **options):
    rows = mixing.mix(docs, **options).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    for s, t in water_fill(sizes).items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= max(4 * max(1, min(64, sizes[s] // 64)), near * t)
    return rows


def test_targets_and_sizes(real, messy):
    checked(real, near=0.06)
    checked(messy)


def test_sizes_are_words(messy):
    import re

    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in messy.collect())
    assert sorted(r["size"] for r in mixing.mix(messy).collect()) == want


def test_reruns_and_layouts_agree(real):
    one = sorted(map(tuple, mixing.mix(real).collect()))
    assert one == sorted(map(tuple, mixing.mix(real.repartition(7)).collect()))


def test_many_sources_without_broadcast(real, monkeypatch):
    docs = real.withColumn("source", F.concat("source", (F.col("doc_id") % 3).cast("string")))
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_points_are_spread(spark):
    n = 1000
    x = sorted(r[0] for r in spark.range(n).select(mixing.unit_point(F.col("id"))).collect())
    assert 0 <= x[0] and x[-1] < 1
    assert max(b - a for a, b in zip(x, x[1:])) < 3 / n
    far = [r[0] for r in spark.range(mixing.LATTICE, mixing.LATTICE + 5).select(mixing.unit_point(F.col("id"))).collect()]
    assert len(set(far) | set(x)) == n + 5


def test_schedule_keeps_proportions(spark):
    sources = spark.createDataFrame([(1, 40, 30.0), (2, 100, 150.0), (3, 7, 7.5)], "source_no int, n_blocks long, quota double")
    got = defaultdict(int)
    for r in mixing.schedule(sources).collect():
        got[r["source_no"]] += r["times"]
        assert r["times"] <= 2
    assert all(abs(got[s] - q) <= 3 for s, q in ((1, 30), (2, 150), (3, 7.5)))


def test_mixed_texts(real, messy, none):
    for docs in (real, messy):
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        words = out.select(F.sum(F.size(mixing.words(F.col("text"))))).first()[0]
        want = sum(r["taken"] for r in mixing.mix(docs).collect())
        assert words == want
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def test_repeated_rows_share_what_they_take(spark):
    # Copies of a row take whole texts, and at most one of them is cut.
    rows = [(k // 5, f"s{k // 100}", " ".join(f"w{k // 5}-{i}" for i in range(40))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan, got = Counter(), defaultdict(list)
    for r in mixing.mix(docs).collect():
        plan[r["doc_id"]] += r["taken"]
    for r in mixing.mixed(docs).collect():
        got[r["doc_id"]].append(len(r["text"].split()))
    for doc, taken in plan.items():
        assert sum(got[doc]) == taken and sum(n < 40 for n in got[doc]) <= 1


def test_long_sources_have_a_bounded_number_of_blocks(real):
    checked(real, near=0.2, most_blocks=50)


def test_first_words(spark):
    rows = spark.createDataFrame([("a  b\nc d", 3), (" x y", 1), ("a", 1), ("a b ", 2)], "t string, n long")
    assert [r[0] for r in rows.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a  b\nc", " x", "a", "a b"]

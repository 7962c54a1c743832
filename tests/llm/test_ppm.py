import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagecrest.llm import ppm
from pagecrest.llm.common import bucket_of_id


class PlainPpm:
    """PPM with dictionaries, symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            data = b"\xff" * order + t + b"\xff"
            for i in range(order, len(data)):
                self.seen.setdefault(data[i - order : i], Counter())[data[i]] += 1
        for k in range(order, 0, -1):  # below the full order a symbol counts once for each longer context
            for context in [c for c in self.seen if len(c) == k]:
                for s in self.seen[context]:
                    self.seen.setdefault(context[1:], Counter())[s] += 1

    def log10(self, context, symbol):
        out, ruled_out = 0.0, set()
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[len(context) - k :], {})
            left = {s: n for s, n in counts.items() if s not in ruled_out}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.3) / total)
            out += math.log10(0.3 * len(left) / total)
            ruled_out |= set(left)
        return out - math.log10(256 - len(ruled_out))

    def score(self, text):
        data = b"\xff" * self.order + text + b"\xff"
        return sum(self.log10(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def lowered(t):
    return (t or "").encode().lower()


def plain(rows, order):
    out = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    train = [lowered(t) for i, t in rows if not out[i]]
    model, counts = PlainPpm(train, order), Counter(w for t in train for w in t.split())
    counts[None] = len(train)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    for i, t in rows:
        tokens = [*lowered(t).split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        yield i, out[i], len(tokens), sum(counts[w] > 0 for w in tokens), n, base, model.score(lowered(t))


@pytest.mark.parametrize("order,most", [(5, 4_000_000), (5, 200), (3, 50), (2, 4_000_000)])
def test_brute_force(spark, real, order, most):
    docs = real.where("length(text) < 900").limit(60).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(None, None), (777, ""), (778, "été 😀\n\n x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ppm.score(docs, bucket_of_id(F.col("doc_id"), 5) == 1, order=order, max_grams=most, block_bytes=4000).collect()
    want = sorted(plain(rows, order), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=str), want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one(real):
    rows = [lowered(r["text"]) for r in real.limit(10).collect()]
    buf, starts = ppm.lay_out(rows, 3)
    codes = ppm.codes_of(buf, 3)
    k, n = ppm._summed([codes[ppm.real(starts, len(codes), 3)]], [ppm.np.ones(int(ppm.real(starts, len(codes), 3).sum()), ppm.np.int64)])
    trie = ppm.Trie(3, (k, n), ppm._summed([k & 0xFFFFFF], [ppm.np.ones(len(k), ppm.np.int64)]))
    for context in (b"the", b"qqz", b"\xff\xff\xff", b"\x01he", b" th"):
        code = int.from_bytes(context, "big") << 8
        p = trie.log10(ppm.np.arange(256, dtype=ppm.np.int64) + code)
        assert (10**p).sum() == pytest.approx(1)


def test_edge_tables(messy, none):
    held = bucket_of_id(F.col("doc_id"), 5) == 1
    assert ppm.score(none, held).count() == 0
    got = ppm.score(messy, held).collect()
    assert len(got) == messy.count() and all(r["score"] < 0 for r in got)
    blind = ppm.score(messy.where("doc_id = 10"), F.lit(True)).collect()  # nothing to learn from
    assert all(r["score"] == pytest.approx(-math.log10(256) * (len(r_) + 1)) for r, r_ in zip(sorted(blind, key=lambda r: r["score"]), ["other text here", "two words"]))


def test_held_out_beats_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = ppm.score(docs, bucket_of_id(F.col("doc_id"), 5) == 1).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]

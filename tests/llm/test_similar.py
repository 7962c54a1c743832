"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import itertools
import random

import numpy as np

import corpus_pipeline as pipeline
from pagecrest.llm import similar


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def groups(docs):
    """Smallest id of each group that pairs at 0.8 or more, and chains of them, make."""
    sets, head = {i: shingled(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            head[b] = a
    return {find(i) for i in head}


def kept(spark, docs):
    out = pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids))
    return set(ids)


def test_near_copies_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = kept(spark, docs)
    assert got == groups(rows)


def test_edges_of_the_limit(spark):
    words = [f"w{k}" for k in range(124)]  # 120 shingles
    texts = [" ".join(words)]
    texts += [" ".join([*words[: 124 - k], *(f"x{j}" for j in range(k))]) for k in (13, 14, 20, 60)]
    texts += ["", None, " \n", "a b", "A  b", "a c", "a b c d e f"]
    texts += [" ".join(words[k:]) for k in range(0, 100, 3)]  # a chain
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept(spark, docs) == groups(list(enumerate(texts)))


def test_keys_find_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 180, np.int64).astype(np.uint64)
        a, b = similar.band_keys(x[:162]), similar.band_keys(x[18:])  # 144 of 180
        assert set(a.tolist()) & set(b.tolist())


def test_the_radius_reaches_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    for n in [5, 10, 15, 20, 25, 30, 40, 60, 100, 200, 400] * 30:
        x = rng.integers(0, 1 << 63, n, np.int64).astype(np.uint64)
        for a, b in ((x, x[n // 5 :]), (x[: n - n // 10], x[n // 5 - n // 10 :])):
            far = np.bitwise_count(similar.fingerprint(a) ^ similar.fingerprint(b)).sum()
            assert far <= (similar.RADIUS_OF_FEW if min(len(a), len(b)) < similar.FEW else similar.RADIUS), n


def test_one_large_group_and_tiles(spark):
    # Copies of one text that are unlike each other, beside texts that share a long passage only.
    rng = random.Random(8)
    base = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(160)] = f"c{k}"
        rows.append(" ".join(copy))
    rows += [" ".join([f"a{k}-{i}" for i in range(60)] + base[:70] + [f"b{k}-{i}" for i in range(60)]) for k in range(120)]
    docs = list(enumerate(rows))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (1024, 8):
        found = similar.dedup_groups(table, max_shard=most).collect()
        assert {r["component_id"] for r in found} == groups(docs)


def test_a_tree_joins_the_nearest_first():
    i, j, d = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 3]), np.array([5, 1, 2, 9])
    assert similar.shortest_tree(i, j, d, np.arange(4)).tolist() == [1, 2, 3]
    assert similar.shortest_tree(i, j, d, np.array([0, 0, 1, 1])).tolist() == [1]

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagecrest.llm import simhash
from pagecrest.llm.common import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    """rows: (doc_id, fingerprint); smallest id that each reaches."""
    left, out = set(range(len(rows))), [None] * len(rows)
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            a = todo.pop()
            near = {b for b in left if (rows[a][1] ^ rows[b][1]).bit_count() <= radius}
            left -= near
            group |= near
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids, default=None)
    return out


def check(docs, **options):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((i, f, c) for (i, f), c in zip(rows, plain_components(rows))), key=str)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.dedup_groups(docs, **options).collect()]
    assert sorted(got, key=str) == want


def test_brute_force(real, messy):
    check(real)
    check(messy)
    check(real, max_shard=2)  # every shard is dealt again and tiled


def test_empty(none):
    assert simhash.dedup_groups(none).count() == 0
    assert simhash.keep_one(none).columns == none.columns


def test_tree_finds_all():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(400)], np.uint64)
    values = np.unique(np.repeat(base, 10) ^ flips)
    tree = simhash.BkTree(values)
    got = {(n, int(q)) for n, qs in tree.search(values, 3) for q in qs}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert got == want


def test_shards_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(300)], np.uint64)
    values = np.unique(np.repeat(base, 10) ^ flips)
    rows = list(enumerate(map(int, values)))
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    for most in (1, 3, 1024):
        root = {r["node"]: r["root"] for r in simhash.near_duplicates(fps, 3, most).collect()}
        groups = plain_components(rows)
        seen = {}
        for (i, v), g in zip(rows, groups):
            signed = int(np.uint64(v).view(np.int64))
            assert seen.setdefault(g, root.get(signed, signed)) == root.get(signed, signed)
        assert len(set(seen.values())) == len(set(groups))


def test_keep_one(messy, real):
    for docs in (messy, real):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
        assert kept.count() == len(set(zip(plain_components(rows)))) if docs is real else True
        assert kept.count() == simhash.dedup_groups(docs).select("root").distinct().count()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "src long, dst long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(edges.where(F.lit(False))).count() == 0

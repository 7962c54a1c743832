from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagecrest.llm import topk


def plain(rows, k, scale=64):
    """rows: (vec_id, vector); best k of each id divisible by 20."""
    ok = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % 20 == 0:
            found = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def found(df, **options):
    return {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, **options).collect()}


@pytest.mark.parametrize("block,chunk", [(4096, 1024), (70, 6)])
def test_real_vectors(spark, block, chunk):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert found(df, block_rows=block, query_rows=chunk) == plain(rows, 20)


def test_ties_clusters_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 5))
    rows = [(i, [float(x) for x in np.round(centres[i % 4] + 0.05 * rng.normal(size=5), 2)]) for i in range(300)]
    rows += [(i, [0.5] * 5) for i in range(300, 420)] + [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (520, [1.0, 2.0]), (521, [3.0, 4.0]), (None, [0.5] * 5), (540, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    assert found(df, k=7) == plain(rows, 7)
    assert found(df, k=7, block_rows=40, query_rows=3) == plain(rows, 7)
    assert found(df.where("false")) == set()


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5)
    assert got == {(0, 1, 2, 64 * 128), (0, 2, 1, 64 * 64)}


def test_tree_covers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 3)), 5 + 0.01 * rng.normal(size=(300, 3)), np.zeros((100, 3))])
    tree, leaves = topk.cover_tree(x), 0
    assert sorted(tree.order) == list(range(len(x)))
    for _, node in tree.nodes():
        points = x[tree.order[node.start : node.end]]
        assert np.sqrt(((points - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-6
        if node.children:
            assert [c.start for c in node.children] + [node.end] == [node.start] + [c.end for c in node.children]
            assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
            assert (node.children[0].centre == node.centre).all()
        else:
            assert len(points) <= topk.LEAF or (points == points[0]).all()
            leaves += len(points)
    assert leaves == len(x)


def clustered(n=2048, width=64, spread=5.0):
    rng = np.random.default_rng(0)
    return np.floor(100 * rng.normal(size=(40, width))[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, width)))


def test_wide_nodes_are_not_leaves():
    # Vectors of no structure are all far apart: one level with as many children as points.
    x = np.floor(64 * np.random.default_rng(2).normal(size=(500, 64)))
    depths = Counter(d for d, _ in topk.cover_tree(x).nodes())
    assert depths[0] == 1 and depths[1] > 400


@pytest.mark.parametrize("known", [False, True])
def test_pruning_in_many_dimensions(known):
    x, stats = clustered(), Counter()
    ids = np.arange(len(x))
    scores = x[::20] @ x.T
    scores[np.arange(len(scores)), ids[::20]] = -np.inf
    seed = np.sort(scores, axis=1)[:, -20].astype(np.int64) if known else None
    row, at, score = topk.search(x, ids, x[::20], ids[::20], 20, seed, stats)
    want = {(q, int(i), int(s[i])) for q, s in enumerate(scores) for i in np.lexsort((ids, -s))[:20]}
    assert set(zip(row.tolist(), at.tolist(), score.tolist())) == want
    assert stats["left out"] > 0.9 * stats["pairs of points"] and stats["compared"] + stats["left out"] == stats["pairs of points"]
    assert stats["data depth"] >= 2


def test_cells_and_groups(spark):
    # Many cells, cut cells and small query groups; most pairs of them are never searched.
    x = clustered(1500, 16)
    x[:400] = x[0]
    rows = [(i, (v / 64).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, k=7, block_rows=50, query_rows=4, sample_rows=300) == plain(rows, 7)

import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagecrest.llm import common


def test_settle_writes_to_the_shared_folder(spark):
    df = common.settle(spark.range(5).withColumn("x", F.col("id") * 2))
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(5)]
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = common.staging_root(spark)
    assert shared is None or root.startswith(shared)
    assert all(root.removeprefix("file://") in f for f in df.inputFiles())


class Bare:
    """As much of a session as staging needs, without the setting."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        applicationId, _jsc, master = "bare", None, "local[2]"


def test_staging_without_the_setting():
    root = common.staging_root(Bare)
    assert os.path.isdir(os.path.dirname(root)) and common.staging_root(Bare) == root
    os.makedirs(f"{root}/x")
    kept = {k: v for k, v in common._roots.items() if k != "bare"}
    for k in kept:
        del common._roots[k]
    common.clear_staging(Bare)
    common._roots.update(kept)
    assert not os.path.exists(root)


def test_a_cluster_needs_the_setting():
    class Cluster(Bare):
        class sparkContext:
            applicationId, _jsc, master = "other", None, "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.staging_root(Cluster)


def test_joins_of_hot_keys(spark):
    many = common.settle(spark.range(9000).select(F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("x")))
    one = common.settle(spark.range(-1, 500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")))
    want = sorted(map(tuple, many.join(one, "k").collect()))
    assert sorted((r["k"], r["x"], r["y"]) for r in common.join_one(many, one, "k", least=100).collect()) == want
    common.discard(one)
    assert not os.path.exists(one._settled_at.removeprefix("file://"))


def test_ranks_within_groups(spark, messy):
    rows = common.settle(messy.select("doc_id", "source", F.monotonically_increasing_id().alias("n")))
    got = common.ranked(rows, ["source", "doc_id"], F.xxhash64("n"), 5, [F.col("n")], "rank").collect()
    groups = {}
    for r in got:
        groups.setdefault((r["source"], r["doc_id"]), []).append(r["rank"])
    assert len(got) == messy.count() and all(sorted(g) == list(range(len(g))) for g in groups.values())


def test_words_and_buckets(spark, messy):
    gap = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [None, "", " ", "a", " a\tb\x0bc\x0cd \n", "x\x85y\xa0z", "a\x1fb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.words(F.col("t")).alias("w")).collect()
    assert all(r["w"] == gap.findall(r["t"] or "") for r in rows)
    for r in messy.select("doc_id", common.bucket_of_id(F.col("doc_id"), 5).alias("b")).collect():
        assert r["b"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5


def test_fresh_names(messy):
    assert common.fresh(messy, "other") == "other"
    assert common.fresh(messy, "Score") == "_Score"

"""Rewriting shards in place."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagecrest.llm import resharding


def test_a_shrink_over_an_existing_layout(spark, tmp_path):
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") + 1000).cast("string")).alias("text")).cache()
    docs.withColumn("shard", (F.col("doc_id") % 8).cast("int")).write.partitionBy("shard").parquet(str(tmp_path / "x"))
    plan = resharding.reshard(docs, F.col("doc_id") % 8, 7).cache()
    resharding.rewrite(docs, plan, str(tmp_path / "x"))
    got = Counter((r["doc_id"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "x")).collect())
    assert got == Counter((r["doc_id"], r["shard"]) for r in plan.collect())


def test_repeated_rows_in_different_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (2, "b")], "doc_id long, text string")
    plan = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    plan = spark.createDataFrame([(r[0], r[1], 0, k) for k, r in enumerate(plan.collect())], "doc_id long, text_hash long, old_shard int, shard int")
    resharding.rewrite(docs, plan, str(tmp_path / "y"), untouched=True)
    got = Counter((r["doc_id"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "y")).collect())
    assert got == Counter((r["doc_id"], r["shard"]) for r in plan.collect())


@pytest.mark.parametrize("olds,news", [(4, 3), (3, 4), (4, 1)])
def test_every_row_once_in_place(spark, tmp_path, olds, news):
    path = str(tmp_path / "z")
    rows = [(None if k % 7 == 0 else k // 2, None if k % 11 == 0 else f"text {k // 4}", "kept") for k in range(400)] + [(1, "same", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_no string").withColumn("shard", F.pmod(F.xxhash64("text", "doc_id"), F.lit(olds)).cast("int")).cache()
    docs.write.partitionBy("shard").parquet(path)
    read = spark.read.parquet(path)
    resharding.rewrite(read, resharding.reshard(read, F.col("shard"), news), path)
    out = spark.read.parquet(path)
    assert out.columns == ["doc_id", "text", "row_no", "shard"]
    assert Counter(map(tuple, out.drop("shard").collect())) == Counter(rows)
    assert {p.name for p in (tmp_path / "z").iterdir() if p.name.startswith("shard=")} == {f"shard={k}" for k in range(news)}

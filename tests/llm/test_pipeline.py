"""The stages against plain versions of what they decide."""

from collections import Counter

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from pagecrest.llm import mixing, quality, toxicity
from test_similar import groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages(spark, real, labels):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "near_duplicates", "source_mixing", "best_fit_packing"]
    docs = real
    for _, stage in pipeline.STAGES[:2]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and not rows(kept) - rows(docs)
        docs = kept.cache()
    model = toxicity.learn(real, labels)
    clean = [r for r in real.collect() if model.score(model.lexicon.evidence(r["text"])[0][None])[0] < 0.5]
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(clean, real.schema), labels).collect()}
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in clean if judged[r["doc_id"]]}

    kept = pipeline.STAGES[2][1](spark, docs, SF).cache()
    assert {r["doc_id"] for r in kept.collect()} == groups([(r["doc_id"], r["text"]) for r in docs.collect()])

    mix = pipeline.STAGES[3][1](spark, kept, SF).cache()
    assert mix.columns == kept.columns
    words = {r["doc_id"]: r["n"] for r in mix.groupBy("doc_id").agg(F.sum(F.size(mixing.words(F.col("text")))).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in mixing.mix(kept).collect() if r["taken"]}

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = pipeline.STAGES[4][1](spark, mix, SF).collect()
    want = sum(len(lib.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert sum(r["length"] for r in packed) == want


def test_run_is_the_stages_in_turn(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_an_empty_table(spark, real, tmp_path):
    docs = real.where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_columns_of_the_stages_own_names(spark, real):
    docs = real.withColumn("toxic_score", F.lit("mine")).withColumn("_salt", F.lit(1))
    kept = pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns and {r["toxic_score"] for r in kept.collect()} == {"mine"}

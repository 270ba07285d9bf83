import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import mixing, near_dedup, pseudonyms


def test_stages(spark, data, tmp_path):
    """Each stage is held against what its operator says about its own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, data)
        if name != "byte_bpe":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"file://{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"file://{tmp_path}/{name}"))
        docs = seen[name][1]
    before, after = seen["language_id"]
    assert after.count() >= 0.97 * before.filter("text rlike '\\\\p{L}'").count()
    before, after = seen["near_dedup"]
    classes = near_dedup.near_duplicate_classes(before)
    assert after.count() == classes.select("class_id").distinct().count() == after.select("doc_id").distinct().count() and near_dedup.near_duplicate_classes(after).filter("doc_id <> class_id").count() == 0
    before, after = seen["pii"]
    assert after.count() == before.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["text"] == pseudonyms.replace(texts[r["doc_id"]], cp.DEMO_KEY)[0] and r["n_chars"] == len(r["text"])
    before, after = seen["mixing"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in mixing.mix(before).filter("sampled").select("doc_id").collect()}
    before, after = seen["byte_bpe"]
    assert after.count() == before.count()
    digests = before.select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("want")).join(after, "doc_id")
    assert digests.filter("want <> decoded_sha256").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_odd_and_empty_tables(spark, data, odd, none, name):
    stage = dict(cp.STAGES)[name]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert stage(spark, none.select(columns), data).count() == 0
    assert stage(spark, odd.select(columns), data).count() <= odd.count()


def test_near_dedup_keeps_clean_rows_without_an_id(spark, data, odd):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = odd.select(columns).unionByName(odd.select(columns).filter("doc_id is null")).unionByName(odd.select(columns).filter("doc_id is null").withColumn("text", F.lit("another text")))
    kept = dict(cp.STAGES)["near_dedup"](spark, rows, data).collect()
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == ["another text", "text without an id 4041894974608795"]
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_mixing_sees_the_predicted_language(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "??").otherwise(F.col("lang")))
    kept = dict(cp.STAGES)["language_id"](spark, docs, data)
    assert kept.filter("lang = '??'").count() == 0 and kept.columns == docs.columns


def test_run_equals_its_stages(spark, data, tmp_path):
    """run() gives the rows of the stages, each applied to what the one before it wrote."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, data).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    got = cp.run(spark, data)
    assert got.columns == docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and got.count() > 100


def test_long_secrets_pass_through_every_stage(spark, data):
    """A key of many thousand characters in one text stops no stage, and none of it stays in clear."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    secret = "a1B2c3D4e5" * 2_000
    rows = docs.limit(40).withColumn("text", F.when(F.col("doc_id") == docs.first()["doc_id"], F.concat(F.lit(f"api_key = {secret} "), "text")).otherwise(F.col("text")))
    new = dict(cp.STAGES)["pii"](spark, rows, data)
    assert new.count() == 40 and new.filter(F.contains("text", F.lit(secret[:40]))).count() == 0
    assert dict(cp.STAGES)["byte_bpe"](spark, new, data).count() == 40

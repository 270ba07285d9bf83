import pytest
from compare import same
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries


def test_query_equals_sql(spark, duck, data):
    same(queries.op6_mixing(spark, data), duck, queries.oracle_sql()["op6_mixing"])


def test_raking_meets_the_targets(spark):
    cells = spark.createDataFrame([("a", "x", "t", 70.0), ("a", "y", "t", 10.0), ("b", "x", "t", 15.0), ("b", "y", "u", 5.0), ("a", "x", "u", 20.0)], "source string, lang string, topic string, tokens double")
    share = lambda name, rows: spark.createDataFrame(rows, f"{name} string, share double")
    targets = {"source": share("source", [("a", 0.6), ("b", 0.4)]), "lang": share("lang", [("x", 0.7), ("y", 0.3)]), "topic": share("topic", [("t", 0.75), ("u", 0.25)])}
    raked, residual = mixing.rake(cells, targets)
    assert residual <= mixing.RESIDUAL
    for name, want in (("source", {"a": 0.6, "b": 0.4}), ("lang", {"x": 0.7, "y": 0.3}), ("topic", {"t": 0.75, "u": 0.25})):
        got = {r[name]: r["w"] for r in raked.groupBy(name).agg(F.sum("weight").alias("w")).collect()}
        assert got == pytest.approx(want, abs=1e-6)


def test_sampled_tokens_follow_the_targets(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("en").alias("lang"), F.lit("a b c").alias("text"))
    one = lambda name, value: spark.createDataFrame([(value, 1.0)], f"{name} string, share double")
    targets = {"source": spark.createDataFrame([("big", 0.5), ("small", 0.5)], "source string, share double"), "lang": one("lang", "en"), "topic": one("topic", "note")}
    got = {r["source"]: r["n"] for r in mixing.mix(df, targets=targets).filter("sampled").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got["small"] == 3 * 8000 and got["big"] == pytest.approx(got["small"], rel=0.05)


def test_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["probability"] <= 1 for r in got)
    assert all(r["sampled"] for r in got if r["n_tokens"] == 0)
    kept = mixing.sampled_documents(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() in (0, 2)
    assert mixing.mix(none).count() == 0


def test_contradicting_targets_end_with_their_residual(spark, caplog):
    cells = spark.createDataFrame([("a", "x", 5.0), ("b", "y", 5.0)], "source string, lang string, tokens double")
    targets = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1), ("none", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.2), ("y", 0.8)], "lang string, share double")}
    raked, residual = mixing.rake(cells, targets)
    assert residual > 0.5 and "raking ended" in caplog.text and raked.count() == 2


def test_columns_named_like_its_own(spark, odd):
    df = odd.withColumnsRenamed({"id": "mix_cell", "bucket": "mix_rate", "score": "__source"}).withColumn("mix_tokens", F.lit(7))
    kept = mixing.sampled_documents(df)
    assert kept.columns == df.columns and kept.filter("mix_tokens <> 7").count() == 0
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in df.collect()}


def two_by_two(spark, rows, left, right):
    """Cells with targets of two dimensions: raked weights by cell, and the residual."""
    cells = spark.createDataFrame(rows, "source string, lang string, tokens double")
    targets = {name: spark.createDataFrame(list(t.items()), f"{name} string, share double") for name, t in (("source", left), ("lang", right))}
    raked, residual = mixing.rake(cells, targets)
    return {(r["source"], r["lang"]): r["weight"] for r in raked.collect()}, residual


def test_targets_that_need_a_cell_to_vanish_are_met(spark):
    """Plain raking needs about a million rounds here: a/y falls as one over the round."""
    weights, residual = two_by_two(spark, [("a", "x", 5.0), ("a", "y", 3.0), ("b", "y", 2.0)], {"a": 0.5, "b": 0.5}, {"x": 0.5, "y": 0.5})
    assert residual <= mixing.RESIDUAL and weights["a", "y"] < 1e-5
    assert weights["a", "x"] == pytest.approx(0.5, abs=1e-5) and weights["b", "y"] == pytest.approx(0.5, abs=1e-5)


def test_slow_raking_ends_where_plain_raking_does(spark):
    """Cells almost apart converge slowly; the odds ratio of a table is what raking leaves alone."""
    rows = [("a", "x", 1000.0), ("a", "y", 1.0), ("b", "x", 1.0), ("b", "y", 1000.0)]
    weights, residual = two_by_two(spark, rows, {"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5})
    assert residual <= mixing.RESIDUAL
    assert weights["a", "x"] * weights["b", "y"] / (weights["a", "y"] * weights["b", "x"]) == pytest.approx(1e6, rel=1e-6)
    assert sum(weights.values()) == pytest.approx(1)


def test_the_residual_is_told(spark, data):
    got = mixing.mix(queries.table(spark, data, "documents"))
    assert {r["residual"] <= mixing.RESIDUAL for r in got.filter("residual is not null").collect()} == {True}

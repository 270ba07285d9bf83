import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as li
from tidemark.llm import queries


def test_held_out_accuracy(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    row = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.avg("score").alias("s"), F.avg(F.col("rejected").cast("int")).alias("r")).first()
    assert row["a"] > 0.97 and 0.8 < row["s"] <= 1 and row["r"] < 0.02


def test_held_out_rows_and_other_columns_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    changed = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0).withColumn("lang", F.when(F.col("held"), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = li.train(docs), li.train(changed)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_long_texts_are_read_whole(spark, data):
    model = li.train(spark.read.parquet(f"{data}/documents.parquet"))
    german, english = "der die und nicht schen einer " * 3, "the and that with thing of was "
    assert model.predict(german + english * 80_000)[0] == model.predict(english)[0]


def test_odd_rows(spark, data, odd, none):
    model = li.train(spark.read.parquet(f"{data}/documents.parquet"))
    got = li.identify(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert li.keep_identified(odd, model).columns == odd.columns
    empty = li.train(none)
    assert empty.languages == [] and li.identify(odd, empty).filter("lang_pred <> 'und'").count() == 0
    assert li.identify(none, model).count() == 0


def plain_prediction(model, text):
    """The method said once more, a subword at a time."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, out = f" {text.lower()} ".encode("utf-8", "surrogatepass"), []
    kept = []
    for b in data:
        b = b if b >= 0x80 or chr(b).isalpha() else 0x20
        if b != 0x20 or not kept or kept[-1] != 0x20:
            kept.append(b)
    for n in (2, 3, 4):
        for i in range(len(kept) - n + 1):
            value = sum(kept[i + j] << 8 * j for j in range(n))
            out.append(((value ^ n) * 2654435761 & 0xFFFFFFFF) >> (32 - model.bits))
    logits = (sum(model.table[r] for r in out) / max(len(out), 1) + model.bias) / model.temperature
    p = np.exp(logits - logits.max())
    return model.languages[int(p.argmax())], float(p.max() / p.sum())


def test_predictions_equal_the_plain_method(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = li.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in li.identify(docs, model).collect():
        lang, score = plain_prediction(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6) and r["rejected"] == (lang == "und" or r["score"] < model.reject_below)


def test_letters_by_unicode(spark, data):
    """Number signs and numerals are no letters, whatever a pattern of word characters makes of them."""
    model = li.train(spark.read.parquet(f"{data}/documents.parquet"))
    for text in ("½", "Ⅷ Ⅻ", "①②", "x²".replace("x", "3"), "७ 12 _", "", " !? ", None, "\u0301"):
        assert model.predict(text)[0] == li.UNDETERMINED
    assert all(model.predict(text)[0] != li.UNDETERMINED for text in ("é", "ß", "日", "3 apples", "ª"))

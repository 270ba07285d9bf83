import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import importance as im
from tidemark.llm import queries


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plainly(rows, target, percent=5, least=20):
    """(id, features, weight, score, rank) of (id, text) rows, one by one; the rows of one id have the same text."""
    s, t = (Counter(b for text in texts for b in buckets(text)) for texts in ([x for _, x in rows], target))
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (n + 10000.0) / ((s[b] + 1.0) * (m + 10000.0)))) for b in s}
    out, fit = [], []
    for i, text in rows:
        found = buckets(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words(text)) >= least:
            fit.append(out[-1])
    for rank, row in enumerate(sorted(fit, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: percent * len(fit) // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, out), key=repr)


def found(df, target, **options):
    return sorted((tuple(r) for r in im.resample(df, target, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=5).map(lambda b: b.replace(b" ", b"x")), min_size=1, max_size=12), st.integers(0, 11), st.sampled_from([1, 254, 255, 256, 257, 511, 512, 1023, 70000]))
def test_checksums_of_runs(some, at, long):
    some[at % len(some)] = b"q" * long
    for k, got in enumerate(im.run_checksums(some)):
        assert list(got[k:]) == [zlib.crc32(b" ".join(some[i : i + k + 1])) for i in range(len(some) - k)]


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_features_of_whole_texts(size):
    texts = ["Über 3 Straßen. A b-c\td", None, "", "one", "one two", "one two three", "w " * 50, "x" * 300 + " y " + "z" * 600 + " 日本 語"]
    got, count = {i: [] for i in range(len(texts))}, Counter()
    for text, n, whose, found_buckets in im.features(texts, piece_bytes=size):
        for i, k in zip(text, n, strict=True):
            count[int(i)] += int(k)
        for i, b in zip(whose, found_buckets, strict=True):
            got[i].append(int(b))
    assert all(Counter(got[i]) == Counter(buckets(t)) for i, t in enumerate(texts))
    assert all(count[i] == len(words(t)) for i, t in enumerate(texts))


def test_query_equals_sql(spark, duck, data):
    same(queries.op12_importance(spark, data), duck, queries.oracle_sql()["op12_importance"])


def test_query_equals_plain_python(spark, data):
    documents, target = (queries.table(spark, data, n) for n in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(documents, target) == plainly(rows, [r["text"] for r in target.collect()])


def test_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("a b c d e",), (None,), ("",), ("long line",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for percent in (0, 5, 50, 100):
        assert found(odd, target, percent=percent, least_words=1) == plainly(rows, ["a b c d e", "long line"], percent, 1)
    assert found(none, target) == [] and im.resampled_documents(none, target).count() == 0
    assert found(odd, none) == plainly(rows, [])


def test_ties_go_to_smaller_ids(spark):
    """Equal scores, repeated ids and ids that are null: the draw is of the right size, its ranks have no gap."""
    rows = [(i, 25, s) for i, s in [(3, 5), (1, 5), (2, 5), (9, 7), (4, 1), (1, 5), (None, 5), (None, 5), (-8, 5), (6, -3)]] + [(70, 19, 99), (None, 25, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, score long").cache()
    want = [(9, 7), (None, 7), (-8, 5), (1, 5), (1, 5), (2, 5), (3, 5), (None, 5), (None, 5), (4, 1), (6, -3)]
    for percent in range(0, 101, 9):
        got = {r["rank"]: (r["doc_id"], r["score"]) for r in im.draw(df, percent=percent).filter("rank is not null").collect()}
        assert got == {n + 1: w for n, w in enumerate(want[: percent * len(want) // 100])}
        assert im.draw(df, percent=percent).count() == len(rows)


@settings(max_examples=15, deadline=None)
@given(values=st.lists(st.integers(-(1 << 40), 1 << 40) | st.integers(-3, 3), min_size=1, max_size=30), at=st.integers(0, 29))
def test_bisection(spark, values, at):
    wanted = at % len(values) + 1
    assert im.highest(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"), wanted) == sorted(values, reverse=True)[wanted - 1]


def test_drawn_rows_are_whole(spark, data):
    documents, target = (queries.table(spark, data, n) for n in ("documents", "benchmark"))
    got = im.resampled_documents(documents, target, percent=10)
    assert got.columns == documents.columns
    ids = {r["doc_id"] for r in im.resample(documents, target, percent=10).filter("rank is not null").collect()}
    assert {r["doc_id"] for r in got.collect()} == ids and len(ids) > 5
    assert np.array_equal(im.gains(documents, target), im.gains(documents.repartition(5), target))

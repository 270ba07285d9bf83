import hashlib
import re

import pytest
from compare import same
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as ed
from tidemark.llm import queries


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def groups(rows):
    """What exact_groups says of (id, text) rows, worked out one by one."""
    by_text = {}
    for i, text in rows:
        by_text.setdefault(normal(text), []).append(i)
    out = []
    for text, ids in by_text.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in ed.exact_groups(df, **options).collect()), key=repr)


def test_query_equals_sql(spark, duck, data):
    same(queries.op13_exact_dedup(spark, data), duck, queries.oracle_sql()["op13_exact_dedup"])


def test_odd_rows(odd, none):
    assert found(odd) == groups([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert found(none) == [] and ed.keep_first(none).columns == none.columns


@pytest.mark.parametrize("hot_share", [1, 3, 1000])
@pytest.mark.parametrize("digest", [ed.sha256, lambda t: F.length(t) % 3, lambda t: F.lit(0)], ids=["sha256", "length", "constant"])
def test_hot_groups_and_equal_digests(spark, hot_share, digest):
    """Digests that stand for several texts never join different texts, however large the groups are."""
    rows = [(i if i % 7 else None, "the same\ttext" if i % 3 else " ".join("abcdefg"[: i % 8])) for i in range(240)] + [(None, "no id")] * 20 + [(5, "the same text")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df, hot_share=hot_share, digest=digest, salts=3) == groups(rows)


def test_white_space_and_nothing_else(spark):
    rows = [(1, "a  b"), (2, "a\x0b\r\nb"), (3, "a b"), (4, " a b"), (5, "A b"), (6, "a b "), (7, "a b\x1f"), (8, None), (9, ""), (10, "  "), (11, "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == groups(rows)
    kept = {r["doc_id"]: r["text"] for r in ed.keep_first(df).collect()}
    assert kept == dict(r for r in rows if r[0] not in (2, 9, 11))


def test_rows_of_first_are_whole(odd):
    kept = ed.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({normal(r["text"]) for r in odd.collect()})
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 5, 6, 7, 8, None}


def test_no_window_holds_a_hot_group(spark, data):
    plan = ed.exact_groups(queries.table(spark, data, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan

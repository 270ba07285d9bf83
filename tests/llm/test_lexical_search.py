import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import same

from tidemark.llm import lexical_search as ls
from tidemark.llm import queries


def terms(text):
    return re.findall(ls.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plainly(docs, items, top=50):
    """(item, rank, id, score) worked out pair by pair."""
    counted = [(i, Counter(t)) for i, t in ((i, terms(text)) for i, text in docs) if t]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        found = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in words if t in c)
            found += [(i, score)] if score > 0 else []
        found.sort(key=lambda f: (-f[1], f[0] is None, f[0] or 0))
        out += [(item, r + 1, i, s) for r, (i, s) in enumerate(found[:top])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in ls.top_documents(docs, items, **options).collect()), key=repr)


def test_query_equals_sql(spark, duck, data):
    same(queries.op11_lexical_search(spark, data), duck, queries.oracle_sql()["op11_lexical_search"])


@pytest.mark.parametrize("slots", [40, 100_000])
def test_plain_search_in_blocks_of_items(spark, data, slots):
    documents, items = queries.table(spark, data, "documents").limit(60), queries.table(spark, data, "benchmark").limit(9)
    docs, wanted = ([tuple(r) for r in df.select(i, "text").collect()] for df, i in ((documents, "doc_id"), (items, "item_id")))
    assert found(documents, items, top=7, block_slots=slots) == plainly(docs, wanted, 7)


def test_odd_rows(spark, odd, none):
    rows = [(1, "A b, words", "x"), (1, "ONE", "x"), (2, None, "x"), (3, " .", "x"), (None, "a", "x"), (4, "日本語 zzz É", "x"), (5, "long line of words", "x"), (5, "long line of words", "x")]
    items = spark.createDataFrame(rows, "item_id long, text string, score string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for top in (1, 2, 50):
        assert found(odd, items, top=top) == plainly(docs, [r[:2] for r in rows], top)
    assert found(none, items) == [] and found(odd, items.limit(0)) == []


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in (9, 4, 4, None, 7, -2)] + [(5, "other"), (6, "x y z " * 5)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([("i", "words")], "item_id string, text string")
    for top in range(1, 8):
        assert found(df, items, top=top) == plainly(docs, [("i", "words")], top)


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_guards_and_pieces(size):
    """Terms match as whole terms only, beside each other, at both ends, in any piece, whatever the script."""
    known = ["a", "ab", "aba", "é", "éa", "日本", "7", "nothere"]
    text = "a ab aba a a A,AB;abab é éa xé 日本 日本語 日本 7 77 a-7 " * 3 + "ab"
    n, which, often = ls.counted(text, ls.automaton([t.encode() for t in known]), size)
    want = Counter(terms(text))
    assert n == sum(want.values())
    assert {known[i]: k for i, k in zip(which, often, strict=True)} == {t: want[t] for t in known if want[t]}


def test_best_keeps_what_a_full_sort_keeps():
    rng = np.random.default_rng(3)
    best, every = ls.Best(4, 5), []
    best.limit = 30
    for at in range(0, 400, 20):
        ids, scores = rng.permutation(400)[:20] + 400 * at, rng.integers(0, 6, (20, 4))
        best.add(ids, np.zeros(20, bool), scores)
        every += [(j, -int(scores[d, j]), int(ids[d])) for d in range(20) for j in range(4) if scores[d, j] > 0]
    want = [r for j in range(4) for r in sorted(e for e in every if e[0] == j)[:5]]
    item, score, _, ids = best.best()
    assert list(zip(item, -score, ids, strict=True)) == want

import itertools
import random
import time

import numpy as np
import pytest

from tidemark.llm import license_scan as ls


def words(text):
    return ls._words([text])[1]


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40):
        grams = rng.integers(0, 9, n).astype(np.uint64)
        kept = set(ls.winnow(grams, 4))
        assert all(kept & set(range(i, min(i + 4, n))) for i in range(max(1, n - 3)))
    assert ls.winnow(np.zeros(0, dtype=np.uint64), 4) == []


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        template = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        text = [c for c in template if rng.random() > 0.2] + [rng.choice("abcdefgh") for _ in range(3)]
        assert ls.align(np.array(template), np.array(text), -30, 30)[0] == lcs(template, text)


def test_every_template_is_found_with_its_span():
    index = ls.index_templates(ls.TEMPLATES)
    for name, text in ls.TEMPLATES.items():
        found = ls.scan_words(words(f"some words before. {text} and some after it"), index, 0.8)
        n = len(words(text))
        assert [(index.names[f[0]], *f[1:]) for f in found] == [(name, n, 3, 3 + n)]


def test_changed_templates_and_clean_texts():
    index = ls.index_templates(ls.TEMPLATES)
    mit = words(ls.TEMPLATES["MIT"].replace("free of charge", "at no cost at all").replace("sublicense", "lend"))
    (found,) = ls.scan_words(mit, index, 0.8)
    assert index.names[found[0]] == "MIT" and found[1] >= 0.9 * len(index.words[found[0]])
    assert ls.scan_words(words("the license of the driver was under the seat of the public bus, version 3"), index, 0.8) == []


def test_two_matches_and_repeated_lines(spark):
    text = "x " * 500 + "Released under the MIT License. " + "y " * 3000 + "Licensed under CC BY-NC 4.0. Released under the MIT License."
    rows = ls.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["license"], r["start_word"]) for r in rows] == [(1, "MIT-line", 500), (1, "CC-BY-NC-4.0-line", 3505), (1, "MIT-line", 3512)]
    assert rows[0]["span"] == "released under the mit license" and rows[0]["coverage"] == 1.0


def test_adjacent_copies_are_all_found():
    index = ls.index_templates(ls.TEMPLATES)
    for name, text in ls.TEMPLATES.items():
        n = len(words(text))
        for copies in (2, 3, 7):
            found = ls.scan_words(words(" ".join([text] * copies)), index, 0.8)
            assert [(index.names[f[0]], *f[1:]) for f in found] == [(name, n, i * n, i * n + n) for i in range(copies)]
    (found,) = ls.scan_words(words("Released, if you like it so, under the MIT License."), index, 0.8)
    assert index.names[found[0]] == "MIT-line" and found[1:] == (5, 0, 10)


def test_odd_rows(odd, none):
    assert ls.scan(odd).count() == 0 and ls.scan(none).count() == 0


def test_data_equals_a_plain_search(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"] for r in ls.scan(docs).collect()}
    plain = docs.filter("text rlike '(?i)licensed? under (the|CC BY)|under the MIT License|General Public License'")
    assert {r["doc_id"] for r in plain.select("doc_id").collect()} == got


@pytest.mark.parametrize(
    "text,name",
    [
        ("Licensed under the “Apache License”, Version 2.0.", "Apache-2.0-line"), ("Released under the “MIT License”.", "MIT-line"), ("Released under the MIT\u00a0License…", "MIT-line"),
        ("« Released — under the MIT License »", "MIT-line"), (ls._BSD_TWO + " " + ls._BSD_THIRD, "BSD-3-Clause-conditions"), (ls.TEMPLATES["BSD-3-Clause"].replace("THE COPYRIGHT HOLDER", "SOMEBODY"), "BSD-3-Clause"),
    ],
)
def test_marks_and_related_licenses(text, name):
    index = ls.index_templates(ls.TEMPLATES)
    (found,) = ls.scan_words(words(f"Before it. {text} After it"), index, 0.8)
    assert index.names[found[0]] == name


def test_words_put_into_a_notice():
    """Any number of extra words up to a template's length, in one or more places."""
    index = ls.index_templates(ls.TEMPLATES)
    for name in ("MIT-notice", "GPL-3.0-notice", "Apache-2.0-notice"):
        plain = ls.TEMPLATES[name].split()
        for extra in (1, 8, 9, 20, 40):
            for places in ((len(plain) // 2,), (len(plain) // 4, 3 * len(plain) // 4)):
                text = list(plain)
                for place in reversed(places):
                    text[place:place] = [f"zzz{i}" for i in range(extra)]
                if extra * len(places) > len(index.words[index.names.index(name)]) // 2:
                    continue
                got = ls.scan_words(words(" ".join(text)), index, 0.8)
                assert [(index.names[f[0]], f[1], f[2], f[3]) for f in got] == [(name, len(words(ls.TEMPLATES[name])), 0, len(words(" ".join(text))))]


def best_span(template, text):
    """Words of a longest common subsequence and its narrowest span, over all starts and ends."""
    most, n = lcs(template, text), len(text)
    spans = [(b - a, a, b) for a in range(n) for b in range(a + 1, n + 1) if lcs(template, text[a:b]) == most] if most else []
    return most, min(spans, default=(0, 0, 0))


def test_altered_notices_equal_brute_force():
    rng = random.Random(4)
    template = "this work may be used copied and changed by all who keep this notice in every copy of it".split()
    index = ls.index_templates({"own": " ".join(template)})
    for _ in range(25):
        text = ["aa", "bb", "cc"]
        for w in template:
            chance = rng.random()
            text += [] if chance < 0.06 else [w, f"x{rng.randrange(99)}"] if chance < 0.16 else [f"y{rng.randrange(99)}"] if chance < 0.2 else [w]
        text += ["dd", "ee"]
        most, (length, begin, end) = best_span(template, text)
        got = ls.scan_words(words(" ".join(text)), index, 0.8)
        if most >= 0.8 * len(template):
            ((_, m, a, b),) = got
            assert (m, b - a) == (most, length) and a >= 3 and b <= len(text) - 2
        else:
            assert not got


def test_rows_that_match_in_odd_tables(spark):
    rows = [(1, "Released under the MIT License.", 9, "x"), (1, "Released under the MIT License.", 9, "x"), (None, "Released under the MIT License.", 9, "x")]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string, coverage int, license string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["coverage"], r["span"]) for r in got) == [(i, "MIT-line", 1.0, "released under the mit license") for i in (0, 1, 1)]


def test_spans_and_coverage_of_the_data(spark, data):
    """Every match's words are those of a longest common subsequence of its template and its span, which ends on matched words."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = ls.scan(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert got
    for r in got:
        template, text = words(ls.TEMPLATES[r["license"]]), words(docs[r["doc_id"]])[r["start_word"] : r["end_word"]]
        assert r["n_matched"] == lcs(template, text) and r["n_template"] == len(template) and r["coverage"] == r["n_matched"] / len(template) >= 0.8
        assert text[0] in template and text[-1] in template and (words(r["span"]) == text).all()


def test_bounds_hold_back_no_match():
    """No alignment of a strip matches more words than its bound says, inside the text and at its ends."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        template, text = (rng.integers(1, 7, n).astype(np.uint64) for n in (rng.integers(1, 12), rng.integers(1, 30)))
        width = int(rng.integers(1, 6))
        lows = rng.integers(-14, 34, 4)
        for low, most in zip(lows.tolist(), ls.reachable(template, text, lows, width).tolist(), strict=True):
            assert ls.align(template, text, low, low + width - 1)[0] <= most <= len(template)


def test_long_texts_of_license_words():
    """Boilerplate phrases without a license: the work grows as the text does, by the bounds alone."""
    index = ls.index_templates(ls.TEMPLATES)
    phrase = "this software is provided by the copyright holders in no event shall the author "
    words = ls._words([phrase * 800])[1]
    began = time.perf_counter()
    assert ls.scan_words(words, index, ls.COVERAGE) == []
    assert time.perf_counter() - began < 10
    name = max(ls.TEMPLATES, key=lambda n: len(ls.TEMPLATES[n]))
    held = ls._words([phrase * 300 + ls.TEMPLATES[name] + " " + phrase * 300])[1]
    assert index.names[ls.scan_words(held, index, ls.COVERAGE)[0][0]] == name

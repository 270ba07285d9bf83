import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import near_dedup as nd
from tidemark.llm import textkit as tk


def grams(text, k=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def probability_jaccard(x, y):
    total = 0.0
    for s in x.keys() & y.keys():
        total += 1 / sum(max(x[t] / x[s], y[t] / y[s]) for t in x.keys() | y.keys())
    return total


def classes(rows, threshold=0.8, similarity=lambda x, y: max(len(x.keys() & y.keys()) / len(x.keys() | y.keys()), probability_jaccard(x, y))):
    known = {i: grams(t) for i, t in rows if t}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(known, 2):
        x, y = known[a], known[b]
        if x and y and x.keys() & y.keys():
            if similarity(x, y) >= threshold:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
    return {i: find(i) for i, _ in rows}


def test_exact_similarity():
    rng = random.Random(3)
    for _ in range(40):
        a = " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        b = " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 40)))
        x, y = grams(a, 2), grams(b, 2)
        plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        assert nd.similarity(a, b, 2) == pytest.approx(max(plain, probability_jaccard(x, y)))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    value = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    v, w = np.concatenate((rng.integers(1, 6, 40), np.zeros(20))), np.concatenate((np.zeros(10), rng.integers(1, 6, 50)))
    a, b = np.flatnonzero(v), np.flatnonzero(w)
    size = 4096
    held = nd.signatures(np.concatenate((value[a], value[b])), np.concatenate((np.zeros(len(a), int), np.ones(len(b), int))), np.concatenate((v[a], w[b])).astype(float), 2, size)
    want = probability_jaccard(Counter({i: v[i] for i in a}), Counter({i: w[i] for i in b}))
    assert (held[0] == held[1]).mean() == pytest.approx(want, abs=0.04)
    alone = nd.signatures(value[a], np.zeros(len(a), int), v[a].astype(float), 1, size)
    assert (alone[0] == held[0]).all()  # other documents of a chunk change nothing


def test_shingles_stay_inside_their_text():
    words, offsets = tk.word_hashes([b"a b c", b"", b"a b c d e f", b"  ", b"a b c"])
    value, whose = tk.shingles(words, offsets, 5)
    assert sorted(whose.tolist()) == [0, 2, 2, 4] and value[whose == 0] == value[whose == 4]


def test_classes_equal_brute_force(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows)


def test_planted_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, want = [], {}
    for g in range(12):
        base = [word() for _ in range(300)]
        for c in range(g + 1):  # groups of one to twelve, copies with up to three changed words
            text = list(base)
            for _ in range(min(c, 3)):
                text[rng.randrange(300)] = word()
            rows.append((g * 100 + c, " ".join(text)))
            want[g * 100 + c] = g * 100
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_a_chain_of_copies_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[6 * n : 6 * n + 200])) for n in range(30)]  # neighbours share 0.94, ends nothing
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_sketches_of_short_links_agree(spark):
    """Links of few shingles stay within the bounds of both sketches."""
    rows = []
    for n in range(400):
        for side in range(2):  # 8 shared shingles and one of its own: a similarity of 0.8
            rows.append((2 * n + side, " ".join([f"w{n}x{i}" for i in range(12)] + [f"own{side}"])))
    docs = spark.createDataFrame(rows, "id long, text string")
    sketch = {r["id"]: r["sketch"] for r in nd.fingerprints(docs, 5, *nd.banding(0.8)).collect()}
    fine = {r["id"]: r["fine"] for r in nd.fine_sketches(docs).collect()}
    ones = lambda words: sum(bin(w & (1 << 64) - 1).count("1") for w in words)
    for a in range(0, 800, 2):
        p, q = sketch[a], sketch[a + 1]
        half = len(p) // 2
        assert ones((p[i] ^ q[i]) | (p[half + i] ^ q[half + i]) for i in range(half)) <= nd.sketch_limit(160, 2, 0.8)
        assert ones(x ^ y for x, y in zip(fine[a], fine[a + 1], strict=True)) <= nd.sketch_limit(4096, 1, 0.8)


def test_copies_with_a_passage_repeated(spark):
    """A set Jaccard near 1 links texts whose probability Jaccard is low."""
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(500)]
        passage = words[100:116]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[:100] + passage * 200 + words[100:]))]
        rows += [(10 * g + 2, " ".join(words[:100] + passage * 90 + words[100:] + ["end"]))]
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows) and {r["class_id"] for r in got} == set(range(0, 60, 10))
    assert probability_jaccard(grams(rows[0][1]), grams(rows[1][1])) < 0.5


def test_odd_rows(odd, none):
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    kept = nd.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8)] + [(True, None)]
    assert nd.near_duplicate_classes(none).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_recall_of_links(spark, threshold):
    """Links of texts on both sides of the threshold, some with repeated shingles, against brute force."""
    rng, rows = random.Random(int(100 * threshold)), []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(rng.choice((14, 60, 200)))]
        if g % 3 == 0:
            base = base[:10] * 3 + base[10:]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 4):
            text, n = list(base), len(base)
            for _ in range(rng.randint(0, max(1, n // 12))):
                text[rng.randrange(n)] = f"g{g}new{rng.random()}"
            rows.append((10 * g + c, " ".join(text[: n - rng.randint(0, n // 6)])))
    sets = {i: grams(t) for i, t in rows}
    pairs = {(a, b) for a, b in itertools.combinations(sets, 2) if a // 10 == b // 10 and nd._similarity(sets[a], sets[b]) >= threshold}
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold).collect()}
    assert len(pairs) > 40 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert got == classes(rows, threshold, nd._similarity)


def test_pairs_follow_the_documents(spark, monkeypatch):
    """A large group of near copies makes a few pairs a document, not one for every bucket or member."""
    made, rng = [], random.Random(8)
    plain = nd.verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(nd, "verified", counted)
    base = [f"w{i}" for i in range(230)]
    rows = []
    for n in range(300):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(230)] = f"own{n}x{rng.random()}"
        rows.append((n, " ".join(text)))
    got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes(rows, similarity=nd._similarity)
    assert made[0] <= 300 and sum(made) <= 600


def test_rows_of_one_id_in_any_order(spark):
    """An id with several texts links what is linked to any of them; the order of rows makes no difference."""
    text = lambda g, extra="": " ".join([f"g{g}w{i}" for i in range(120)] + [extra])
    rows = [(1, text(0)), (1, text(1)), (2, text(0, "end")), (3, text(1, "end")), (4, text(2)), (4, None), (5, text(2, "x")), (6, text(3)), (6, text(4)), (6, text(3)), (7, "short one"), (1, ""), (8, text(4, "y"))]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 6}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = nd.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == want and len(got) == len(want)


def alike(n, shared, own, seed=7):
    """n texts of one template: `shared` words of it and `own` words of their own."""
    rng = random.Random(seed)
    return [(i, " ".join([f"w{j}" for j in range(shared)] + [f"own{rng.random()}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize("own", [26, 40])
def test_texts_alike_below_the_threshold_make_no_pairs(spark, monkeypatch, own):
    """Groups of texts of one template: the pairs that are worked out grow about as the texts do."""
    counts = {}
    plain = nd.sharing
    for n in (100, 200, 400):
        counts[n] = 0

        def counted(postings, comp, threshold, n=n):
            # pairs at each shingle that the join works out, before any other test
            rows = postings.join(comp, "id").collect()
            left, right = (Counter((r["shingle"], r["key"]) for r in rows if r["left"] == side) for side in (True, False))
            counts[n] = sum(c * right[at] for at, c in left.items())
            return plain(postings, comp, threshold)

        monkeypatch.setattr(nd, "sharing", counted)
        got = nd.near_duplicate_classes(spark.createDataFrame(alike(n, 130, own), "doc_id long, text string")).collect()
        assert all(r["class_id"] == r["doc_id"] for r in got)
    assert counts[400] <= 5 * max(counts[100], 100 * own)


def test_prefixes_lose_no_link(spark):
    """Every link of random pairs around the threshold, repeated shingles included, meets at a posting."""
    rng, rows = random.Random(11), []
    for g in range(60):
        base = [f"g{g}w{rng.randrange(90)}" for _ in range(rng.choice([9, 30, 120]))]
        for c in range(3):
            text = list(base) if c else base + base[: len(base) // 3]
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = f"new{rng.random()}"
            rows.append((10 * g + c, " ".join(text)))
    docs = spark.createDataFrame(rows, "id long, text string")
    for threshold in (0.5, 0.8):
        comp = docs.selectExpr("id", "id as comp")
        met = {(r["a"], r["b"]) for r in nd.sharing(nd.prefixes(docs, 5, threshold, slots=64), comp, threshold).collect()}
        sets = {i: grams(t) for i, t in rows}
        links = {(a, b) for a, b in itertools.combinations(sets, 2) if a // 10 == b // 10 and nd._similarity(sets[a], sets[b]) >= threshold}
        assert len(links) > 20 and links <= met
        assert len(met) < 8 * len(links)


def test_common_weights_bound_the_similarity():
    """The probability Jaccard is at most 1 / (1/u + 1/v - 1), u and v being the shares of the common shingles in both weights."""
    rng = random.Random(5)
    for _ in range(2000):
        x, y = (Counter({rng.randrange(12): rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randint(1, 10))}) for _ in range(2))
        both = x.keys() & y.keys()
        if both:
            u, v = (sum(z[s] for s in both) / z.total() for z in (x, y))
            assert probability_jaccard(x, y) <= 1 / (1 / u + 1 / v - 1) + 1e-12


def test_texts_outside_of_a_large_component_meet_none_of_it(spark):
    """Texts with a passage twice, alike below the threshold: by weight, each outside met all members at several shingles."""
    base = [f"w{i}" for i in range(150)] + [f"w{i}" for i in range(15)]
    rows = [(i, " ".join(base + [f"own{i}x{j}" for j in range(8 if i < 40 else 34)])) for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert 0.75 < nd.similarity(rows[0][1], rows[79][1]) < 0.8 < nd.similarity(rows[0][1], rows[39][1])
    comp = docs.selectExpr("id", "if(id < 40, 0, id) as comp")
    assert nd.sharing(nd.prefixes(docs, 5, 0.8), comp, 0.8).isEmpty()

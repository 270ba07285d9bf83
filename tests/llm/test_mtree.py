import numpy as np
import pytest
from compare import same

from tidemark.llm import mtree, queries


def brute(ids, x, query_id, query, k):
    scored = sorted(((int(v @ query), -int(i)) for i, v in zip(ids, x) if i != query_id), reverse=True)
    return scored[:k]


@pytest.mark.parametrize("kind", ["clusters", "noise", "equal", "ties", "huge"])
def test_tree_equals_brute_force(kind):
    rng = np.random.default_rng(6)
    n, d = 1400, 8
    centres = rng.normal(0, 200, (12, d))
    x = {
        "clusters": centres[rng.integers(0, 12, n)] + rng.normal(0, 5, (n, d)), "noise": rng.normal(0, 60, (n, d)),
        "equal": np.ones((n, d)), "ties": rng.integers(-1, 2, (n, d)), "huge": rng.integers(-(1 << 26), 1 << 26, (n, d)),
    }[kind].astype(np.int64)
    ids = rng.permutation(n) * 3
    tree = mtree.MTree(ids, x, 40)
    worked = 0
    for i in range(0, n, 70):
        found, cost = tree.search(int(ids[i]), x[i], 5, None)
        assert found == brute(ids, x, ids[i], x[i], 5)
        floor = found[-1][0]
        assert tree.search(int(ids[i]), x[i], 5, floor)[0] == found
        worked += cost
    if kind == "clusters":
        assert worked < 0.6 * 20 * n  # the stored bounds spare distances


def test_covering_radii_and_parent_distances_hold():
    rng = np.random.default_rng(7)
    x = rng.integers(-99, 99, (1500, 6))
    tree = mtree.MTree(np.arange(1500), x, 40)

    def below(node):
        routing, radius, *rest = tree.nodes[node]
        leaf = len(rest) == 3
        rows = np.arange(rest[0], rest[1]) if leaf else np.concatenate([below(c) for c in rest[0]])
        heads, to = (rows, rest[2]) if leaf else (np.array([tree.nodes[c][0] for c in rest[0]]), rest[1])
        assert tree._distance(routing, rows).max() <= radius + 1e-6
        assert np.allclose(tree._distance(routing, heads), to)
        return rows

    assert sorted(below(tree.root)) == list(range(1500))


def test_query_equals_sql(spark, duck, data):
    same(queries.op3_top_k(spark, data), duck, queries.oracle_sql()["op3_top_k"])


def test_many_trees_equal_one(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    one = sorted(map(tuple, mtree.top_k(vectors).collect()))
    assert sorted(map(tuple, mtree.top_k(vectors, pivots=5, tree_rows=40).collect())) == one


def test_queries_meet_trees_that_can_hold_a_result_only(spark, monkeypatch):
    """Close clusters: the covering radii keep most queries from most trees; chunks of routing objects change nothing."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 3, (12, 8))
    x = centres[np.arange(1200) % 12] + rng.normal(0, 0.02, (1200, 8))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met, plain = [], mtree._searched

    def counted(pairs, k):
        met.append(pairs.selectExpr("sum(size(queries))").first()[0])
        return plain(pairs, k)

    monkeypatch.setattr(mtree, "_searched", counted)
    routed = sorted(map(tuple, mtree.top_k(df, pivots=24, tree_rows=100).collect()))
    trees = 1200 // 100
    assert met[1] < 0.5 * met[0] * trees
    monkeypatch.setattr(mtree, "ROUTED_TREES", 5)
    assert sorted(map(tuple, mtree.top_k(df, pivots=24, tree_rows=100).collect())) == routed
    assert met[3] == met[1]
    whole = np.floor(256 * x).astype(np.int64)
    assert routed == sorted((q, r + 1, -row, score) for q in range(0, 1200, 50) for r, (score, row) in enumerate(brute(np.arange(1200), whole, q, whole[q], 5)))


def test_long_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (60, 6000))
    got = mtree.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    whole = np.floor(256 * x).astype(np.int64)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted((q, r + 1, -row, score) for q in (0, 50) for r, (score, row) in enumerate(brute(np.arange(60), whole, q, whole[q], 5)))


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [], 1), (5, [None, 1.0], 1), (6, [float("nan"), 1.0], 1),
        (7, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (50, [1.0], 1), (100, [0.0, -1.0], 1), (8, [-0.001, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in mtree.top_k(df).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 100, 0), (0, 4, 8, -256),
        (100, 1, 0, 0), (100, 2, 8, 0), (100, 3, 1, -32768), (100, 4, 2, -32768),
    ]
    assert mtree.top_k(df.limit(0)).count() == 0


def test_ids_with_several_vectors(spark):
    """A candidate counts once for each of its vectors; a query searches by its least and never meets its own id."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.25, 0.5]), (1, [0.25, 0.5]), (2, [0.0, 0.125])]
    for n in (1, 3):
        got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n)).orderBy("rank").collect()
        assert [tuple(r) for r in got] == [(0, 1, 1, 128 * 256), (0, 2, 1, 64 * 256), (0, 3, 2, 32 * 256)]

import hashlib
import random

from compare import same
from pyspark.sql import functions as F

from tidemark.llm import chat_format as cf
from tidemark.llm import queries

SCHEMA = "tree string, id long, parent long, role string, text string, score double"


def test_query_equals_sql(spark, duck, data):
    same(queries.op4_chat_format(spark, data), duck, queries.oracle_sql()["op4_chat_format"])


def test_escapes_turn_back(spark):
    rng = random.Random(8)
    pieces = ["\\", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "a", "\n", "|", "end", "<|end|>", "/"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e")).withColumn("b", cf.unescape(F.col("e"))).collect()
    assert all(r["b"] == r["t"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in cf.CONTROLS)


def test_trees_against_a_walk(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for t in range(12):
        n = rng.randint(1, 40)
        parent = {i: rng.randrange(max(0, i - 4), i) if i else None for i in range(n)}
        score = {i: rng.randrange(5) for i in range(n)}
        rows += [(str(t), i, parent[i], rng.choice(["user", "assistant"]), f"t{t} m{i} </s>", float(score[i])) for i in range(n)]
        ranked = []
        for leaf in set(range(n)) - {p for p in parent.values() if p is not None}:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            ranked.append((-sum(score[i] for i in path), leaf, path[::-1]))
        want[str(t)] = [(leaf, path) for _, leaf, path in sorted(ranked)[:2]]
    text = {(r[0], r[1]): r for r in rows}
    got = cf.format_trees(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        leaf, path = want[r["tree"]][r["rank"] - 1]
        turns = [text[r["tree"], i] for i in path]
        assert r["leaf"] == leaf
        assert r["formatted"] == "".join(f"<|turn|>{m[3]}<|say|>{m[4].replace('</s>', '<' + chr(92) + '/s>')}<|end|>" for m in turns)
        learnt = [r["formatted"][s["start"] : s["end"]].replace("\\", "") for s in r["loss"]]
        assert learnt == [m[4] for m in turns if m[3] == "assistant"]


def test_missing_parents_cycles_and_empty_tables(spark):
    rows = [
        ("a", 1, 9, "user", "orphan", None), ("a", 2, 1, None, None, 1.0),
        ("b", 1, 2, "user", "x", 0.0), ("b", 2, 1, "user", "y", 0.0), ("b", 3, 2, "user", "hangs on a cycle", 0.0), ("c", 1, 1, "user", "own parent", 0.0),
    ]
    got = [(r["tree"], r["leaf"], r["formatted"]) for r in cf.format_trees(spark.createDataFrame(rows, SCHEMA), None).collect()]
    assert got == [("a", 2, "<|turn|>user<|say|>orphan<|end|><|turn|><|say|><|end|>")]
    assert cf.format_trees(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_flat_conversations(spark):
    rows = [(1, 1, "assistant", "b", 1), (1, 0, "user", "a", 1), (None, 0, "user", None, 1), (2, None, "user", "z", 1), (2, 0, "assistant", "", 1), (2, 0, "assistant", "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree int")
    got = {r["conv_id"]: r for r in cf.read_back(cf.format_conversations(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == digest("b") and got[1]["loss_chars"] == 1
    assert got[None]["turns_sha256"] == digest("user\n\n") and got[2]["turns_sha256"] == digest("user\nz\nassistant\n\nassistant\n\n") and got[2]["n_turns"] == 3


def test_a_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hello").alias("text"))
    row = cf.read_back(cf.format_conversations(df)).first()
    assert (row["n_turns"], row["loss_chars"]) == (3000, 7500)


def test_repeated_messages_and_clashing_names(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "worse", 0.5), ("t", 2, 1, "assistant", "better", 2.0), ("t", None, 1, "user", "lost", 9.0), (None, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "rank": F.lit(9), "node": F.lit("y"), "n": F.lit(7)})
    got = {r["tree"]: r for r in cf.format_trees(df, None).collect()}
    assert got["t"]["formatted"] == f"{cf.TURN}user{cf.SAY}q{cf.END}{cf.TURN}assistant{cf.SAY}better{cf.END}" and got["t"]["score"] == 3.0
    assert cf.format_trees(df.limit(0)).count() == 0

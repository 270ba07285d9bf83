"""Chat formatting of reply trees, with DataFrame functions only.

Self-joins that double their reach find the ancestors of every leaf, so paths of n messages take about
log2(n) rounds. Branches are ranked by the sum of their scores, and each chosen path becomes one text:

    <|turn|>role<|say|>text<|end|><|turn|>...

Inside roles and texts a backslash is doubled and one is put into every control string of this and other
common templates, so that none of them is left; dropping the first of every backslash and what follows
it turns that back. The loss mask covers the texts of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>"
#: Control strings that may not occur in a formatted text but as marks: the first character is followed by a backslash there.
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, height) of every message on the way from each leaf up to its root, the leaf at height 0.

    messages: tree, id, parent, unique by (tree, id). A message whose parent is null or missing is a root;
    messages that only lead into a cycle have no root and no path.
    """
    ids = cut(messages.select("tree", "id", "parent"))
    hop = cut(ids.join(ids.select("tree", F.col("id").alias("parent")), ["tree", "parent"]).select("tree", "id", F.col("parent").alias("up")))
    roots = ids.select("tree", "id").join(hop, ["tree", "id"], "left_anti")
    leaves = ids.select("tree", "id").join(ids.filter("parent is not null").select("tree", F.col("parent").alias("id")), ["tree", "id"], "left_anti")
    path = leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).cast("long").alias("height"))
    reach, most = 1, ids.count()
    while reach <= most and not hop.isEmpty():
        above = path.join(hop.withColumnRenamed("id", "node"), ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), F.col("height") + reach)
        path = cut(path.union(above))
        hop = cut(hop.join(hop.select("tree", F.col("id").alias("up"), F.col("up").alias("far")), ["tree", "up"]).select("tree", "id", F.col("far").alias("up")))
        reach *= 2
    if reach > most > 0 and not hop.isEmpty():  # only cycles still have ancestors
        rooted = path.join(roots.withColumnRenamed("id", "node"), ["tree", "node"], "left_semi").select("tree", "leaf")
        path = path.join(rooted, ["tree", "leaf"], "left_semi")
    return path


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss): the `branches` best paths of each tree (None: all) as texts.

    messages: tree, id, parent, role, text, score; null roles and texts count as empty, null scores as 0. Repeated
    rows of one (tree, id) are one message, that of the greatest score, then the least text, role and parent; rows without a tree or an id are
    left out. Other columns are not read; an empty table gives no rows. Ties of score go to the smaller leaf. loss holds (start, end) in code points of formatted.
    """
    order = Window.partitionBy("tree", "id").orderBy(F.desc_nulls_last("score"), "text", "role", "parent")
    messages = messages.select("tree", "id", "parent", "role", "text", "score").filter("id is not null").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
    return _formatted(messages, branches)


def _formatted(messages: DataFrame, branches: int | None) -> DataFrame:
    """As format_trees, of messages unique by (tree, id)."""
    path = paths(messages)
    body = messages.select("tree", F.col("id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    ranked = path.join(body.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    turn = path.join(ranked, ["tree", "leaf"]).join(body.drop("score"), ["tree", "node"])
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAY))
    turn = turn.select("tree", "leaf", "rank", "score", "height", head.alias("head"), escape(F.col("text")).alias("said"), (F.col("role") == "assistant").alias("learn"))
    size = F.length("head") + F.length("said") + len(END)
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("height")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = turn.withColumn("stop", F.sum(size.cast("long")).over(before) - len(END))
    held = F.sort_array(F.collect_list(F.struct((-F.col("height")).alias("at"), "head", "said", "learn", "stop")))
    whole = turn.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), held.alias("turns"))
    return whole.select(
        "tree",
        "leaf",
        "rank",
        "score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["said"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct((t["stop"] - F.length(t["said"])).alias("start"), t["stop"].alias("end"))).alias("loss"),
    )


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss) of flat conversations, each turn replying to the one before.

    Turns stand in the order of turn, then role and text, nulls first; rows with a null conversation form one.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tree", F.to_json(F.struct("conv_id")))
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    done = _formatted(rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score")), None)
    return done.select(F.from_json("tree", f"conv_id {conversations.select(conv_col).schema[0].dataType.simpleString()}")["conv_id"].alias("conv_id"), "formatted", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from formatted and loss."""
    pieces = F.split("formatted", r"<\|end\|>")
    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.split(p, r"<\|say\|>"))
    told = F.transform(turns, lambda t: F.concat(unescape(F.substring(t[0], len(TURN) + 1, 1 << 30)), F.lit("\n"), unescape(t[1]), F.lit("\n")))
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    held = formatted.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.array_join(told, "").alias("told"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return held.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("told", "utf-8"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learnt", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )

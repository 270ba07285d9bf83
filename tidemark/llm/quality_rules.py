"""Host-level quality rules, with DataFrame functions only.

Rules judge each document; their failures are counted by host, the hosts' rates are shrunk towards a beta
prior fitted to all hosts (method of moments), and hosts whose shrunken rate of some rule is too high lose
their documents. A small host thus needs more failures than a large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

MIN_WORDS, REPEAT_PERCENT, WINDOW, HOST_LIMIT = 20, 30, 8, 0.5
SPACE = r"[\x20\x09-\x0D]"


def text_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every whole text, n_lines being those with a word.

    Null texts count as empty. Words are runs without white space. Everything is worked out inside a row, so
    long texts and copies move nothing.
    """
    df = documents.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.select(
        "id",
        "host",
        "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    # a window's hash of its words' hashes; texts with fewer words than a window have none
    codes = F.col("codes")
    window = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("windows", window).drop("codes")
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    at = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.withColumn("at", at).drop("windows")
    twice = F.filter("at", lambda x, i: (x["h"] == F.get(F.col("at"), i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(F.col("at"), i + 1)["h"]).eqNullSafe(True))
    df = df.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("at")
    covered = F.transform("starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - s, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", total).drop("starts")


def rules() -> dict[str, Column]:
    """The rules by name: true where a document fails."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 4 * F.col("n_symbols") > F.col("word_chars"),
        "copied_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
    }


def host_rates(failures: DataFrame, names: list[str]) -> DataFrame:
    """(host, n, and for each rule fails_<name> and rate_<name>): rates shrunk by an empirical beta prior.

    failures: host and a boolean per rule. The prior of a rule has the mean of the hosts' raw rates and the
    variance between hosts: that of the raw rates less what the draw of few documents adds to it. It weighs as
    much as one to a thousand documents; the latter where hosts do not differ beyond that noise, as where each has one document.
    """
    count = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(name)).alias(f"fails_{name}") for name in names])
    count = cut(count)
    raw = [F.col(f"fails_{name}") / F.col("n") for name in names]
    moments = count.agg(*[F.struct(F.avg(r).alias("m"), F.var_pop(r).alias("v")).alias(name) for name, r in zip(names, raw, strict=True)], F.avg(1 / F.col("n")).alias("share")).first()
    out = count
    for name in names:
        m, v, share = moments[name]["m"] or 0.0, moments[name]["v"] or 0.0, moments["share"] or 1.0
        # a raw rate of n documents varies by between + (m (1 - m) - between) / n
        between = (v - m * (1 - m) * share) / (1 - share) if share < 1 else 0.0
        weight = min(max(m * (1 - m) / between - 1, 1.0), 1000.0) if between > 0 else 1000.0
        out = out.withColumn(f"rate_{name}", (F.col(f"fails_{name}") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))
    return out


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: id_col, the statistics, base_failed, kept, host_failed and the host's rates.

    base_failed: the document itself fails `short` or `repeats`. host_failed: some rule's shrunken rate of its
    host exceeds limit. kept: neither. Documents without a host are judged alone. Repeated rows each count.
    """
    base = cut(text_statistics(documents, id_col, text_col, host_col))
    names = list(rules())
    judged = base.withColumns(rules())
    rates = host_rates(judged.filter("host is not null").select("host", *names), names)
    bad = F.lit(False)
    for name in names:
        bad = bad | (F.col(f"rate_{name}") > limit)
    verdict = cut(rates.select("host", bad.alias("host_failed"), *[f"rate_{name}" for name in names]))
    joined = judged.join(verdict, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    failed = F.col("short") | F.col("repeats")
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("host_failed")).alias("kept"), "host_failed", *[f"rate_{name}" for name in names],
    )

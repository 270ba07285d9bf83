"""Mixing of sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed by cell (source, language, topic). The cells' weights are raked in turn to the target
marginals of each dimension, until a round finds no marginal further from its target than a stated residual;
a cell's weight over its tokens, scaled so that the greatest is one, is the probability with which each of
its documents is sampled, by a hash of its id. No document counts twice, so the cell that is furthest
below its target sets how much of the others stays.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, unused_name

DIMENSIONS, SEED = ("source", "lang", "topic"), "mix-1"
#: Raking ends when a round finds every marginal this close to its target. Targets that contradict each other never
#: hold together: it then ends when rounds no longer lessen the residual but by this part of it.
RESIDUAL, NO_FALL = 1e-6, 1e-9
#: Where a round leaves more than this part of the residual, the next ones take its step several times at once.
SLOW = 0.9
#: No cell's weight falls below.
LEAST_WEIGHT = 1e-290
#: Up to this many cells, or values of a dimension, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Default targets: a dimension's natural token shares to this power, scaled to sum to one.
TEMPERS = {"source": 0.95, "lang": 0.95, "topic": 1.0}


def token_count(text: Column) -> Column:
    """Words of a text: runs without white space; null: none."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.size(words).cast("long")


def default_topic(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by form: note, listing (short lines), or prose."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(n_tokens < 50, "note").when(breaks * 40 > n_tokens, "listing").otherwise("prose")


def cell(text: Column, source: Column, lang: Column) -> Column:
    """struct(source, lang, topic); null sources and languages are a value of their own, written `?`."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.coalesce(source.cast("string"), F.lit("?")).alias("source"), F.coalesce(lang.cast("string"), F.lit("?")).alias("lang"), default_topic(text, token_count(text)).alias("topic"))


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, source, lang, topic, n_tokens) of every document."""
    text = F.col(text_col)
    known = documents.select(F.col(id_col).alias("id"), cell(text, F.col(source_col), F.col(lang_col)).alias("cell"), token_count(text).alias("n_tokens"))
    return known.select("id", "cell.*", "n_tokens")


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """(dimension, share): the natural token share of each value raised to `temper` and scaled to sum to one."""
    mass = cut(cells.groupBy(dimension).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    total = mass.agg(F.sum(F.pow("tokens", F.lit(temper))).alias("t")).first()["t"] or 1.0
    return mass.select(dimension, (F.pow("tokens", F.lit(temper)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], residual: float = RESIDUAL) -> tuple[DataFrame, float]:
    """cells (the dimensions, tokens) with `weight`, the raked share of each cell of positive tokens; the residual of the last round.

    targets: for each dimension (value, share). A value without a target keeps no weight; a target whose
    value has no tokens can't be met and is left out, the others growing to sum to one. The cells are a table of their
    own, far smaller than the documents; a step sums weights by one dimension, before any shuffle, and joins the sums back.

    There is no cap on the rounds. Targets that can be met only as some cells vanish are approached ever more slowly: where
    that shows, a round's step, a factor for each cell, is taken twice, four times and so on at once, as long as the residual
    falls by it; such cells still are products of factors of their values, as plain raking has them. An empty table has a residual of 0.
    """
    out = cells.filter("tokens > 0")
    for name, target in targets.items():
        met = target.select(name, F.col("share").alias("aim")).join(out.select(name).distinct(), name, "left_semi").filter("aim > 0")
        whole = met.agg(F.sum("aim").alias("whole"))
        out = out.join(met.crossJoin(F.broadcast(whole)).select(name, (F.col("aim") / F.col("whole")).alias(f"share_{name}")), name)
    out = cut(out.withColumn("weight", F.col("tokens").cast("double")))
    values = out.agg(*[F.count_distinct(name).alias(name) for name in targets]).first()

    def turn(rows: DataFrame) -> tuple[DataFrame, float]:
        """rows after a round, their weights before it as `was`; how far it found a marginal from its target."""
        rows = rows.withColumns({"was": F.col("weight"), "off": F.lit(0.0)})
        for name in targets:
            held = rows.groupBy(name).agg(F.sum("weight").alias("held"))
            share = F.col(f"share_{name}")
            new = {"weight": F.greatest(F.col("weight") * share / F.col("held"), F.lit(LEAST_WEIGHT)), "off": F.greatest("off", F.abs(F.col("held") - share))}
            rows = cut(rows.join(F.broadcast(held) if values[name] <= BROADCAST_ROWS else held, name).withColumns(new).drop("held"))
        return rows, rows.agg(F.max("off").alias("off")).first()["off"] or 0.0

    out, last = turn(out)
    before, times = float("inf"), 1
    while last > residual and last < before * (1 - NO_FALL):
        if last > SLOW * before:
            ahead = F.col("weight") * F.pow(F.col("weight") / F.col("was"), F.lit(float(2 * times - 1)))
            far, off = turn(out.withColumn("weight", F.greatest(F.least(ahead, F.lit(1e3)), F.lit(LEAST_WEIGHT))))
            if off < last:
                out, before, last, times = far, last, off, 2 * times
                continue
            times = 1
        out, off = turn(out)
        before, last = last, off
    if last > residual:
        logging.getLogger(__name__).warning("raking ended with marginals up to %g from their targets", last)
    return out.drop("was", "off", *[f"share_{name}" for name in targets]), last


def uniform(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the id and a seed."""
    digest = F.md5(F.concat_ws("/", F.coalesce(id_column.cast("string"), F.lit("?")), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rates(measures: DataFrame, targets: dict[str, DataFrame] | None = None, tempers: dict[str, float] | None = None) -> DataFrame:
    """(source, lang, topic, rate, residual): the sampling rate of each cell, the greatest being one, and how far the raked marginals are from their targets.

    Without targets each dimension aims at its tempered natural shares. Hinted as broadcast only if the
    cells, once counted, are few.
    """
    dims = list(DIMENSIONS)
    cells = cut(measures.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")))
    aims = targets or {name: tempered(cells, name, (tempers or TEMPERS)[name]) for name in dims}
    raked, residual = rake(cells, aims)
    raked = raked.withColumn("rate", F.col("weight") / F.col("tokens"))
    held = raked.agg(F.max("rate").alias("most"), F.count(F.lit(1)).alias("n")).first()
    rate = raked.select(*dims, (F.col("rate") / F.lit(held["most"] or 1.0)).alias("rate"), F.lit(residual).alias("residual"))
    return F.broadcast(rate) if held["n"] <= BROADCAST_ROWS else rate


def probability(n_tokens: Column, rate: Column) -> Column:
    """Documents without a word carry no token weight and are kept; values without a target are not."""
    return F.when(n_tokens == 0, 1.0).otherwise(F.coalesce(rate, F.lit(0.0)))


def mix(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    targets: dict[str, DataFrame] | None = None, tempers: dict[str, float] | None = None, seed: str = SEED,
) -> DataFrame:
    """(id_col, source, lang, topic, n_tokens, probability, sampled, residual) of every document.

    residual, the same in all rows, tells how far the raked shares are from their targets; null for cells without any target.

    Repeated rows of one id share its draw, as do all rows without an id; null and empty texts are notes of no
    token, which stay; other columns are not read; an empty table gives no rows.
    """
    measures = cut(measured(documents, id_col, text_col, source_col, lang_col))
    joined = measures.join(rates(measures, targets, tempers), list(DIMENSIONS), "left")
    joined = joined.withColumn("probability", probability(F.col("n_tokens"), F.col("rate"))).withColumn("sampled", uniform(F.col("id"), seed) < F.col("probability"))
    return joined.select(F.col("id").alias(id_col), *DIMENSIONS, "n_tokens", "probability", "sampled", "residual")


def sampled_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    targets: dict[str, DataFrame] | None = None, tempers: dict[str, float] | None = None, seed: str = SEED,
) -> DataFrame:
    """The rows of documents that `mix` samples, with their own columns, whatever their names.

    Counts the words of a text once for the cells and once more beside its row, so that no text is shuffled.
    """
    rate = rates(measured(documents, id_col, text_col, source_col, lang_col), targets, tempers)
    own, tokens, found = (unused_name(documents, name) for name in ("mix_cell", "mix_tokens", "mix_rate"))
    rate = rate.select(F.struct(*DIMENSIONS).alias(own), F.col("rate").alias(found))
    text = F.col(text_col)
    known = documents.withColumns({own: cell(text, F.col(source_col), F.col(lang_col)), tokens: token_count(text)}).join(rate, own, "left")
    chosen = known.filter(uniform(F.col(id_col), seed) < probability(F.col(tokens), F.col(found)))
    return chosen.select(*[F.col(f"`{c}`") for c in documents.columns])

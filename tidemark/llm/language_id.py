"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text, marks and digits counting as one word
gap. Each is hashed to a row of an embedding table; a text is the mean of its rows, and a linear layer
with softmax gives the languages. Table and layer are trained in numpy by stochastic gradient descent on
a bounded sample of labelled rows; a part of the sample, held back, sets the temperature of the softmax
and the score below which a prediction is rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches, unused_name

UNDETERMINED = "und"
#: Up to this many counts of languages are broadcast.
MOST_BROADCAST = 10_000
#: Letters by Unicode's categories: number signs and numerals, as ½ or Ⅷ, are none.
_LETTER = regex.compile(r"\p{L}")
_GAP = np.full(256, 0, dtype=np.uint8)
for _b in range(256):
    _GAP[_b] = _b if _b >= 0x80 or chr(_b).isalpha() else 0x20
_ODD = np.uint32(2654435761)


def _rows(text: bytes, bits: int) -> np.ndarray:
    """Embedding rows of the subwords of one lower-cased text."""
    data = _GAP[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    gap = data == 0x20
    keep = np.concatenate(([True], ~(gap[1:] & gap[:-1])))
    data = data[keep].astype(np.uint32)
    out, value = [], data
    for n in (2, 3, 4):
        value = value[:-1] | data[n - 1 :] << np.uint32(8 * (n - 1))
        out.append(((value ^ np.uint32(n)) * _ODD) >> np.uint32(32 - bits))
        if len(value) <= 1:
            break
    return np.concatenate(out)


@dataclass
class LanguageModel:
    """languages: names in order; table: per embedding row the language scores; bias, temperature, reject_below."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    reject_below: float = 0.0
    notes: dict = field(default_factory=dict)

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        raw = text.lower().encode("utf-8", "surrogatepass")
        for first in range(0, len(raw), tk.CHUNK_BYTES):  # bounded memory; pieces overlap so that no subword is lost
            part = raw[max(0, first - 3) : first + tk.CHUNK_BYTES]
            rows = _rows(part, self.bits)
            total += np.bincount(rows, minlength=1 << self.bits) @ self.table if len(rows) > 4096 else self.table[rows].sum(axis=0)
            n += len(rows)
        logits = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        p = self.scores(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[np.ndarray, np.ndarray, str, bool]], bits: int, width: int = 16, epochs: int = 6, rate: float = 2.0, precision: float = 0.995, seed: int = 1) -> LanguageModel:
    """A model from (rows, shares, language, held back) examples; with no example it knows no language."""
    languages = sorted({e[2] for e in examples})
    code = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / width, 1 / width, (1 << bits, width))
    layer = rng.normal(0, 1 / np.sqrt(width), (width, max(1, len(languages))))
    bias = np.zeros(max(1, len(languages)))
    train = [e for e in examples if not e[3]] or examples
    steps, done = epochs * max(1, len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            rows, share, lang, _held = train[i]
            pace = rate * (1 - done / steps)
            hidden = share @ embed[rows]
            error = _softmax(hidden @ layer + bias)
            error[code[lang]] -= 1
            back = layer @ error
            layer -= 0.2 * pace * np.outer(hidden, error)
            bias -= 0.02 * pace * error
            embed[rows] -= (10 * pace * share)[:, None] * back[None, :]
            done += 1
    table = embed @ layer
    model = LanguageModel(languages, table.astype(np.float64), bias, bits)
    held = [e for e in examples if e[3]]
    if held and len(languages) > 1:
        logits = np.array([share @ table[rows] + bias for rows, share, _, _ in held])
        truth = np.array([code[e[2]] for e in held])
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-top)
        good = np.cumsum(right[order]) / np.arange(1, len(held) + 1)
        enough = np.flatnonzero(good >= precision)
        last = enough[-1] if len(enough) else 0
        model.reject_below = 0.0 if last == len(held) - 1 else float(min(top[order][last], 0.5))
        model.notes = {"held": len(held), "accuracy": float(right.mean()), "temperature": model.temperature}
    return model


def train(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = 1200,
    bits: int = 14,
    snippets: int = 3,
) -> LanguageModel:
    """A model learned from at most max_rows labelled rows, shared evenly among the languages.

    Rows whose crc32(id as text) leaves no remainder by 5 are never read. The sample takes the rows of
    each language with the least md5 of the id; the whole text of each is one example, and a few short
    windows of it are others, so that short texts are known too. Examples are made where the rows lie; one
    task learns from the bounded sample and hands back the model. Null languages and null texts take no
    part. A table without labelled rows gives a model that knows no language and predicts `und`.
    """
    base = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and id is not null")
    known = base.filter(F.crc32(F.col("id").cast("string")) % 5 != 0)
    counts = known.groupBy("lang").count()
    sizes = counts.agg(F.count(F.lit(1)).alias("n")).first()
    share = max(1, max_rows // max(1, sizes["n"]))
    # of every language only the rows of the least hashes are ranked: some more than its share, by eight standard deviations
    enough = F.lit((share + 8 * share**0.5 + 16) * 2.0**32) / F.col("count")
    digest = F.md5(F.col("id").cast("string"))
    small = F.broadcast(counts) if sizes["n"] <= MOST_BROADCAST else counts
    few = known.select("id", "lang", digest.alias("key")).join(small, "lang").filter(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") < enough)
    rank = Window.partitionBy("lang").orderBy("key", "id")
    ids = few.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= share).select("id").distinct()

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text, lang in zip(pdf["key"], pdf["text"], pdf["lang"], strict=True):
                rng = np.random.default_rng(int(key[:8], 16))
                words = text.split()
                parts = [text]
                for _ in range(snippets if len(words) > 4 else 0):
                    at, n = rng.integers(0, len(words)), rng.integers(1, 25)
                    parts.append(" ".join(words[at : at + n]))
                for part in parts:
                    if _LETTER.search(part):
                        rows, count = np.unique(_rows(part.lower().encode("utf-8", "surrogatepass"), bits), return_counts=True)
                        out.append((lang, int(key[8:10], 16) < 51, rows.astype(np.int32), (count / count.sum()).astype(np.float32), key))
            yield pd.DataFrame(out, columns=["lang", "held", "rows", "shares", "key"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for pdf in batches:
            found += list(pdf.itertuples(index=False, name=None))
        found.sort(key=lambda e: (e[4], e[0], len(e[2]), e[2].tobytes()))
        model = fit([(np.asarray(rows), np.asarray(shares), lang, bool(held)) for lang, held, rows, shares, _ in found], bits)
        tk.release()
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    sample = known.join(F.broadcast(ids), "id", "left_semi").filter("text is not null").select(digest.alias("key"), "text", "lang")
    examples = bounded_batches(sample).mapInPandas(featurise, "lang string, held boolean, rows array<int>, shares array<float>, key string")
    return pickle.loads(examples.repartition(1).mapInPandas(learn, "model binary").first()["model"])


def prediction(model: LanguageModel, text: Column | str) -> Column:
    """struct(lang_pred, score, rejected) of a text column; null or letter-free texts are `und`, score 0, rejected.

    Said not to be deterministic, so that a filter by it is not worked out a second time below a projection.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [model.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[0] == UNDETERMINED or f[1] < model.reject_below for f in found]})

    return predict.asNondeterministic()(text)


def identify(documents: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every row, repeated rows and null ids included; an empty table gives no rows."""
    found = bounded_batches(documents).select(F.col(id_col).alias(id_col), prediction(model, F.col(text_col)).alias("p"))
    return found.select(id_col, "p.lang_pred", "p.score", "p.rejected")


def keep_identified(documents: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows of documents whose language the model does not reject, with their own columns; lang_col, if named, gets the predicted language."""
    columns, own = documents.columns, unused_name(documents, "language")
    judged = bounded_batches(documents).withColumn(own, prediction(model, F.col(text_col)))
    kept = judged.filter(~F.col(f"{own}.rejected"))
    return kept.select(*[F.col(f"{own}.lang_pred").alias(c) if c == lang_col else F.col(f"`{c}`") for c in columns])

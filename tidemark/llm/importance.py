"""Importance resampling of documents towards the texts of a target, by hashed runs of words.

A document's weight is the sum of its features' gains: by how much more often a feature's bucket occurs in the target
than in the documents, a logarithm in thousandths. Buckets are counted, and gains summed up, over arrays of
checksums: the checksum of a run of words follows from those of its words (crc32 is linear), so that each word
is hashed once. Gumbel noise from a hash of the id turns the highest scores into a sample without replacement.

The draw sorts no table. The score from which documents are drawn is found by bisection: jobs that count
the persisted scores at or above some values, exactly, each telling five steps of the search; likewise the id up to which
rows of just that score are drawn. Only the drawn rows are partitioned by ranges of score and id, and numbered from the
rows of the ranges before theirs.

Texts are read whole, a megabyte at a time, null ones as empty: they have no feature, a weight of 0, and are not drawn.
Null ids are hashed as empty and come last among equal scores; repeated rows are documents of their own, and which of
them has the lower rank makes no difference. Empty tables give empty tables; an empty target gives every bucket its
smoothed share. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches, written

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Steps of the bisection that one job tells.
STEPS = 5
#: Bytes of one text that are split into words at a time.
PIECE_BYTES = 1 << 20
#: Of crc32, a fixed value.
POLYNOMIAL = np.uint32(0xEDB88320)


def _tables() -> np.ndarray:
    """[n, j, v]: what a checksum of v << 8j becomes once n zero bytes follow, n up to 255."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ POLYNOMIAL, byte >> 1).astype(np.uint32)
    out = np.empty((256, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 256):
        out[n] = (out[n - 1] >> 8) ^ byte[out[n - 1] & 255]
    return out


_SHIFT = _tables()


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums once so many zero bytes follow each."""
    low, flat = (length & 255) << 10, _SHIFT.ravel()
    out = flat[low + (crc & 255)] ^ flat[low + 256 + ((crc >> 8) & 255)] ^ flat[low + 512 + ((crc >> 16) & 255)] ^ flat[low + 768 + (crc >> 24)]
    far, table = length >> 8, None
    while far.any():  # a table for 256, 512, ... bytes
        table = _moved(_SHIFT[1], _SHIFT[255]) if table is None else _moved(table, table)
        at = np.flatnonzero(far & 1)
        out[at] = _moved(table, out[at])
        far = far >> 1
    return out


def run_checksums(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of the runs of one, two and three words that end at each word, joined by spaces; the first word ends no run of two."""
    one = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    spaced = _shift(np.full(len(words), zlib.crc32(b" "), dtype=np.uint32), size) ^ one
    two, three = one.copy(), one.copy()
    two[1:] = _shift(one[:-1], size[1:] + 1) ^ spaced[1:]
    three[2:] = _shift(two[1:-1], size[2:] + 1) ^ spaced[2:]
    return one, two, three


def _pieces(raw: bytes, size: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in pieces, each with the last two of the piece before; and how many these are."""
    at, last = 0, []
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        words = last + raw[at:end].split()
        yield words, len(last)
        at, last = end, words[-2:]


def features(texts: Sequence[str], buckets: int = BUCKETS, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, how many words, owners, buckets) by parts: the texts' positions and the words new in the part; each feature's text and bucket."""
    held, size = [], 0

    def told():
        skip = np.array([h[2] for h in held])
        count = np.array([len(h[1]) for h in held])
        text = np.array([h[0] for h in held])
        first = np.repeat(np.cumsum(count) - count, count)
        at = np.arange(len(first)) - first
        owner, least = np.repeat(text, count), np.repeat(skip, count)
        runs = run_checksums([w for h in held for w in h[1]])
        inside = [at >= np.maximum(least, k) for k in range(3)]
        whose = np.concatenate([owner[i] for i in inside])
        return text, count - skip, whose, np.concatenate([(r[i] % np.uint32(buckets)).astype(np.int64) for r, i in zip(runs, inside, strict=True)])

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(tk.TERMS)
        for words, skip in _pieces(raw, piece_bytes):
            if len(words) > skip:
                held.append((i, words, skip))
                size += sum(map(len, words))
            if size >= piece_bytes:
                yield told()
                held, size = [], 0
    if held:
        yield told()


def bucket_counts(table: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the features of all texts; every task counts into one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, found in features(batch.column(0).to_pylist(), buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        tk.release()

    found = bounded_batches(table.select(F.col(f"`{text_col}`"))).mapInArrow(count, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain; the driver gets `buckets` pairs of numbers, whatever the size of the tables."""
    held = bucket_counts(documents, text_col, buckets).withColumn("t", F.lit(0).cast("long"))
    wanted = bucket_counts(target, target_col, buckets).select("bucket", F.lit(0).cast("long").alias("n"), F.col("n").alias("t"))
    both = held.unionByName(wanted).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both:
        s[row["bucket"]], t[row["bucket"]] = row["n"], row["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(documents: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_features, weight) of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, number, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for text, count, whose, found in features(batch.column(1).to_pylist(), len(gain)):
                np.add.at(words, text, count)
                number += np.bincount(whose, minlength=batch.num_rows)
                np.add.at(weight, whose, gain[found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(number), pa.array(weight)], ["id", "n_words", "n_features", "weight"])
        tk.release()

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = bounded_batches(rows).mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id_col)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id and the seed."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def highest(rows: DataFrame, value: Column, wanted: int) -> int:
    """The largest number that at least `wanted` of the rows reach, `wanted` being between 1 and their count, by bisection."""
    held = rows.select(value.alias("v"))
    low, high = held.agg(F.min("v"), F.max("v")).first()
    while low < high:  # at least `wanted` rows reach low, fewer reach high + 1
        ends = [(low, high)]
        for _ in range(STEPS):
            ends = [e for a, b in ends for e in (((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if a < b else ((a, b),))]
        cuts = [a for a, _ in ends[1:]]
        reached = held.agg(*[F.count_if(F.col("v") >= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        best = max((i for i in range(len(cuts)) if reached[i] >= wanted), default=-1)
        low, high = ends[best + 1]
    return low


def ranked(rows: DataFrame, order: Callable[[], list[Column]]) -> DataFrame:
    """rows with `rank` from 1: dealt out by ranges of the order, written, and numbered from the rows of earlier ranges."""
    dealt = written(rows.repartitionByRange(*order()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order()))
    return dealt.withColumn("place", place).join(F.broadcast(first), "part").withColumn("rank", F.col("first") + F.col("place")).drop("part", "first", "place")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """scored(id_col, n_words, score) with `rank`, null in rows that are not drawn; scored is read again and again and should be persisted."""
    fit = scored.filter(F.col("n_words") >= least_words)
    wanted = percent * fit.count() // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    score, ident = F.col("score"), F.col(f"`{id_col}`")
    least = highest(fit, score, wanted)
    above, ties, named = fit.agg(F.count_if(score > least), F.count_if(score == least), F.count_if((score == least) & ident.isNotNull())).first()
    drawn = score >= least
    if wanted - above < ties and wanted - above <= named:
        # the complement turns the order of integers round and never overflows
        last = ~highest(fit.filter((score == least) & ident.isNotNull()), F.bitwise_not(ident.cast("long")), wanted - above)
        drawn = (score > least) | ((score == least) & F.coalesce(ident <= last, F.lit(False)))
    drawn = drawn & (F.col("n_words") >= least_words)
    placed = ranked(scored.filter(drawn), lambda: [score.desc(), ident.asc_nulls_last()])
    rank = F.when(F.col("rank") <= wanted, F.col("rank")).cast("long")  # repeated rows of the last id may be one too many
    return placed.withColumn("rank", rank).unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS
) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank) of every row of documents, whose ids are integers; rank is null where it is not drawn."""
    weighed = weights(documents, gains(documents, target, text_col, target_col, buckets), id_col, text_col)
    return draw(written(weighed.withColumn("score", F.col("weight") + noise(F.col(f"`{id_col}`"), seed))), percent, least_words, id_col)


def resampled_documents(documents: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of documents whose id is drawn, with their own columns; rows without an id are not among them."""
    drawn = resample(documents, target, id_col=id_col, **options).filter("rank is not null")
    return documents.join(drawn.select(F.col(f"`{id_col}`")).distinct(), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])

"""Ranked search of all documents for each of a set of items, by one scan with an automaton of all item terms.

No index of the documents is made. The distinct terms of the items, each between two guards, form an Aho-Corasick
automaton that every task builds from a broadcast list; one pass over a text counts the occurrences of all of them. What
matched, a few numbers a document, is persisted, as document frequencies are known only after the whole scan. A
second pass over it maps the automaton's outputs to the items that hold them, adds up scores in a block of
documents by items, and keeps the best documents of each item, first in each task, then among groups of tasks, then over all.

Items are taken in blocks of about BLOCK_SLOTS pairs of item and term, dealt by a hash of the item, so that what is
broadcast is bounded (a single item is never split); each block is one scan.

Texts are read whole, a megabyte at a time; null and empty ones are no document and no item. Rows of one item id are
one item with the terms of all; rows without an item id take no part. Repeated document rows are documents of their own;
ids are integers, null ones come last among equal scores. Empty tables give empty tables; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches, cut, written

TOP = 50
#: Pairs of item and term of which one scan takes about so many.
BLOCK_SLOTS = 100_000
#: Scores that are worked out at a time.
BLOCK_SCORES = 1 << 21
#: Bytes of one text that are scanned at a time.
PIECE_BYTES = 1 << 20
#: Groups of tasks whose best documents meet before those of all tasks do.
SALTS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SCAN = "id long, n long, terms array<int>, counts array<int>"
_held: dict[str, ahocorasick.Automaton] = {}


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item."""
    lower = F.translate(F.col(f"`{text_col}`"), string.ascii_uppercase, string.ascii_lowercase)
    rows = items.select(F.col(f"`{item_col}`").alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return rows.filter("item is not null").distinct()


def automaton(terms: Sequence[bytes], key: str | None = None) -> ahocorasick.Automaton:
    """The automaton of the terms between guards, its outputs their positions; a worker keeps the one of the last key."""
    if key is None or key not in _held:
        found = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            found.add_word(f" {term.decode('latin-1')} ", i)
        if len(found):
            found.make_automaton()
        if key is None:
            return found
        _held.clear()
        _held[key] = found
    return _held[key]


def counted(text: str, terms: ahocorasick.Automaton, piece_bytes: int = PIECE_BYTES) -> tuple[int, np.ndarray, np.ndarray]:
    """How many terms a text has, which of the automaton's terms occur in it, and how often."""
    raw = text.encode("utf-8", "surrogatepass").translate(tk.TERMS)
    n, at, hits = 0, 0, []
    while at < len(raw):
        end = raw.find(b" ", at + piece_bytes)
        end = len(raw) if end < 0 else end
        piece = b" %b " % raw[at:end]
        word = np.frombuffer(piece, dtype=np.uint8) != 0x20
        n += int(np.count_nonzero(word[1:] & ~word[:-1]))
        if len(terms):
            hits.append(np.fromiter((term for _, term in terms.iter(piece.decode("latin-1"))), dtype=np.int32))
        at = end
    which, often = np.unique(np.concatenate(hits) if hits else np.zeros(0, dtype=np.int32), return_counts=True)
    return n, which, often


def scan(documents: DataFrame, terms: Broadcast, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, counts) of every document with at least one term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton(terms.value, key)
        for batch in batches:
            told = [counted(t or "", known) for t in batch.column(1).to_pylist()]
            keep = [i for i, t in enumerate(told) if t[0]]
            ends = np.cumsum([0] + [len(told[i][1]) for i in keep])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, dtype=np.int32)] + [told[i][c] for i in keep]), pa.int32())) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([told[i][0] for i in keep], pa.int64()), *lists], ["id", "n", "terms", "counts"])
        tk.release()

    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return bounded_batches(rows).mapInArrow(run, _SCAN)


def document_frequencies(scanned: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs; every task counts into one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(size, dtype=np.int64)
    for row in scanned.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class Best:
    """The best `top` documents of each item among those that were added."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, dtype=np.int64)
        self.rows, self.size, self.limit = [], 0, max(1 << 16, 2 * items * top)

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents by items. Documents below the score that an item's best already reach, or without one, can't be among them."""
        doc, item = np.nonzero(scores >= self.least)
        self.rows.append((item, scores[doc, item], null[doc], ids[doc]))
        self.size += len(doc)
        if self.size > self.limit:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(item, score, whether the id is null, id), by item."""
        item, score, null, ids = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)), *self.rows, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = item[place == self.top - 1]
        self.least[full] = score[order][place == self.top - 1]
        kept = order[place < self.top]
        self.rows, self.size = [(item[place < self.top], score[kept], null[kept], ids[kept])], len(kept)
        return self.rows[0]


def scores(scanned: DataFrame, items: Broadcast, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, score, id): each task's best documents of each item; item is its position in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, postings = items.value
        best, rows = Best(n_items, top), max(1, BLOCK_SCORES // max(1, n_items))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                ids, n, terms, counts = (batch.column(i) for i in range(4))
                doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
                term, tf = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (terms, counts))
                m = np.array([50 + 50 * x * n_docs // n_terms for x in n.to_pylist()], dtype=np.int64)
                value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                total = np.zeros((batch.num_rows, n_items), dtype=np.int64)
                order = np.argsort(term, kind="stable")
                edges = np.flatnonzero(np.diff(term[order], prepend=-1))
                for part in np.split(order, edges[1:]) if len(order) else ():
                    total[doc[part][:, None], postings[term[part[0]]]] += value[part][:, None]
                best.add(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), total)
        item, score, null, ids = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, pa.int64(), mask=null)], ["item", "score", "id"])
        tk.release()

    return bounded_batches(scanned).mapInArrow(run, "item long, score long, id long")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_documents(
    documents: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_slots: int = BLOCK_SLOTS
) -> DataFrame:
    """(item_col, rank, id_col, score): each item's best documents with a score above 0, at most `top`, equal scores by id."""
    spark = documents.sparkSession
    pairs = cut(item_terms(items, item_col, item_text_col))
    blocks = max(1, math.ceil(pairs.count() / block_slots))
    result = None
    for block in range(blocks):
        held: dict[bytes, list[int]] = {}
        number: dict[object, int] = {}
        for row in pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect():
            held.setdefault(row["term"].encode(), []).append(number.setdefault(row["item"], len(number)))
        terms = sorted(held)
        scanned = written(scan(documents, spark.sparkContext.broadcast(terms), uuid.uuid4().hex, id_col, text_col))
        n_docs, n_terms = scanned.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.floor(1000 * np.log((2.0 * n_docs + 2.0) / (2.0 * document_frequencies(scanned, len(terms)) + 1.0))).astype(np.int64)
        postings = spark.sparkContext.broadcast((len(number), [np.array(sorted(held[t])) for t in terms]))
        found = scores(scanned, postings, weight, n_docs, n_terms, top).withColumn("salt", F.spark_partition_id() % SALTS)
        ranked = _first(_first(found, ["item", "salt"], top).drop("salt", "rank"), ["item"], top)
        named = spark.createDataFrame([(n, i) for i, n in number.items()], f"item long, item_id {pairs.schema['item'].dataType.simpleString()}")
        told = ranked.join(F.broadcast(named), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        result = told if result is None else result.unionByName(told)
    return result

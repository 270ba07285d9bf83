"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its word shingles, the weight being how often a shingle occurs. Each
shingle owns a Poisson process whose arrivals are dealt to signature registers at random; a register
keeps the shingle of its earliest arrival, and a document stops drawing once no later arrival can win a
register. Two registers then agree with the probability Jaccard similarity of the documents. Documents whose
shingles occur unequally often have a second set of registers in which every shingle weighs the same, so that
registers agree with the set Jaccard similarity too.

Null and word-free texts take no part: each is a class of its own. Texts of fewer than k words are one
shingle. Case is ignored and words are runs without white space.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches, components, cut, unused_name, written

SHINGLE, THRESHOLD = 5, 0.8
#: Chance that a pair at the threshold shares no band, and share of a band's registers' agreement at the threshold that its rows aim at.
ESCAPE, AGREE = 3.2e-6, 0.328
#: Registers of the one-bit sketch of documents that are compared across components.
FINE_REGISTERS = 4096
#: Sketches rule a pair out that differs in this many standard deviations more positions than a link makes them.
DEVIATIONS = 5
#: Slots of hashes by which shingles are counted, a power of two.
SLOTS = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): a pair of similarity `threshold` shares a band but for a chance of ESCAPE."""
    rows = max(1, round(math.log(AGREE) / math.log(threshold))) if threshold < 1 else 16
    return (math.ceil(math.log(ESCAPE) / math.log(1 - threshold**rows)) if threshold < 1 else 1), rows


def sketch_limit(size: int, bits: int, threshold: float) -> int:
    """In how many of `size` positions of `bits` bits the sketches of a pair of similarity `threshold` may differ."""
    p = (1 - threshold) * (1 - 0.5**bits)
    return math.floor(size * p + DEVIATIONS * math.sqrt(size * p * (1 - p)))


def signatures(value: np.ndarray, whose: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """ProbMinHash registers, n_docs by size, of documents that each have at least one shingle."""
    least = np.full(n_docs * size, np.inf)
    held = np.zeros(n_docs * size, dtype=np.uint64)
    active = np.arange(len(value))
    clock = np.zeros(len(value))
    drawn, block = 0, 1
    while len(active):
        draw = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64)
        noise = tk.mix(value[active][:, None] + draw[None, :] * _STEP)
        times = np.cumsum(-np.log(tk.uniform(noise)) / weight[active][:, None], axis=1)
        times += clock[active][:, None]
        register = (tk.mix(noise + np.uint64(1)) % np.uint64(size)).astype(np.int64)
        place = (whose[active][:, None] * size + register).ravel()
        when = times.ravel()
        early = np.flatnonzero(when < least[place])
        place, when = place[early], when[early]
        np.minimum.at(least, place, when)
        won = when == least[place]
        held[place[won]] = value[active][early[won] // block]
        clock[active] = times[:, -1]
        last = least.reshape(n_docs, size).max(axis=1)
        active = active[clock[active] <= last[whose[active]]]
        drawn += block
        block = max(1, min(2 * block, 1 + 400_000 // max(1, len(active))))
    return held.reshape(n_docs, size)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as signed 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.int64)


def _bits(held: np.ndarray) -> np.ndarray:
    """A hash of every register's shingle and number, so that the bits of registers with different shingles are independent however few the shingles are."""
    return tk.mix(held + np.arange(held.shape[1], dtype=np.uint64) * _STEP)


def _uneven(local: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Which of n_docs documents have shingles of different weights: those whose registers change where all weigh the same."""
    least, most = np.full(n_docs, np.inf), np.zeros(n_docs)
    np.minimum.at(least, local, weight)
    np.maximum.at(most, local, weight)
    return least < most


def _plain(value: np.ndarray, local: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The uneven documents and their registers where all shingles weigh the same."""
    uneven = _uneven(local, weight, n_docs)
    which = np.flatnonzero(uneven)
    if not len(which):
        return which, np.zeros((0, size), dtype=np.uint64)
    at = uneven[local]
    return which, signatures(value[at], np.searchsorted(which, local[at]), np.ones(at.sum()), len(which), size)


def _keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket ids of every band of the registers."""
    key = np.zeros((len(held), bands), dtype=np.uint64)
    split = held.reshape(len(held), bands, rows)
    for r in range(rows):
        key = tk.mix(key * _STEP + split[:, :, r])
    return tk.mix(key + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)


def _sketch(held: np.ndarray) -> np.ndarray:
    low = _bits(held)
    return np.concatenate((_pack((low & np.uint64(1)).astype(np.uint8)), _pack((low >> np.uint64(7) & np.uint64(1)).astype(np.uint8))), axis=1)


def _describe(texts: list[str], k: int, bands: int, rows: int) -> tuple[list, list, list, np.ndarray]:
    """Bucket ids, sketches by weight and by set, and whether the text has a word, for one batch of whole texts."""
    buckets, sketches, plain, has_words = [None] * len(texts), [None] * len(texts), [None] * len(texts), np.zeros(len(texts), dtype=bool)
    for first, parts in tk.chunks(texts, 1 << 19):
        value, whose, weight = tk.weighted(*tk.shingles(*tk.word_hashes(parts), k))
        docs, local = np.unique(whose, return_inverse=True)
        if not len(docs):
            continue
        held = signatures(value, local, weight, len(docs), bands * rows)
        key, sketch = _keys(held, bands, rows), _sketch(held)
        for row, doc in enumerate(docs):
            buckets[first + doc], sketches[first + doc] = key[row], sketch[row]
        which, held = _plain(value, local, weight, len(docs), bands * rows)
        for row, other, alike in zip(which, _keys(held, bands, rows), _sketch(held), strict=True):
            buckets[first + docs[row]], plain[first + docs[row]] = np.union1d(key[row], other), alike
        has_words[first + docs] = True
    return buckets, sketches, plain, has_words


def fingerprints(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, buckets, sketch, plain) of each row of docs(id, text) whose text has a word; plain is null where it is the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            buckets, sketches, plain, has = _describe([t.lower() for t in pdf["text"]], k, bands, rows)
            tk.release()
            yield pd.DataFrame({"id": pdf["id"], "digest": pdf["digest"], "buckets": buckets, "sketch": sketches, "plain": plain})[has]

    base = docs.select("id", F.md5(F.encode("text", "utf-8")).alias("digest"), "text")
    return base.mapInPandas(run, "id long, digest string, buckets array<long>, sketch array<long>, plain array<long>")


def _shingles(text: str, k: int) -> Counter:
    words = text.lower().encode("utf-8", "surrogatepass").split()
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def _similarity(x: Counter, y: Counter) -> float:
    """The larger of the probability Jaccard and the set Jaccard of two weighted sets."""
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    plain = len(both) / (len(x) + len(y) - len(both))
    if x.total() == len(x) and y.total() == len(y):
        return plain
    v = np.array([x[s] for s in both], dtype=float)
    w = np.array([y[s] for s in both], dtype=float)
    ratio = v / w
    order = np.argsort(ratio)
    v, w, ratio = v[order], w[order], ratio[order]
    only_x, only_y = x.total() - v.sum(), y.total() - w.sum()
    # sum over j of max(v_j / v_i, w_j / w_i): w rules where v_j / w_j is below v_i / w_i
    below = np.searchsorted(ratio, ratio, side="left")
    w_sum, v_sum = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(v)))
    total = (w_sum[below] + only_y) / w + (v_sum[-1] - v_sum[below] + only_x) / v
    return max(plain, float((1.0 / total).sum()))


def similarity(a: str, b: str, k: int = SHINGLE) -> float:
    """The larger of the exact probability Jaccard and the exact set Jaccard of the k-word shingles of two texts."""
    return _similarity(_shingles(a, k), _shingles(b, k))


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """pairs(a, b) with the exact similarity of their whole texts(id, text); pairs of one `a` lie together, so that its shingles are made once."""

    @F.pandas_udf("double")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out, known, shingles = [], None, Counter()
        for a, b in zip(left, right, strict=True):
            if a != known:
                known, shingles = a, _shingles(a, k)
            out.append(_similarity(shingles, _shingles(b, k)))
        tk.release()
        return pd.Series(out, dtype=float)

    a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", similar("text_a", "text_b").alias("sim"))


def fine_sketches(texts: DataFrame, k: int = SHINGLE, size: int = FINE_REGISTERS) -> DataFrame:
    """(id, fine, fine_plain): one bit of each of `size` registers of texts(id, text) that have a word; fine_plain is null where it is fine."""

    def one_bit(held: np.ndarray) -> np.ndarray:
        return _pack((_bits(held) & np.uint64(1)).astype(np.uint8))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for first, parts in tk.chunks([t.lower() for t in pdf["text"]], 1 << 17):
                value, whose, weight = tk.weighted(*tk.shingles(*tk.word_hashes(parts), k))
                docs, local = np.unique(whose, return_inverse=True)
                if len(docs):
                    held = signatures(value, local, weight, len(docs), size)
                    plain = [None] * len(docs)
                    which, other = _plain(value, local, weight, len(docs), size)
                    for row, bits in zip(which, one_bit(other), strict=True):
                        plain[row] = bits
                    yield pd.DataFrame({"id": ids[first + docs], "fine": list(one_bit(held)), "fine_plain": plain})

    return texts.mapInPandas(run, "id long, fine array<long>, fine_plain array<long>")


def _classes() -> np.ndarray:
    """The least sizes of classes of sets, each about a twentieth above the one before."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 53 // 50)))
    return np.array(edges)


_LEAST = _classes()
#: The key of postings for weights; those for sets have the two classes of sizes that they are good for.
BY_WEIGHT = -1


def _prefix_rows(texts: list[str], ids: np.ndarray, k: int, threshold: float, held: np.ndarray) -> Iterator[pd.DataFrame]:
    """Postings of one batch of texts: of each document its rarest shingles, as far as a link to sets of each class of sizes needs."""
    share = threshold / (1 + threshold)
    for first, parts in tk.chunks(texts, 1 << 19):
        value, whose, weight = tk.weighted(*tk.shingles(*tk.word_hashes(parts), k))
        if not len(value):
            continue
        order = np.lexsort((value, held[value & np.uint64(len(held) - 1)], whose))
        value, whose, weight = value[order].view(np.int64), whose[order], weight[order]
        new = np.flatnonzero(np.diff(whose, prepend=-1))
        n = np.diff(np.append(new, len(whose)))  # of each document
        place = np.arange(len(whose)) - np.repeat(new, n)
        own = np.searchsorted(_LEAST, n, side="right") - 1

        def told(keep: np.ndarray, key: np.ndarray, left: np.ndarray, whole: np.ndarray = n, gone: np.ndarray = place, n: np.ndarray = n, value: np.ndarray = value, whose: np.ndarray = whose, first: int = first) -> pd.DataFrame:
            at = np.flatnonzero(keep)
            wide = lambda column: np.repeat(column, n)[at]
            return pd.DataFrame({"shingle": value[at], "key": wide(key), "left": wide(left), "id": ids[first + whose[at]], "n": wide(whole), "place": gone[at]})

        for apart in range(len(_LEAST)):
            bigger, smaller = np.minimum(own + apart, len(_LEAST) - 1), np.maximum(own - apart, 0)
            as_left = n - np.ceil(share * (n + _LEAST[bigger]) - 1e-9) + 1
            as_right = np.where((own >= apart) & (_LEAST[np.minimum(smaller + 1, len(_LEAST) - 1)] - 1 >= threshold * n - 1e-9), n - np.ceil(share * (n + _LEAST[smaller]) - 1e-9) + 1, 0)
            if (as_left <= 0).all() and (as_right <= 0).all():
                break
            yield told(place < np.repeat(as_left, n), own << 16 | bigger, np.ones(len(n), dtype=bool))
            yield told(place < np.repeat(as_right, n), smaller << 16 | own, np.zeros(len(n), dtype=bool))
        total = np.add.reduceat(weight, new)
        gone = np.cumsum(weight) - weight
        gone = gone - np.repeat(gone[new], n)  # of the document's weight, before this shingle
        mass, uneven = np.repeat(total, n) - gone >= np.repeat(total, n) * (threshold - 1e-9), np.maximum.reduceat(weight, new) > np.minimum.reduceat(weight, new)
        weighs, whole, gone = np.full(len(n), BY_WEIGHT), np.rint(total).astype(np.int64), np.rint(gone).astype(np.int64)
        yield told(mass & np.repeat(uneven, n), weighs, np.ones(len(n), dtype=bool), whole, gone)
        yield told(mass, weighs, np.zeros(len(n), dtype=bool), whole, gone)


def shingle_counts(texts: DataFrame, k: int, slots: int) -> np.ndarray:
    """How many of the texts(text) have a shingle of each slot of hashes; the driver gets `slots` numbers, whatever the size of the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, dtype=np.int64)
        for pdf in batches:
            for _, parts in tk.chunks([t.lower() for t in pdf["text"]], 1 << 19):
                value, _, _ = tk.weighted(*tk.shingles(*tk.word_hashes(parts), k))
                total += np.bincount((value & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        tk.release()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"slot": at, "n": total[at]})

    out = np.zeros(slots, dtype=np.int64)
    for row in texts.select("text").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[row["slot"]] = row["n"]
    return out


def prefixes(texts: DataFrame, k: int, threshold: float, slots: int = SLOTS) -> DataFrame:
    """(shingle, key, left, id, n, place): postings of the rarest shingles of texts(id, text).

    Shingles are ordered by how often their slot occurs, then by their hash: one order for all documents. A set link of x and
    y shares at least t/(1+t) of |x| + |y| shingles, so that the first of them in the order is, in each, among as many as
    leave no fewer. How many that are follows from the other's size: a document is posted for each class of sizes that can be
    linked to its own, as the left side for its own and larger ones, as the right side for its own and smaller ones.

    The probability Jaccard of two documents whose common shingles have the shares u and v of their weights is at most
    1 / (1/u + 1/v - 1), and so at most u and v, so that a link shares a shingle among the first of both that leave no less than t; it tells
    from the set Jaccard only where the weights of one are uneven, which is the left side then. n and place are the document's weight and
    how much of it lies before the shingle there, its number of shingles and how many are before it elsewhere.

    Why that bound holds: with p = u * r and q = v * s on the common shingles, where r and s each sum up to 1, the sum that stands below 1 for a shingle i is
    at least max(1/r_i, 1/s_i) + (1/u - 1) / r_i + (1/v - 1) / s_i, thus at least (1/u + 1/v - 1) times a weighted mean of 1/r_i and 1/s_i. Its inverse
    is at most the same mean of r_i and s_i, by weights that do not depend on i, over that factor; these means add up to 1.
    """
    held = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, k, slots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from _prefix_rows([t.lower() for t in pdf["text"]], pdf["id"].to_numpy(), k, threshold, held.value)
        tk.release()

    return texts.select("id", "text").mapInPandas(run, "shingle long, key long, left boolean, id long, n long, place long")


def sharing(postings: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of different components (id, comp) whose postings a link of that threshold needs to meet.

    At each shingle and key the left rows outside of its largest component meet all right ones, and those inside only the right ones
    outside, so that members of one large component never meet each other. Texts of one template, alike below the
    threshold, have no postings at a common shingle.
    """
    placed = cut(postings.join(comp, "id"))
    parts = placed.groupBy("shingle", "key", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("shingle", "key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    rows = cut(placed.join(largest.filter("parts > 1").select("shingle", "key", "main"), ["shingle", "key"]).withColumn("outside", F.col("comp") != F.col("main")))
    # of one class, both rows of a document are on both sides: who is outside meets all on the left already
    one_class = (F.col("key") >= 0) & (F.shiftright("key", 16) == F.col("key").bitwiseAND(F.lit(0xFFFF)))
    tags = lambda zero, one: F.filter(F.array(F.when(zero, 0), F.when(one, 1)), lambda t: t.isNotNull())
    left = rows.filter("left").withColumn("tag", F.explode(tags(F.col("outside"), ~F.col("outside") & ~one_class)))
    right = rows.filter("not left").withColumn("tag", F.explode(tags(F.lit(True), F.col("outside"))))
    named = lambda df, side: df.select("shingle", "key", "tag", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "comp", "n", "place")])
    met = named(left, "l").join(named(right, "r"), ["shingle", "key", "tag"]).filter("l_comp <> r_comp")
    common = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("l_n") + F.col("r_n")) - F.lit(1e-9))
    # of the weight of either side, no more is common than what is left from the first common shingle on
    inverse = F.col("l_n") / (F.col("l_n") - F.col("l_place")) + F.col("r_n") / (F.col("r_n") - F.col("r_place")) - 1
    by_weight = (F.col("key") == BY_WEIGHT) & (inverse <= 1 / threshold + 1e-9)
    fits = by_weight | (F.col("key") >= 0) & ((F.col("l_n") - F.col("l_place") >= common) & (F.col("r_n") - F.col("r_place") >= common))
    return met.filter(fits).select(*_ordered("l_id", "r_id")).distinct()


def differing(left: Column, right: Column, words: range, planes: int = 1) -> Column:
    """In how many positions two sketches of packed bits differ; `planes` bits, one after the other, make a position."""
    if planes == 1:
        apart = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
        return F.aggregate(apart, F.lit(0), lambda total, n: total + n)
    total = F.lit(0)
    for i in words:
        apart = None
        for p in range(planes):
            at = F.lit(i + p * len(words))
            bits = F.get(left, at).bitwiseXOR(F.get(right, at))
            apart = bits if apart is None else apart.bitwiseOR(bits)
        total = total + F.bit_count(apart)
    return total


def finely(pairs: DataFrame, fine: DataFrame, limit: int) -> DataFrame:
    """pairs(a, b) whose fine sketches, by weight or by set, differ in no more positions than limit."""
    for side in ("a", "b"):
        pairs = pairs.join(fine.select(F.col("id").alias(side), F.col("fine").alias(f"fine_{side}"), F.col("fine_plain").alias(f"plain_{side}")), side)
    words = range(FINE_REGISTERS // 64)
    whole = [F.coalesce(f"plain_{side}", f"fine_{side}") for side in ("a", "b")]
    by_set = (F.col("plain_a").isNotNull() | F.col("plain_b").isNotNull()) & (differing(*whole, words) <= limit)
    return pairs.filter((differing(F.col("fine_a"), F.col("fine_b"), words) <= limit) | by_set).select("a", "b")


def _torn(crowd: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component: (bucket, id, comp, main, one).

    main is the bucket's largest component and one of its members, picked by a hash. Members are counted by
    bucket and component before they meet, so that a large bucket is never gathered in one task.
    """
    placed = cut(crowd.join(comp, "id").select("bucket", "id", "comp"))
    parts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("bucket", "id")).alias("one"))
    largest = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by(F.struct(F.col("comp").alias("main"), "one"), F.struct("n", "comp")).alias("best"))
    return placed.join(largest.filter("parts > 1").select("bucket", "best.*"), "bucket")


def _ordered(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _distance(size: int, left: Callable[[str], Column], right: Callable[[str], Column]) -> Column:
    """In how many positions the sketches of two sides differ, by weight or by set, whichever is less."""
    words = range(-(-size // 64))
    whole = [F.coalesce(side("plain"), side("sketch")) for side in (left, right)]
    by_set = F.when(left("plain").isNotNull() | right("plain").isNotNull(), differing(*whole, words, 2))
    return F.least(differing(left("sketch"), right("sketch"), words, 2), by_set)


def _roots(tree: DataFrame) -> DataFrame:
    """(id, comp) of a forest (id, comp) in which comp is the id's parent, roots being their own: comp becomes the root."""
    tree = cut(tree)
    while True:
        up = tree.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        new = cut(tree.join(up, "comp").select("id", "comp", "above"))
        tree = new.select("id", F.col("above").alias("comp"))
        if new.filter("comp <> above").isEmpty():
            return tree


def _joined_to(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (id, comp) after further links (a, b), worked out between components only."""
    left, right = (comp.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp")) for side in ("a", "b"))
    merged = links.join(left, "a").join(right, "b").filter("a_comp <> b_comp").select(*_ordered("a_comp", "b_comp")).distinct()
    new = components(merged).select(F.col("id").alias("comp"), F.col("comp").alias("new"))
    return cut(comp.join(new, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp")))


def near_duplicate_classes(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    bands: int | None = None,
    rows: int | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: (id_col, class_id), class_id being the least id of its class.

    Classes are the connected components of the verified links among the candidates of the banding, whose
    bands and rows follow from the threshold unless given. Copies of a text are folded into one
    representative by digest. Every document first meets one centre: the least id of most of its buckets. Those whose
    buckets then hold other components meet, of the members that stand for those, the most similar one by their
    sketches: a pair for each document, and one for each document and component. What is still apart
    meets, of the other components, all members with which it shares as rare a shingle as a link needs, and whose sketches
    agree as far as a link makes them, so that no link is left out and texts that are alike below the threshold make no pairs.
    Null and word-free texts are classes of their own. Rows with a null id are dropped; repeated rows of one
    id are one document, in one class with all that is linked to one of its texts, whatever the order of rows. Ids lie between
    -2**62 and 2**62. An empty table gives no rows; other columns are not read.
    """
    usual = banding(threshold)
    bands, rows = bands or usual[0], rows or usual[1]
    size = bands * rows
    docs = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    every = docs.select("id").distinct()
    prints = written(fingerprints(docs, k, bands, rows))
    several = cut(prints.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("id", "least"))
    repeated = not several.isEmpty()
    if repeated:
        prints = written(_told_apart(prints, several))
        docs = _told_apart(docs.withColumn("digest", F.md5(F.encode("text", "utf-8"))), several).drop("digest")
    copies = cut(prints.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "rep"))
    member = prints.select("id", "digest").join(copies, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    single = prints.join(copies, "digest", "left").filter("rep is null or rep = id")
    entry = single.select("id", F.explode("buckets").alias("bucket"))
    centres = entry.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket", "low")
    crowd = cut(entry.join(centres, "bucket").select("bucket", "id", "low"))
    votes = crowd.groupBy("id", "low").agg(F.count(F.lit(1)).alias("n"))
    star = cut(votes.groupBy("id").agg(F.max_by("low", F.when(F.col("id") != F.col("low"), F.struct("n", -F.col("low")))).alias("low")))
    texts = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(star, "id", "left_semi").dropDuplicates(["id"])
    pool = written(texts.join(single.select("id", "sketch", "plain").dropDuplicates(["id"]), "id"))

    def verify(pairs: DataFrame) -> DataFrame:
        return cut(verified(pairs, pool, k))

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.col("sim") >= threshold).select("a", "b")

    def near(pairs: DataFrame) -> DataFrame:
        """pairs with `apart`, without those whose sketches rule a link out."""
        for side in ("a", "b"):
            pairs = pairs.join(pool.select(F.col("id").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("plain").alias(f"plain_{side}")), side)
        apart = _distance(size, lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
        return pairs.withColumn("apart", apart).drop("sketch_a", "sketch_b", "plain_a", "plain_b").filter(F.col("apart") <= limit)

    limit, fine_limit = sketch_limit(size, 2, threshold), sketch_limit(FINE_REGISTERS, 1, threshold)
    seen = verify(star.filter("low is not null").select(F.col("low").alias("a"), F.col("id").alias("b")))
    parent = linked(seen).select(F.col("b").alias("id"), F.col("a").alias("comp"))
    comp = _roots(star.select("id").join(parent, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    stray = _torn(crowd, comp).filter("comp <> main").select("id", "main", *_ordered("id", "one")).distinct().join(seen.select("a", "b"), ["a", "b"], "left_anti")
    best = near(stray).groupBy("id", "main").agg(F.min(F.struct("apart", "a", "b")).alias("best"))
    second = verify(best.select("best.a", "best.b").distinct())
    if not linked(second).isEmpty():
        comp = _joined_to(comp, linked(second))
    left = cut(_torn(crowd, comp).select("id", "comp").distinct())
    if not left.isEmpty():
        rest = written(pool.join(left.select("id"), "id", "left_semi").select("id", "text"))
        cross = sharing(prefixes(rest, k, threshold), left, threshold).join(seen.union(second).select("a", "b"), ["a", "b"], "left_anti")
        alike = cut(near(cross).select("a", "b"))
        if not alike.isEmpty():
            ends = alike.select("a").union(alike.select("b")).distinct().withColumnRenamed("a", "id")
            fine = cut(fine_sketches(rest.join(ends, "id", "left_semi"), k))
            found = linked(verify(finely(alike, fine, fine_limit)))
            if not found.isEmpty():
                comp = _joined_to(comp, found)
    classes = member.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("class_id")).dropDuplicates(["id"])
    if repeated:
        own = prints.filter("of is not null").select("id", "of").distinct().join(classes, "id").select("of", F.col("class_id").alias("a"))
        links = own.join(classes.select(F.col("id").alias("of"), F.col("class_id").alias("b")), "of").filter("a <> b").select("a", "b").distinct()
        merged = components(links).select(F.col("id").alias("class_id"), F.col("comp").alias("new"))
        classes = classes.join(merged, "class_id", "left").select("id", F.coalesce("new", "class_id").alias("class_id"))
    return every.join(classes, "id", "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"))


def _told_apart(rows: DataFrame, several: DataFrame) -> DataFrame:
    """rows(id, digest, ...) with ids of their own, above all others, for further texts of an id, whose id is `of` then."""
    other = F.col("least").isNotNull() & (F.col("digest") != F.col("least"))
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("id", "digest"), F.lit(1 << 61))
    told = rows.join(several, "id", "left").withColumns({"of": F.when(other, F.col("id")), "own": F.when(other, own).otherwise(F.col("id"))})
    return told.drop("id", "least").withColumnRenamed("own", "id")


def keep_one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every near-duplicate class of documents, with their own columns.

    It is a row of the class's least id. Repeated rows of an id count as one document, of which one row stays.
    Rows without an id take part by ids below all others that follow from their texts: all of them with one text, null
    included, count as one document.
    """
    columns, own = documents.columns, unused_name(documents, "near_dedup_id")
    unnamed = F.lit(-(1 << 62)) - F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 61))
    keyed = documents.withColumn(own, F.coalesce(F.col(id_col).cast("long"), unnamed))
    classes = near_duplicate_classes(keyed, own, text_col)
    kept = classes.filter(F.col(own) == F.col("class_id")).select(own)
    return keyed.dropDuplicates([own]).join(kept, own, "left_semi").select(*[F.col(f"`{c}`") for c in columns])

"""Exact top-k search by inner product with M-trees: paged metric nodes, searched best first.

Inner product is no metric, so a vector x of squared norm |x|^2 <= M gets one more coordinate
sqrt(M - |x|^2), and a query a zero: the squared distance of query and vector is then |q|^2 + M - 2 q.x, and
the nearest vectors are those of the greatest product. Vectors are dealt to trees of bounded size by their
nearest pivot (a bounded sample), large shares being dealt on by a hash of the id. A node keeps a routing
object, a covering radius, and its entries' distances to the routing object, by which the triangle
inequality rules entries out before any distance is worked out. Queries first search their own tree; the
scores they find there bound the search of all other trees, and keep them from trees whose covering radius they rule out.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

PIVOTS, TREE_ROWS, QUERY_BLOCK, PAGE, FANOUT = 64, 4096, 256, 512, 8
#: Routing objects of trees that a block of queries meets at a time.
ROUTED_TREES = 2_000


class MTree:
    """An M-tree over integer vectors; a page's rows lie next to each other.

    Leaves: (routing row, radius, first row, last row + 1, distances to the routing row). Inner nodes: (routing
    row, radius, children, their distances to it, their routing rows, their radii).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.page = page
        self._set(ids, vectors)
        self.nodes: list[tuple] = []
        self._order: list[np.ndarray] = []
        self.root = self._build(np.arange(len(ids)))
        order = np.concatenate(self._order)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self._set(ids[order], vectors[order])
        self.nodes = [(int(place[n[0]]), *n[1:]) if len(n) == 5 else (int(place[n[0]]), *n[1:4], place[n[4]], n[5]) for n in self.nodes]
        del self._order

    def _set(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.x = ids, vectors
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.most = int(self.norm.max())
        self.lift = np.sqrt((self.most - self.norm).astype(np.float64))
        # products of doubles are exact as long as all sums stay below 2^53
        self.fast = vectors.astype(np.float64) if self.most < 1 << 50 else vectors

    def __getstate__(self) -> dict:
        return {name: held for name, held in self.__dict__.items() if name != "fast"}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        self.fast = self.x.astype(np.float64) if self.most < 1 << 50 else self.x

    def _distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        gap = (self.x[rows] - self.x[row]).astype(np.float64)
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.lift[rows] - self.lift[row]) ** 2)

    def _build(self, rows: np.ndarray) -> int:
        mean = self.x[rows].mean(axis=0)
        routing = int(rows[np.argmin(((self.x[rows] - mean) ** 2).sum(axis=1))])
        far = self._distance(routing, rows)
        if len(rows) <= self.page:
            first = sum(map(len, self._order))
            self._order.append(rows)
            self.nodes.append((routing, float(far.max()), first, first + len(rows), far))
            return len(self.nodes) - 1
        children = [self._build(part) for part in self._split(rows)]
        heads = np.array([self.nodes[c][0] for c in children])
        radii = np.array([self.nodes[c][1] for c in children])
        self.nodes.append((routing, float(far.max()), np.array(children), self._distance(routing, heads), heads, radii))
        return len(self.nodes) - 1

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Up to FANOUT parts of like size: halves of halves, each between two members far from each other."""
        parts = [rows]
        while len(parts) < FANOUT and max(map(len, parts)) > self.page:
            halves = []
            for part in parts:
                if len(part) <= self.page:
                    halves.append(part)
                    continue
                a = part[np.argmax(self._distance(int(part[0]), part))]
                to_a = self._distance(int(a), part)
                order = np.argsort(to_a - self._distance(int(part[np.argmax(to_a)]), part), kind="stable")
                halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
            parts = halves
        return parts

    def search(self, query_id: int, query: np.ndarray, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, -id) of other ids, best first, of scores of at least floor; and the products worked out."""
        q = query.astype(self.fast.dtype)
        own = int(query @ query)
        if self.fast is not self.x and own >= 1 << 50:  # |q.x| <= |q| |x| would not be exact as a double
            self.fast, q = self.x, query
        square = float(own + self.most)
        best: list[tuple[int, int]] = []
        worked = 1
        least = -math.inf if floor is None else floor

        def reach() -> float:
            return math.inf if least == -math.inf else math.sqrt(max(0.0, square - 2.0 * least)) * (1 + 1e-9) + 1e-6

        limit = reach()
        d = math.sqrt(max(0.0, square - 2.0 * float(self.fast[self.nodes[self.root][0]] @ q)))
        queue = [(max(0.0, d - self.nodes[self.root][1]), self.root, d)]
        while queue:
            low, at, centre = heapq.heappop(queue)
            if low > limit:
                break
            node = self.nodes[at]
            if len(node) == 5:
                _, _, first, last, to = node
                close = np.flatnonzero(np.abs(centre - to) <= limit) + first
                if not len(close):
                    continue
                worked += len(close)
                if len(close) > (last - first) // 2:
                    product = (self.fast[first:last] @ q)[close - first]
                else:
                    product = self.fast[close] @ q
                ok = product >= least
                close, product = close[ok], product[ok]
                if len(close) > k + 1:  # only the page's best can enter, the query's own row aside
                    top = np.lexsort((self.ids[close], -product))[: k + 1] if not (self.ids[close] == query_id).any() else np.arange(len(close))
                    close, product = close[top], product[top]
                for row, score in zip(self.ids[close].tolist(), product.tolist(), strict=True):
                    if row != query_id:
                        if len(best) < k:
                            heapq.heappush(best, (int(score), -row))
                        elif (score, -row) > best[0]:
                            heapq.heapreplace(best, (int(score), -row))
                if len(best) == k and best[0][0] > least:
                    least = best[0][0]
                    limit = reach()
            else:
                _, _, children, to, heads, radii = node
                ok = np.flatnonzero(np.abs(centre - to) - radii <= limit)
                if not len(ok):
                    continue
                worked += len(ok)
                d = np.sqrt(np.maximum(square - 2.0 * (self.fast[heads[ok]] @ q), 0.0))
                for child, dist, bound in zip(children[ok].tolist(), d.tolist(), np.maximum(d - radii[ok], low).tolist(), strict=True):
                    if bound <= limit:
                        heapq.heappush(queue, (bound, child, dist))
        return sorted(best, reverse=True), worked


def integers(vector: Column | str) -> Column:
    """floor(256 * x) of each component; null for vectors that are null, empty or hold a null or non-finite component."""
    column = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(column) > 0), F.transform(column, lambda x: F.floor(F.lit(256) * x.cast("double"))))


_PAIRS = "tree string, block long, queries array<struct<id:bigint,v:array<bigint>,tree:string,floor:bigint>>, home boolean"


def _paired(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """(tree, block, queries, home): for each block of queries and each tree those queries that its covering radius does not rule out.

    blocks: (size, block, queries); trees: (tree, centre, radius, most), the routing object, the covering radius and the greatest
    squared norm. Trees of one size of vectors lie in chunks of about ROUTED_TREES; each block meets each chunk of its size.
    """
    chunks = max(1, -(-trees.count() // ROUTED_TREES))
    routing = trees.groupBy(F.size("centre").alias("size"), F.pmod(F.xxhash64("tree"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("tree", "centre", "radius", "most")).alias("r"))
    held = routing.select("size", "chunk", *[F.col(f"r.{c}").alias(c) for c in ("tree", "centre", "radius", "most")])
    met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(held, ["size", "chunk"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, queries, names, centre, radius, norm in zip(*[pdf[c] for c in ("block", "queries", "tree", "centre", "radius", "most")], strict=True):
                centres, radii, most = np.stack([np.asarray(c, dtype=np.float64) for c in centre]), np.asarray(radius, dtype=np.float64), np.asarray(norm, dtype=np.float64)
                q = np.stack([x["v"] for x in queries]).astype(np.float64)
                own = np.einsum("ij,ij->i", q, q)
                square = own[:, None] + most[None, :]
                floor = np.array([-math.inf if x["floor"] is None or pd.isna(x["floor"]) else x["floor"] for x in queries])
                apart = np.sqrt(np.maximum(square - 2 * q @ centres.T, 0)) - radii[None, :]
                reach = np.sqrt(np.maximum(square - 2 * floor[:, None], 0))
                close = apart <= reach * (1 + 1e-6) + 1e-6 * np.sqrt(square) + 1e-6  # room for rounding
                out = []
                for t in np.flatnonzero(close.any(axis=0)):
                    some = [queries[i] for i in np.flatnonzero(close[:, t]) if queries[i]["tree"] != names[t]]
                    if some:
                        out.append((names[t], block, some, False))
                yield pd.DataFrame(out, columns=["tree", "block", "queries", "home"])

    return met.select("block", "queries", "tree", "centre", "radius", "most").mapInPandas(run, _PAIRS)


_FOUND = "query_id long, vec_id long, score long, home boolean"


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """Searches of the queries (ids, vectors, floors, homes) of each row in the tree of that row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree_id, blob, home, queries in zip(pdf["tree"], pdf["blob"], pdf["home"], pdf["queries"], strict=True):
                tree = pickle.loads(blob)
                for q in queries:
                    vector = np.asarray(q["v"], dtype=np.int64)
                    if len(vector) == tree.x.shape[1] and (home or q["tree"] != tree_id):
                        floor = q["floor"]
                        found, _ = tree.search(q["id"], vector, k, None if floor is None or pd.isna(floor) else int(floor))
                        out += [(q["id"], -row, score, home) for score, row in found]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score", "home"])

    return pairs.select("tree", "blob", "home", "queries").mapInPandas(run, _FOUND)


def top_k(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    pivots: int = PIVOTS,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer products of each row whose id is divisible by `every`.

    Candidates are all rows but those of the query's own id; ties go to the smaller id. Vectors that are
    null, empty or hold a null or non-finite component take no part, nor do null ids; a query meets only
    vectors of its own length. Repeated rows count once, an id with several vectors once for each, as a query by its least;
    an empty table gives no rows; other columns are not read. At most `pivots` vectors, those with the least md5
    of the id, are sampled as pivots.
    """
    base = embeddings.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col)).alias("v")).filter("id is not null and v is not null").distinct()
    sample = [(tuple(r["v"])) for r in base.orderBy(F.md5(F.col("id").cast("string")), "id").limit(pivots).collect()]
    by_length: dict[int, np.ndarray] = {}
    for n in {len(s) for s in sample}:
        by_length[n] = np.array(sorted({s for s in sample if len(s) == n}), dtype=np.float64)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1)
        sizes = vectors.map(len).to_numpy()
        for n, centre in by_length.items():
            mine = np.flatnonzero(sizes == n)
            for first in range(0, len(mine), 4096):
                some = mine[first : first + 4096]
                x = np.stack(vectors.iloc[some].to_list()).astype(np.float64)
                out[some] = np.argmin((centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T, axis=1)
        return pd.Series(out)

    near = cut(base.withColumn("pivot", nearest("v")).withColumn("size", F.size("v")))
    # a row for each length of vectors and pivot: how many trees share what is nearest to it
    shares = cut(near.groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / tree_rows).cast("long").alias("trees")))
    name = F.concat_ws("/", "size", "pivot", "share")
    dealt = near.join(F.broadcast(shares), ["size", "pivot"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("trees")))
    placed = cut(dealt.select("id", "v", "size", name.alias("tree")))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        tree = MTree(pdf["id"].to_numpy()[order], np.stack(pdf["v"].to_list()).astype(np.int64)[order])
        routing, radius = tree.nodes[tree.root][:2]
        return pd.DataFrame({"tree": [key[0]], "blob": [pickle.dumps(tree)], "centre": [tree.x[routing]], "radius": [radius], "most": [tree.most]})

    trees = cut(placed.groupBy("tree").applyInPandas(build, "tree string, blob binary, centre array<bigint>, radius double, most long"))
    query = placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "size", "tree")).alias("q")).select("id", "q.*")
    entry = F.struct("id", "v", "tree", "floor")
    at_home = query.withColumn("floor", F.lit(None).cast("long")).groupBy("tree").agg(F.collect_list(entry).alias("queries")).withColumn("home", F.lit(True))
    first = cut(_searched(trees.join(at_home, "tree"), k))

    floors = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-query.count() // QUERY_BLOCK))))
    others = query.join(floors, "id", "left").groupBy("size", blocks.alias("block")).agg(F.collect_list(entry).alias("queries"))
    spread = _paired(others.withColumn("block", F.col("block").cast("long")), trees.select("tree", "centre", "radius", "most"))
    spread = spread.repartition("tree", "block")
    second = _searched(trees.join(spread, "tree"), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.union(second).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

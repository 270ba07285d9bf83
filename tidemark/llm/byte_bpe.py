"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Texts are split into pieces by the vocabulary's pattern, worked out over whole arrays of code points.
Pieces that a worker has not met before become token-position rows; a recursive query joins them with
the merge table and contracts the leftmost pair of least rank of every piece until none is left.
Decoding joins a document's ids with the vocabulary and gathers the bytes by an ordered aggregation.

Two queries contract. That for short pieces takes the leftmost pair of least rank in every round; that for
long ones takes, in one round, all the pairs that the former would take in a row, from the left. These are
all pairs of the round's least rank, so both give the same tokens: `ordered` says of a rank file that every
token, encoded alone, is put together by merges of lower ranks. Then a pair (x, y) of tokens that lie side by
side in a piece never has a rank below that of x or y: no merge has crossed the ends of x + y so far, so
these bytes went the way that they go alone, and would be one token before a merge of a higher rank. So a
merge of rank r brings up pairs of ranks above r only, and all pairs of rank r, from the left, come first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches

#: Pieces up to this many bytes contract one pair a round, so many of them at once; longer ones all pairs of the least rank.
SHORT_BYTES, SHORT_BATCH, LONG_BATCH = 48, 2_000, 200
#: Pieces that a worker remembers, and the bytes of one; the memory starts anew beyond the former.
REMEMBERED, REMEMBERED_BYTES = 500_000, 1024
DECODE_TOKENS = 100_000
#: Longer texts are encoded in parts of about so many code points.
LONG_TEXT = 1 << 19
_BETWEEN = regex.compile(r"(?<=\S) (?=\S)")
#: Memory of the queries; a batch of long pieces has as much more as its bytes need.
MEMORY_MB, LONG_PIECE_BYTES = 100, 1500

# Rows of all rounds; a piece's rows of its last round are its tokens. k is piece << 8 | position.
_CONTRACT_ONE = """
WITH RECURSIVE s(k, tok, it) AS (
  SELECT k, tok, 0 FROM pieces
  UNION ALL
  SELECT CASE WHEN s.k > b.at THEN s.k - 1 ELSE s.k END, CASE WHEN s.k = b.at THEN b.id ELSE s.tok END, s.it + 1
  FROM s JOIN (
    SELECT w, best >> 32 AS id, (w << 8) | (best & 255) AS at FROM (
      SELECT a.k >> 8 AS w, min((m.id << 32) | (a.k & 255)) AS best
      FROM s a JOIN s n ON n.k = a.k + 1 JOIN merges m ON m.pair = ((a.tok << 32) | n.tok)
      GROUP BY a.k >> 8)) b ON s.k >> 8 = b.w AND s.k <> b.at + 1
)
SELECT k, tok, it FROM s
"""
# Rows are a linked list: k is piece << 32 | position, nx the k of the next token. Rounds write the rows that change
# alone. A run of overlapping pairs is contracted from its left end, every second pair.
_CONTRACT_ALL = """
WITH RECURSIVE s(k, nx, tok) USING KEY (k) AS (
  SELECT k, nx, tok FROM pieces
  UNION
  (WITH p AS (
     SELECT a.k, n.k AS mate, n.nx AS after, m.id FROM recurring.s a JOIN recurring.s n ON n.k = a.nx JOIN merges m ON m.pair = ((a.tok << 32) | n.tok)
   ), b AS (SELECT k >> 32 AS w, min(id) AS id FROM p GROUP BY 1
   ), c AS (SELECT p.k, mate, after, p.id, lag(mate) OVER (ORDER BY p.k) IS DISTINCT FROM p.k AS starts FROM p JOIN b ON p.id = b.id AND p.k >> 32 = b.w
   ), r AS (SELECT *, sum(starts::INT) OVER (ORDER BY k) AS run FROM c
   ), t AS MATERIALIZED (SELECT k, mate, after, id FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY k) % 2 = 1)
   SELECT k, after, id FROM t UNION ALL SELECT mate, -2::BIGINT, -1::BIGINT FROM t)
)
SELECT k, tok FROM s WHERE tok >= 0 ORDER BY k
"""
_DECODE = "SELECT doc, array_to_string(list(piece ORDER BY pos), '') AS text FROM tokens JOIN vocab USING (tok) GROUP BY doc ORDER BY doc"


def _classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 other."""
    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
    text = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, 3, dtype=np.uint8)
    for code, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = code
    return table


def split_pieces(points: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts, given as code points and the offset where each text ends.

    The same pieces as those of the pattern: contractions, an optional space before letters, numbers or
    other marks, white space but for the one before a word, and other white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = classes[points]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    final = np.zeros(n + 1, dtype=bool)
    final[ends] = True
    new |= final[:-1]
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:], [n]))
    kind = kind[start]
    closing = final[end]
    space = kind == 0
    inner = space & ~closing
    blank = points[end - 1] == 0x20
    lends = inner & blank
    after_blank = np.concatenate(([False], lends[:-1]))
    word_start = start - after_blank
    mark = (kind == 3) & (end - start == 1) & (points[start] == 0x27) & ~after_blank & ~closing
    mark &= np.concatenate((kind[1:] == 1, [False]))
    at = np.flatnonzero(mark)
    cut = np.zeros(len(start), dtype=np.int64)
    if len(at):
        first = points[end[at]]
        room = end[at + 1] - start[at + 1] > 1
        second = np.where(room, points[np.minimum(end[at] + 1, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        taken = np.where(one, 1, np.where(two, 2, 0))
        cut[at + 1] = taken
        end = end.copy()
        end[at] += taken
        word_start = word_start + cut
    words = ~space & (word_start < np.where(mark, end, np.concatenate((start[1:], [n]))))
    pieces_start = [word_start[words], start[space & closing], start[inner & (end - start > 1)], (end - 1)[inner & ~blank]]
    pieces_end = [end[words], end[space & closing], (end - 1)[inner & (end - start > 1)], end[inner & ~blank]]
    s, e = np.concatenate(pieces_start), np.concatenate(pieces_end)
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def cut_text(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about `size` code points, cut before a space between two marks that are none: every piece lies in one part."""
    size, first = size or LONG_TEXT, 0
    while m := _BETWEEN.search(text, first + size):
        yield text[first : m.start()]
        first = m.start()
    yield text[first:]


def _equal(left: np.ndarray, begin: np.ndarray, end: np.ndarray, right: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which spans of left have the bytes of their spans of right."""
    size = end - begin
    same = size == last - first
    size = np.where(same, size, 0)
    base = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    apart = left[step + np.repeat(begin - base, size)] != right[step + np.repeat(first - base, size)]
    which = np.flatnonzero(apart)
    if len(which):
        same[np.searchsorted(base, which, side="right") - 1] = False
    return same


class _Vocabulary:
    """The merge table and vocabulary of one rank file in a DuckDB connection, with remembered pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        merges = [(self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        table = pa.table({"pair": pa.array([m[0] for m in merges], pa.int64()), "id": pa.array([m[1] for m in merges], pa.int64())})
        vocab = pa.table({"tok": pa.array(list(self.rank.values()), pa.int64()), "piece": [t.decode("latin-1") for t in self.rank]})
        self.db.register("merges_in", table)
        self.db.register("vocab_in", vocab)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in; CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.classes = _classes()
        self.forget()

    def ordered(self) -> bool:
        """Whether every token of more than one byte, encoded alone, ends with its own merge after merges of lower ranks only."""
        tokens = [t for t in self.rank if len(t) > 1]
        rank = np.array([self.rank[t] for t in tokens])
        for first in range(0, len(tokens), SHORT_BATCH):
            some = tokens[first : first + SHORT_BATCH]
            rows = self._contract_one(some, np.fromiter(map(len, some), dtype=np.int64))
            # a piece's rows of each round: its tokens are merges that were made by then
            which, made = rows["k"] >> 8, rows["tok"]
            last = np.zeros(len(some), dtype=rows["it"].dtype)
            np.maximum.at(last, which, rows["it"])
            final = rows["it"] == last[which]
            mine = rank[first : first + SHORT_BATCH]
            merged = ~np.isin(made, self.byte_rank)
            if (np.bincount(which[final], minlength=len(some)) != 1).any() or (made[final] != mine[which[final]]).any() or (made[merged & ~final] >= mine[which[merged & ~final]]).any():
                return False
        return True

    def forget(self) -> None:
        self.held = np.zeros(0, dtype=np.uint8)
        self.held_at = np.zeros(1, dtype=np.int64)
        self.known = np.zeros(0, dtype=np.uint64)
        self.slot = np.zeros(0, dtype=np.int64)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after the other, and how many each has."""
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.ones(len(pieces), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for short, batch in ((True, SHORT_BATCH), (False, LONG_BATCH)):
            wanted = np.flatnonzero((whole < 0) & ((size <= SHORT_BYTES) == short))
            for first in range(0, len(wanted), batch):
                some = wanted[first : first + batch]
                tokens, per = self._fixpoint([pieces[i] for i in some], size[some], short)
                counts[some] = per
                done.append((some, tokens))
        at = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), dtype=np.uint32)
        flat[at[whole >= 0]] = whole[whole >= 0]
        for some, tokens in done:
            per = counts[some]
            flat[np.repeat(at[some] - (np.cumsum(per) - per), per) + np.arange(len(tokens))] = tokens
        return flat, counts

    def _contract_one(self, pieces: list[bytes], size: np.ndarray) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        which = np.repeat(np.arange(len(pieces)), size)
        place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        return self._run(_CONTRACT_ONE, pa.table({"k": which << 8 | place, "tok": self.byte_rank[data]}))

    def _run(self, query: str, rows: pa.Table) -> dict[str, np.ndarray]:
        self.db.register("pieces", rows)
        out = self.db.execute(query).fetchnumpy()
        self.db.unregister("pieces")
        return out

    def _fixpoint(self, pieces: list[bytes], size: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces by the recursive query, one after the other, and how many each has."""
        if not short:
            data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            which = np.repeat(np.arange(len(pieces)), size)
            end = np.repeat(np.cumsum(size), size)
            place = np.arange(len(data)) - end + np.repeat(size, size)
            k = which << 32 | place
            self.db.execute(f"SET memory_limit = '{MEMORY_MB + (len(data) * LONG_PIECE_BYTES >> 20)}MB'")
            out = self._run(_CONTRACT_ALL, pa.table({"k": k, "nx": np.where(np.arange(len(data)) + 1 == end, -1, k + 1), "tok": self.byte_rank[data]}))
            return out["tok"], np.bincount(out["k"] >> 32, minlength=len(pieces))
        out = self._contract_one(pieces, size)
        which, last = out["k"] >> 8, np.zeros(len(pieces), dtype=out["it"].dtype)
        np.maximum.at(last, which, out["it"])
        final = np.flatnonzero(out["it"] == last[which])
        final = final[np.argsort(out["k"][final])]
        return out["tok"][final], np.bincount(which[final], minlength=len(pieces))

    def _slots(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of each piece's tokens in the memory, which new pieces enter.

        Pieces are looked up by a hash, and every piece's bytes are compared with those that the memory
        has under it: where they differ, the piece is contracted by itself. So are pieces too long to keep.
        """
        key = tk.hash_spans(data, begin, stop)
        distinct, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        odd = ~_equal(data, begin, stop, data, begin[where][inverse], stop[where][inverse])
        short = (stop - begin)[where] <= REMEMBERED_BYTES
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        old = self.known[place] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        slot_of = np.full(len(distinct), -1, dtype=np.int64)
        if old.any():
            at = np.flatnonzero(old)
            slot = self.slot[place[at]]
            same = _equal(data, begin[where[at]], stop[where[at]], self.held, self.held_at[slot], self.held_at[slot + 1])
            slot_of[at[same]] = slot[same]
        fresh = np.flatnonzero(~old & short)
        view = data.tobytes()
        if len(fresh):
            pieces = [view[begin[i] : stop[i]] for i in where[fresh]]
            slot_of[fresh] = self._add(pieces)
            into = np.searchsorted(self.known, distinct[fresh])
            self.known, self.slot = np.insert(self.known, into, distinct[fresh]), np.insert(self.slot, into, slot_of[fresh])
        slots = np.where(odd, -1, slot_of[inverse])
        rest = np.flatnonzero(slots < 0)
        if len(rest):
            mine = [view[begin[i] : stop[i]] for i in rest]
            alone = dict(zip(unique := list(dict.fromkeys(mine)), self._add(unique).tolist(), strict=True))
            slots[rest] = [alone[p] for p in mine]
        return slots

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Contracts pieces and keeps their bytes and tokens; returns their slots."""
        ids, counts = self.contract(pieces)
        slots = len(self.offsets) - 1 + np.arange(len(pieces))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids))
        self.held = np.concatenate((self.held, np.frombuffer(b"".join(pieces), dtype=np.uint8)))
        self.held_at = np.concatenate((self.held_at, self.held_at[-1] + np.cumsum([len(p) for p in pieces])))
        return slots

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if all(len(t) <= LONG_TEXT for t in texts):
            return self._encode(texts)
        out: list[bytes] = []
        for text in texts:
            out.append(b"".join(ids for part in cut_text(text) for ids in self._encode([part])))
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for first, parts in tk.chunks(texts, 1 << 19):
            mine = texts[first : first + len(parts)]
            raw = "".join(mine).encode("utf-32-le", "surrogatepass")
            points = np.frombuffer(raw, dtype=np.uint32)
            text_ends = np.cumsum([len(t) for t in mine])
            starts, ends = split_pieces(points, text_ends, self.classes)
            width = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) + 1
            at = np.concatenate(([0], np.cumsum(width)))
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
            begin, stop = at[starts], at[ends]
            slot = self._slots(data, begin, stop)
            size = self.offsets[slot + 1] - self.offsets[slot]
            base = np.concatenate(([0], np.cumsum(size)))
            tokens = self.ids[np.arange(base[-1]) + np.repeat(self.offsets[slot] - base[:-1], size)]
            last = base[np.searchsorted(starts, text_ends)]
            out += [tokens[a:b].astype("<u4").tobytes() for a, b in zip([0, *last[:-1]], last, strict=True)]
            if len(self.held) > REMEMBERED * 16:
                self.forget()
        return out

    def decode(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids, worked out by a bounded number of ids at a time."""
        out: list[list[str]] = [[] for _ in texts]
        ids = np.frombuffer(b"".join(texts), dtype="<u4")
        ends = np.cumsum([len(t) // 4 for t in texts])
        for first in range(0, len(ids), DECODE_TOKENS):
            some = ids[first : first + DECODE_TOKENS].astype(np.int64)
            place = np.arange(first, first + len(some))
            self.db.register("tokens", pa.table({"doc": np.searchsorted(ends, place, side="right"), "pos": place, "tok": some}))
            for doc, text in self.db.execute(_DECODE).fetchall():
                out[doc].append(text)
            self.db.unregister("tokens")
        return ["".join(parts).encode("latin-1") for parts in out]


_loaded: dict[str, _Vocabulary] = {}


def vocabulary(path: str) -> _Vocabulary:
    """The vocabulary of a rank file, loaded once in each worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = _Vocabulary(path)
    return _loaded[path]


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=16)
def checked(path: str) -> str:
    """The path of a rank file whose tokens are all made by merges of lower ranks, looked through once by the driver; an error names any other."""
    if not _Vocabulary(path).ordered():
        raise ValueError(f"{path} has tokens that merges of lower ranks do not make; pieces of all lengths contract alike only without such")
    return path


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id_col, ids) of every row, ids being little-endian unsigned 32-bit integers; a null text counts as empty.

    Every row gives one row, repeated rows and null ids as well; other columns are not read.
    """
    path = checked(ranks or default_ranks())
    kind = df.select(F.col(id_col).alias(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            ids = words.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return bounded_batches(df).select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(id_col, ids, decoded) of every row, decoded being the bytes that the ids stand for; null ids count as none."""
    path = ranks or default_ranks()
    kind = df.select(F.col(id_col).alias(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(words.decode(raw), pa.binary())], [id_col, "ids", "decoded"])

    return bounded_batches(df).select(F.col(id_col).alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def round_trip(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every text encoded and decoded again, in one pass of a worker."""
    path = checked(ranks or default_ranks())
    kind = documents.select(F.col(id_col).alias(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = words.encode([t or "" for t in part.column(1).to_pylist()])
                texts = words.decode(ids)
                told = [
                    part.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ]
                del ids, texts
                tk.release()
                yield pa.RecordBatch.from_arrays(told, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bounded_batches(documents).select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)

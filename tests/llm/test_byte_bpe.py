import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe as bb


@pytest.fixture(scope="module")
def library():
    words = bb.vocabulary(bb.default_ranks())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.rank, special_tokens={})


def check(texts, library):
    words = bb.vocabulary(bb.default_ranks())
    got = words.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert words.decode(got) == [t.encode() for t in texts]


def test_edges(library):
    odd = ["", "a", "'s", "'", "''s", "x's", "x 's", "'re'll", "'l", "can't  stop", "  a", "a  ", "a \n b", "\n\n", "\t x", " '", "'stop", ".'s", "1'd2", "a'", "日本語 テキスト", "🙂🙂", " " * 500 + "x", " " * 700, "a" * 300, "ab" * 400, "\x00\x01", "<|endoftext|>"]
    check(odd, library)


def test_random_texts(library):
    rng = random.Random(11)
    check(["".join(rng.choice("ab'stlrevmd  \n\t1.é日 　²") for _ in range(rng.randint(1, 60))) for _ in range(1500)], library)
    check(["".join(rng.choice(a) for _ in range(rng.randint(60, 700))) for a in ("ab", "aeinst", "the", "= -", "é日a") for _ in range(6)], library)


def test_data(spark, data, library):
    rows = bb.round_trip(spark.read.parquet(f"{data}/documents.parquet")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, none, library):
    rows = bb.decode(bb.encode(odd)).collect()
    assert sorted(r["decoded"].decode() for r in rows) == sorted(r["text"] or "" for r in odd.collect())
    assert bb.round_trip(odd).count() == odd.count() and bb.round_trip(none).count() == 0


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bb, "REMEMBERED", 50)
    check([f"word{i} other{i * 7} third" for i in range(200)], library)


def test_both_contractions_are_the_leftmost_pair(library):
    """The proof's condition holds for both rank files, and the queries agree on pieces of all kinds."""
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        assert bb._Vocabulary(public_tokenizers.path(name)).ordered()
    words, rng = bb.vocabulary(bb.default_ranks()), random.Random(5)
    pieces = ["".join(rng.choice(a) for _ in range(rng.randint(1, 200))).encode() for a in ("ab", "aeinst", "= -", "the ", "etaoinshrdlu", "é日a") for _ in range(40)]
    pieces += [b"-" * n for n in range(1, 60)]
    pieces = [p for p in pieces if len(p) <= 255]
    size = np.array([len(p) for p in pieces])
    one, all_ = words._fixpoint(pieces, size, True), words._fixpoint(pieces, size, False)
    assert (one[0] == all_[0]).all() and (one[1] == all_[1]).all()


def test_equal_hashes_of_different_pieces(library, monkeypatch):
    """Thue-Morse words collide in polynomial hashes modulo 2**64; so does everything under a poor hash."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    check([word, word.translate(str.maketrans("ab", "ba")), f"x {word}"], library)
    bb.vocabulary(bb.default_ranks()).forget()
    monkeypatch.setattr(bb.tk, "hash_spans", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    check(["one two six ten", "six two one ten one", "can cat car"], library)
    check(["cat dog one"], library)
    bb.vocabulary(bb.default_ranks()).forget()


def test_a_long_piece(library):
    rng = random.Random(7)
    check(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "=" * 30_000, "ab" * 5000], library)


def test_texts_cut_into_parts(library, monkeypatch):
    rng = random.Random(15)
    monkeypatch.setattr(bb, "LONG_TEXT", 40)
    monkeypatch.setattr(bb, "DECODE_TOKENS", 7)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "'s", "é", " x", "1", "日", "\u2003", "."]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    assert any(len(list(bb.cut_text(t))) > 2 for t in texts) and all("".join(bb.cut_text(t)) == t for t in texts)
    check(texts, library)


def test_rank_files_are_looked_through(spark, tmp_path):
    """A rank file with a token that its lower merges do not make is refused, before any task runs."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab"]
    file = tmp_path / "odd.tiktoken"
    file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    for run in (bb.encode, bb.round_trip):
        with pytest.raises(ValueError, match="merges of lower ranks"):
            run(df, ranks=str(file))
    fine = tmp_path / "fine.tiktoken"
    fine.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*tokens[:256], b"ab", b"abc"])))
    assert bb.round_trip(df, ranks=str(fine)).first()["n_tokens"] == 1

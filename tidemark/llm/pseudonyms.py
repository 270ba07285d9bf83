"""Format-preserving pseudonyms of personal data by a keyed Feistel network.

A number or date that a format's checks accept is turned into an index of that format's values; the index is
permuted by a Feistel network under the key, walking on until the result is a valid value again, and the
result is written with the separators of the original. Words of any length, such as secrets, are permuted by a
network over their characters, each within its class, in time linear in the length. Equal values of a format thus get equal
pseudonyms in every document, different ones differ, and whoever holds the key can turn them back. Only where
a pseudonym would form a longer valid number with the digits beside it, the next one of its cycle is taken.

Null texts stay null and have no findings, empty ones stay empty. Whole texts are read. Repeated rows and rows without an
id are judged by themselves, an empty table gives an empty table, other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, unused_name

ROUNDS = 10
_HEX = re.compile(r"(?=.*\d)[0-9a-f]{8,}")
_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _noise(key: bytes, tweak: str, turn: int, value: int, below: int) -> int:
    size = (below.bit_length() + 7) // 8 + 8
    mac = hashlib.blake2b(f"{tweak}|{turn}|{value}".encode(), key=hashlib.blake2b(key, digest_size=64).digest()).digest()
    return int.from_bytes(mac if size <= 64 else hashlib.shake_256(mac).digest(size), "big") % below


@lru_cache(maxsize=50_000)
def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1."""
    left = math.isqrt(max(0, size - 1)) + 1
    right = -(-size // left)
    while True:
        a, b = divmod(value, right)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * _noise(key, tweak, turn, a, right)) % right
            else:
                a = (a + sign * _noise(key, tweak, turn, b, left)) % left
        value = a * right + b
        if value < size:
            return value


def _walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool], back: bool) -> int:
    while True:
        value = permute(value, size, key, tweak, back)
        if valid(value):
            return value


def _luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """The separators of shape with other digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: Of each byte, how many characters its class has (0: it stays) and the class's first; letters and digits of lower-case hex are one class.
_RADIX, _BASE = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
for _first, _size in (("0", 10), ("a", 26), ("A", 26)):
    _RADIX[ord(_first) : ord(_first) + _size], _BASE[ord(_first) : ord(_first) + _size] = _size, ord(_first)
_HEX_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


@lru_cache(maxsize=8)
def _mac_key(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=64).digest()


def scramble(places: np.ndarray, radix: np.ndarray, key: bytes, tweak: str, back: bool = False) -> np.ndarray:
    """A keyed permutation of the values that places can take, each below its radix, in time linear in their number.

    A Feistel network over the two halves of the places: a round adds, place by place, a stream that a hash of the other half gives.
    """
    half = len(places) // 2
    parts, sizes = [places[:half], places[half:]], [radix[:half], radix[half:]]
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        at = turn % 2
        mac = hashlib.blake2b(f"{tweak}|{turn}|".encode() + parts[1 - at].astype(np.uint8).tobytes(), key=_mac_key(key)).digest()
        stream = np.frombuffer(hashlib.shake_256(mac).digest(4 * len(parts[at])), dtype=np.uint32).astype(np.int64)
        parts[at] = (parts[at] - stream if back else parts[at] + stream) % sizes[at]
    return np.concatenate(parts)


def _mix_whole(text: str, key: bytes, tweak: str, back: bool) -> str:
    hexed = bool(_HEX.fullmatch(text))
    codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    if hexed:
        places, radix = np.searchsorted(_HEX_DIGITS, codes), np.full(len(codes), 16)
    else:
        at = np.flatnonzero(_RADIX[codes])
        base, radix = _BASE[codes[at]], _RADIX[codes[at]]
        places = codes[at] - base
        # what stands at each place is part of the tweak, so that texts of one shape have a permutation of their own
        tweak = f"{tweak}|{hashlib.blake2b(_BASE[codes].astype(np.uint8).tobytes()).hexdigest()}"
    while True:
        places = scramble(places, radix, key, f"{tweak}|{hexed}|{len(codes)}", back)
        if hexed:
            new = _HEX_DIGITS[places]
        else:
            new = codes.copy()
            new[at] = base + places
        spelled = new.tobytes().decode("ascii")
        if bool(_HEX.fullmatch(spelled)) == hexed:
            return spelled


_mix_short = lru_cache(maxsize=50_000)(_mix_whole)


def _mixed(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits of an ASCII text permuted within their classes; lower-case hex stays hex. Short texts are remembered."""
    return (_mix_short if len(text) <= 64 else _mix_whole)(text, key, tweak, back)


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    shape = m.group(0)
    digits = re.sub(r"\D", "", shape)
    if not 13 <= len(digits) <= 19 or digits[0] not in "3456" or _luhn(digits[:-1]) != int(digits[-1]):
        return None
    n = len(digits) - 1
    body = _walk(int(digits[:-1]), 10**n, key, f"card{n}", lambda v: f"{v:0{n}d}"[0] in "3456", back)
    text = f"{body:0{n}d}"
    return _refill(shape, text + str(_luhn(text)))


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    shape = m.group(0)
    digits = re.sub(r"\D", "", shape)
    lead = "1" if len(digits) == 11 and digits[0] == "1" else ""
    local = digits[len(lead) :]
    if len(local) != 10 or local[0] in "01" or local[3] in "01":
        return None
    other = _walk(int(local), 10**10, key, "phone", lambda v: v >= 2 * 10**9 and v // 10**6 % 10 > 1, back)
    return _refill(shape, lead + f"{other:010d}")


def _foreign_phone(m: re.Match, key: bytes, back: bool) -> str | None:
    shape = m.group(0)
    digits = re.sub(r"\D", "", shape)
    if not 8 <= len(digits) <= 15 or digits[0] in "01":
        return None
    n = len(digits)
    other = _walk(int(digits), 10**n, key, f"phone+{n}", lambda v: v >= 2 * 10 ** (n - 1), back)
    return _refill(shape, f"{other:0{n}d}")


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    def valid(v: int) -> bool:
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    digits = int(re.sub(r"\D", "", m.group(0)))
    return _refill(m.group(0), f"{_walk(digits, 10**9, key, 'ssn', valid, back):09d}") if valid(digits) else None


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = m.group(0).split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = 0
    for p in parts:
        value = value << 8 | int(p)
    other = permute(value, 1 << 32, key, "ip", back)
    return ".".join(str(other >> s & 255) for s in (24, 16, 8, 0))


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    text = m.group(0).replace(" ", "")

    def number(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    if not 15 <= len(text) <= 34 or number(text[4:] + text[:4]) % 97 != 1:
        return None
    body = _mixed(text[4:], key, f"iban{text[:2]}", back)
    flat = f"{text[:2]}{98 - number(body + text[:2] + '00') % 97:02d}{body}"
    it = iter(flat)
    return "".join(c if c == " " else next(it) for c in m.group(0))


def _date(m: re.Match, key: bytes, back: bool) -> str | None:
    a, mark, b, c = m.group("a"), m.group("mark"), m.group("b"), m.group("c")
    if len(a) == 4:
        order = "ymd"
        year, month, day = int(a), int(b), int(c)
    else:
        order = "dmy" if mark == "." or int(a) > 12 else "mdy"
        day, month, year = (int(a), int(b), int(c)) if order == "dmy" else (int(b), int(a), int(c))
    try:
        value = (date(year, month, day) - _EPOCH).days
    except ValueError:
        return None
    if not 0 <= value < _DAYS:
        return None
    ambiguous = order == "dmy" and mark != "."
    found = _EPOCH + timedelta(_walk(value, _DAYS, key, "date>12" if ambiguous else "date", (lambda v: (_EPOCH + timedelta(v)).day > 12) if ambiguous else (lambda v: True), back))
    parts = {"y": f"{found.year:04d}", "m": f"{found.month:02d}", "d": f"{found.day:02d}"}
    return mark.join(parts[p] for p in order)


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    local, _, domain = m.group(0).rpartition("@")
    return f"{_mixed(local, key, 'email', back)}@{domain}"


def _secret(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m.group("v")
    if not re.search(r"\d", value):
        return None
    return m.group(0)[: m.start("v") - m.start()] + _mixed(value, key, "secret", back) + m.group(0)[m.end("v") - m.start() :]


def _access_key(m: re.Match, key: bytes, back: bool) -> str | None:
    return m.group(0)[:4] + _mixed(m.group(0)[4:], key, "access", back)


#: Formats in the order in which they claim text: kind, marks of which one is needed, pattern, pseudonym or None if not valid.
FORMATS: list[tuple[str, str, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), _email),
    ("secret", "=:", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<v>[A-Za-z0-9+/_.-]{8,})"), _secret),
    ("access_key", "A", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), _access_key),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), _iban),
    ("card", "", re.compile(r"(?<![\d.+])\d(?:[ -]?\d){12,18}(?!\d)"), _card),
    ("ip", ".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"), _ip),
    ("date", "", re.compile(r"(?<![\d/.-])(?P<a>\d{4})(?P<mark>[-/.])(?P<b>\d{2})(?P=mark)(?P<c>\d{2})(?![\d/-]|\.\d)"), _date),
    ("date", "", re.compile(r"(?<![\d/.-])(?P<a>\d{2})(?P<mark>[-/.])(?P<b>\d{2})(?P=mark)(?P<c>\d{4})(?![\d/-]|\.\d)"), _date),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), _ssn),
    ("phone", "", re.compile(r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)"), _phone),
    ("foreign_phone", "+", re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\d)"), _foreign_phone),
]
_TRIGGER = re.compile(r"[0-9@]")
#: Separators at which a shorter run may end, of the formats whose patterns take in the words or digits behind a value.
RUN_ENDS = {"iban": " ", "card": " -", "foreign_phone": " .-"}
#: No run of these formats is longer.
_LONGEST_RUN = 80


def _claims(text: str, used: bytearray, kind: str, pattern: re.Pattern, pseudonym: Callable, key: bytes, back: bool, at: int = 0) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, pseudonym, contested) of the format's valid values in text[at:] outside of used, in order.

    Where a match is not valid, the runs in it that end on a separator are tried, longest first, then the search
    goes on behind the match's start. contested: a run that is not valid reaches into the value.
    """
    ends = RUN_ENDS.get(kind, "")
    reach = 0
    while m := pattern.search(text, at):
        start, greedy = m.span()
        new = None
        while True:
            if not (used and any(used[start : m.end()])):
                new = pseudonym(m, key, back)
            if new is not None or not ends:
                break
            shorter = (pattern.match(text, start, end) for end in range(m.end() - 1, start, -1) if text[end] in ends)
            m = next((run for run in shorter if run), None)
            if m is None:
                break
        if new is None:
            reach, at = max(reach, greedy), start + 1
        else:
            yield start, m.end(), new, reach > start or m.end() < greedy
            at = m.end()


def _settled(text: str, used: bytearray, kind: str, pattern: re.Pattern, pseudonym: Callable, key: bytes, back: bool, start: int, end: int, new: str, at: int) -> str:
    """new, or the next pseudonym in its cycle with which the same run of the text is chosen again, so that it turns back."""
    low, high = max(0, start - _LONGEST_RUN - 1), end + _LONGEST_RUN
    before, after, seen = text[low:start], text[end:high], used[low:high]
    first = max(at - low, 0)
    while True:
        found = next(_claims(before + new + after, seen, kind, pattern, pseudonym, key, back, first), None)
        if found and found[:2] == (start - low, end - low):
            return new
        m = pattern.match(before + new, start - low)
        new = pseudonym(m, key, back)


#: Digits of other scripts; they are read as the digits that they stand for.
_FOREIGN_DIGIT = re.compile(r"(?![0-9])\d")


def _in_script(original: str, new: str) -> str:
    """new with digits as the original has them: all in its script where it has one, else each as that at its place."""
    foreign = _FOREIGN_DIGIT.search(original)
    if not foreign:
        return new
    zero = ord(foreign[0]) - unicodedata.decimal(foreign[0])
    whole = not re.search("[0-9]", original)
    return "".join(chr(zero + int(c)) if "0" <= c <= "9" and (whole or _FOREIGN_DIGIT.match(original[i : i + 1])) else c for i, c in enumerate(new))


def _replacements(text: str, key: bytes, back: bool) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the text's values, in order."""
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray()
    for kind, marks, pattern, pseudonym in FORMATS:
        if marks and not any(mark in text for mark in marks):
            continue
        at = 0
        for start, end, new, contested in _claims(text, used, kind, pattern, pseudonym, key, back):
            if contested and kind in RUN_ENDS:
                new = _settled(text, used, kind, pattern, pseudonym, key, back, start, end, new, at)
            taken.append((start, end, kind, new))
            at = end
        if taken:
            used = used or bytearray(len(text))
            for start, end, _, _ in taken:
                used[start:end] = b"\x01" * (end - start)
    return sorted(taken)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of the originals in code points, in order.

    Digits of any script are read as numbers; a pseudonym has its digits in the script of the original's.
    """
    plain = text
    if not text.isascii() and any(c > "\x7f" and c.isdecimal() for c in set(text)):
        plain = _FOREIGN_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    if not _TRIGGER.search(plain):
        return text, []
    taken = _replacements(plain, key, back)
    out, at = [], 0
    for start, end, _, new in taken:
        out += [text[at:start], _in_script(text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), [(s, e, k) for s, e, k, _ in taken]


def pseudonym(text: Column | str, key: bytes, back: bool = False) -> Column:
    """struct(text, found) of a text column: the text with pseudonyms and the spans of the originals."""

    @F.pandas_udf("text string, found array<struct<start:int,end:int,kind:string>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [(None, []) if t is None else replace(t, key, back) for t in texts]
        return pd.DataFrame({"text": [d[0] for d in done], "found": [[{"start": s, "end": e, "kind": k} for s, e, k in d[1]] for d in done]})

    return run(text)


def pseudonymise(documents: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_found, found) of every row, repeated rows and null ids included."""
    judged = bounded_batches(documents).select(F.col(id_col).alias(id_col), pseudonym(F.col(text_col), key).alias("p"))
    return judged.select(id_col, F.col("p.text").alias("text"), F.size("p.found").cast("long").alias("n_found"), F.col("p.found").alias("found"))


def with_pseudonyms(documents: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """documents with the text replaced, all other columns kept, whatever their names; length_col, if given, follows the new text."""
    own = unused_name(documents, "pseudonym")
    new = bounded_batches(documents).withColumn(own, pseudonym(F.col(text_col), key))
    columns = [F.col(f"{own}.text").alias(c) if c == text_col else F.length(f"{own}.text").cast("long").alias(c) if c == length_col else F.col(f"`{c}`") for c in documents.columns]
    return new.select(*columns)

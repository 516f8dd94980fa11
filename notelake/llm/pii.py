"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by pattern, validated, and permuted by a keyed Feistel network within their format:
a card number becomes another of the same length that passes the Luhn test, an address another address, a date
another date. The permutation of a kind is the same everywhere, so equal values stay equal across documents and
different ones different, without any table; with the key it can be undone. Names in mail addresses are permuted
letter by letter position in the same way.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Feistel:
    """A keyed permutation of ``range(size)``: rounds over two halves of a domain ``a * b >= size``, walked until the result is in range."""

    def __init__(self, key: bytes, label: str, size: int, rounds: int = 10) -> None:
        self.key, self.label, self.size, self.rounds = key, label.encode(), size, rounds
        self.a = math.isqrt(max(0, size - 1)) + 1
        self.b = max(1, -(-size // self.a))

    def _round(self, k: int, half: int) -> int:
        message = b"%s|%d|%d|%d" % (self.label, self.size, k, half)
        return int.from_bytes(hmac.digest(self.key, message, hashlib.sha256)[:16], "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in range(self.rounds):
            if k % 2 == 0:
                left = (left + self._round(k, right)) % self.a
            else:
                right = (right + self._round(k, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(self.rounds)):
            if k % 2 == 0:
                left = (left - self._round(k, right)) % self.a
            else:
                right = (right - self._round(k, left)) % self.b
        return left * self.b + right

    def encrypt(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x

    def decrypt(self, x: int) -> int:
        x = self._back(x)
        while x >= self.size:
            x = self._back(x)
        return x


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


_FIRST, _LAST = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (_LAST - _FIRST).days + 1
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_HEX = ("0123456789abcdef",)


class Pseudonymizer:
    """Pseudonyms of single values under one key."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.networks: dict[tuple[str, int], Feistel] = {}

    def _permute(self, label: str, size: int, x: int, undo: bool = False) -> int:
        if (label, size) not in self.networks:
            self.networks[label, size] = Feistel(self.key, label, size)
        network = self.networks[label, size]
        return network.decrypt(x) if undo else network.encrypt(x)

    def digits(self, label: str, digits: str, undo: bool = False) -> str:
        return str(self._permute(label, 10 ** len(digits), int(digits), undo)).zfill(len(digits))

    def card(self, digits: str, undo: bool = False) -> str:
        own = self.digits("card", digits[:-1], undo)
        return own + luhn_digit(own)

    def ip(self, text: str, undo: bool = False) -> str:
        x = 0
        for part in text.split("."):
            x = x * 256 + int(part)
        x = self._permute("ip", 1 << 32, x, undo)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def day(self, d: date, undo: bool = False) -> date:
        return _FIRST + timedelta(self._permute("date", _DAYS, (d - _FIRST).days, undo))

    def letters(self, label: str, text: str, undo: bool = False) -> str:
        """Letters and digits permuted as one number in mixed radix, each within its own alphabet (long lower-case hexadecimal within its digits); other characters stay."""
        alphabets = _HEX if len(text) >= 16 and not text.strip(_HEX[0]) else _ALPHABETS
        at = [(k, next((a for a in alphabets if c in a), "")) for k, c in enumerate(text)]
        at = [(k, a) for k, a in at if a]
        out = list(text)
        for lo in range(0, len(at), 64):
            run = at[lo : lo + 64]
            x, size = 0, 1
            for k, a in run:
                x, size = x * len(a) + a.index(text[k]), size * len(a)
            x = self._permute(f"{label}{lo}/{''.join(a[0] for _, a in run)}", size, x, undo)
            for k, a in reversed(run):
                x, d = divmod(x, len(a))
                out[k] = a[d]
        return "".join(out)


_NUMBER_SHAPE = re.compile("[0-9]")


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return _NUMBER_SHAPE.sub(lambda _: next(it), shape)


# Patterns of what is looked for, tried in this order at each place.
_PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d))"
    r"|(?P<iso>(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-]))"
    r"|(?P<dmy>(?<![\d./])(?:0[1-9]|[12]\d|3[01])(?P<sep>[./])(?:0[1-9]|1[0-2])(?P=sep)(?:19|20)\d\d(?![\d/]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d))"
    r"|(?P<intl>(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d))"
    r"|(?P<card>(?<![\w.])\d(?:[ \-]?\d){12,18}(?!\d))"
    r"|(?P<secret>(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_\-]{8,}))",
    re.ASCII,
)
_KINDS = ("email", "ip", "iso", "dmy", "ssn", "phone", "intl", "card", "secret")
#: Every value holds one of these characters.
_ANCHOR = re.compile("[0-9@=:]")
_BLANK = re.compile(r"\s")
_NEAR = 96


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text, from blank to blank, outside which no value can lie."""
    lo = hi = -1
    for m in _ANCHOR.finditer(text):
        first, last = m.span()
        if m[0] in "=:":  # any number of blanks may part the sign of a secret from its name and its value
            while first > 0 and text[first - 1].isspace():
                first -= 1
            while last < len(text) and text[last].isspace():
                last += 1
        near = min(len(text), last + _NEAR)
        if near <= hi:
            continue
        start = max(0, first - _NEAR)
        if start > hi:
            while start > hi + 1 and not text[start - 1].isspace():
                start -= 1
            if hi >= 0:
                yield lo, hi
            lo = start
        blank = _BLANK.search(text, near)
        hi = blank.start() if blank else len(text)
    if hi >= 0:
        yield lo, hi


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each validated value, in order."""
    out = []
    for at, stop in _windows(text):
        while m := _PATTERN.search(text, at, stop):
            kind, (lo, hi) = next(k for k in _KINDS if m[k] is not None), m.span()
            if kind == "secret":
                lo, hi = m.span("value")
            if _valid(kind, text[lo:hi]):
                out.append((lo, hi, kind))
                at = hi
            else:
                at = hi if kind in ("card", "ssn", "iso", "dmy") else lo + 1
    return out


def _valid(kind: str, text: str) -> bool:
    digits = "".join(_NUMBER_SHAPE.findall(text))
    if kind == "card":
        return is_card(digits)
    if kind in ("iso", "dmy"):
        return _date_of(kind, text) is not None
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "intl":
        return 8 <= len(digits) <= 15
    return True


def _date_of(kind: str, text: str) -> date | None:
    d = "".join(_NUMBER_SHAPE.findall(text))
    y, m, day = (d[:4], d[4:6], d[6:]) if kind == "iso" else (d[4:], d[2:4], d[:2])
    try:
        return date(int(y), int(m), int(day))
    except ValueError:
        return None


# International calling codes of one and of two digits; all others have three.
_ONE_DIGIT = frozenset("17")
_TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _country_digits(digits: str) -> int:
    return 1 if digits[0] in _ONE_DIGIT else 2 if digits[:2] in _TWO_DIGITS else 3


def pseudonym(p: Pseudonymizer, kind: str, value: str, undo: bool = False) -> str:
    digits = "".join(_NUMBER_SHAPE.findall(value))
    if kind == "card":
        return _refill(value, p.card(digits, undo))
    if kind == "ip":
        return p.ip(value, undo)
    if kind in ("iso", "dmy"):
        d = p.day(_date_of(kind, value), undo)
        return d.isoformat() if kind == "iso" else d.strftime("%d.%m.%Y").replace(".", value[2])
    if kind == "ssn":
        # 1..899 without 666, 1..99, 1..9999, counted through.
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(p._permute("ssn", 898 * 99 * 9999, x, undo), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind in ("phone", "intl"):
        # The country's digits stay, and the rest is permuted by itself, so a number stays linked however it is written.
        n = _country_digits(digits) if value.startswith("+") else 0
        return _refill(value, digits[:n] + p.digits("phone", digits[n:], undo))
    if kind == "email":
        name, _, host = value.partition("@")
        return p.letters("email", name, undo) + "@" + host
    return p.letters("secret", value, undo)


def redact(text: str, p: Pseudonymizer) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each value replaced by its pseudonym, and (kind, start, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    for lo, hi, kind in find(text):
        new = pseudonym(p, kind, text[lo:hi])
        out += [text[at:lo], new]
        size += lo - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = hi
    return "".join([*out, text[at:]]), spans


@dataclass(frozen=True)
class PiiParams:
    #: The key of all permutations; whoever has it can undo the pseudonyms.
    key: bytes


#: The setting that names the key, in hexadecimal digits.
KEY_SETTING = "spark.notelake.pii.key"
_own_keys: dict[str, bytes] = {}


def configured_key(spark: SparkSession) -> bytes:
    """The key that the session's settings hold. Without one, a random key that ends with the application: its pseudonyms stay linked within it and can't be undone later."""
    text = spark.conf.get(KEY_SETTING, None)
    if text:
        return bytes.fromhex(text)
    app = spark.sparkContext.applicationId
    return _own_keys.get(app) or _own_keys.setdefault(app, secrets.token_bytes(32))


SCHEMA = "text string, n_values int, kinds array<string>, starts array<int>, ends array<int>"


def pseudonymize(docs: DataFrame, params: PiiParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_values, and kinds, starts and ends of the values in it (code points).

    A null text gives a null text and no values; an empty one stays empty; a null id is returned as null; repeated
    rows give equal rows; texts of any length are read whole; an empty table gives an empty result. Numbers that fail their test (Luhn, calendar, ranges) stay as they are. Other columns are
    ignored. A pseudonym may in rare cases (one in the size of its format) equal its value. The key is that of
    ``params``, else the session's (``KEY_SETTING``).
    """
    key = params.key if params else configured_key(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymizer(key)
        for batch in batches:
            rows = [redact(t, p) if t is not None else (None, []) for t in batch.column(1).to_pylist()]
            columns: list[tuple[Callable, pa.DataType]] = [(lambda s: s[0], pa.list_(pa.string())), (lambda s: s[1], pa.list_(pa.int32())), (lambda s: s[2], pa.list_(pa.int32()))]
            arrays = [pa.array([[get(s) for s in spans] for _, spans in rows], kind) for get, kind in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rows], pa.string()), pa.array([len(s) for _, s in rows], pa.int32()), *arrays], names=["doc_id", "text", "n_values", "kinds", "starts", "ends"])

    return source.mapInArrow(run, "doc_id long, " + SCHEMA)

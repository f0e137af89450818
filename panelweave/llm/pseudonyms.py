"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their checks are replaced by a keyed permutation of their own format: a card number by
another of the same length and first digit that passes Luhn's check, a day by a day, an address by an address. The
permutation is a balanced Feistel network over the smallest even number of bits that holds the format's values,
repeated until the result is a value of the format again. So equal values get equal pseudonyms in all documents,
different values different ones, and the key undoes them.

Kinds: e-mail names, telephone and card numbers, IPv4 addresses, account numbers (IBAN), social security numbers,
dates, access keys and secrets. The separators and everything else stay as they are. Where spans overlap, the kind
listed first wins. Null texts stay null, empty texts empty; texts are treated whole.

A secret is a value after password, passwd, pwd, token, secret or api_key in any case and `=` or `:`, or after the
word bearer, of at least eight letters and digits, with `_ . + / -` between them. It is either hexadecimal in one case or has both a letter and a digit;
other words and plain words, such as `Password: required`, are not taken for secrets.

Cards stand in one piece or in groups of four or 4-6-5, account numbers in one piece or in groups of four. Of
the latter the whole run of groups must pass the check: one followed by another short group of capitals stays as it is.
Dates have days from 1900 to 2099; one-digit days and months stay ones, as a format of its own. International numbers
need a `+` and one separator, blank or `-`; their country code stays. Other forms are not covered.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelweave.llm.batches import Batches, bounded, map_batches, other_fields

ROUNDS = 10
# Bytes of text taken from Spark's batches at once.
CHUNK = 1 << 21
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (LAST_DAY - FIRST_DAY).days + 1
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_SYMBOLS = re.compile(r"[^0-9A-Za-z]")


@lru_cache(1 << 16)
def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size), one for each kind and size."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    tweak = f"{kind}/{size}/".encode()

    def scrambled(turn: int, x: int) -> int:
        data = tweak + bytes([turn]) + x.to_bytes(width, "big")
        return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=min(64, width)).digest(), "big") & mask

    while True:
        left, right = value >> half, value & mask
        if back:
            for turn in reversed(range(ROUNDS)):
                left, right = right ^ scrambled(turn, left), left
        else:
            for turn in range(ROUNDS):
                left, right = right, left ^ scrambled(turn, right)
        value = left << half | right
        if value < size:
            return value


def _permute_until(value: int, size: int, key: bytes, kind: str, back: bool, valid: Callable[[int], bool]) -> int:
    """The permutation walked on to the next valid value; invertible on the valid ones."""
    while True:
        value = permute(value, size, key, kind, back)
        if valid(value):
            return value


def permute_symbols(text: str, alphabets: list[str], key: bytes, kind: str, back: bool) -> str:
    """Each symbol within its own alphabet, all of them as one mixed-radix number."""
    value, size = 0, 1
    for symbol, alphabet in zip(text, alphabets, strict=True):
        value, size = value * len(alphabet) + alphabet.index(symbol), size * len(alphabet)
    if size < 2:
        return text
    value = permute(value, size, key, f"{kind}/{','.join(str(len(a)) for a in alphabets)}", back)
    out = []
    for alphabet in reversed(alphabets):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit to append."""
    total = sum(int(d) if i % 2 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _with_digits(text: str, digits: str) -> str:
    """The digits of `text` replaced in order, its separators kept."""
    following = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(following), text)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = _digits(text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    inner = permute_symbols(digits[1:-1], ["0123456789"] * (len(digits) - 2), key, "card", back)
    return _with_digits(text, digits[0] + inner + luhn_digit(digits[0] + inner))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """The ten national digits; an area or exchange code that starts with 2 to 9, as valid ones do, still does."""
    digits = _digits(text)
    country, national = digits[:-10], digits[-10:]
    leading = lambda digit: "01" if digit in "01" else "23456789"
    alphabets = [leading(d) if i in (0, 3) else "0123456789" for i, d in enumerate(national)]
    return _with_digits(text, country + permute_symbols(national, alphabets, key, "phone", back))


def _international(text: str, key: bytes, back: bool) -> str | None:
    """The digits after the country code; a first one that isn't zero stays so. Ten digits are those of other phone forms."""
    country, digits = re.match(r"[+]([0-9]+)", text)[1], _digits(text)
    national = digits[len(country) :]
    if not 8 <= len(digits) <= 15:
        return None
    if len(national) == 10:
        return _phone(text, key, back)
    alphabets = ["0" if national[0] == "0" else "123456789", *["0123456789"] * (len(national) - 1)]
    return _with_digits(text, country + permute_symbols(national, alphabets, key, "phone", back))


def _address(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _social(text: str, key: bytes, back: bool) -> str | None:
    def valid(value: int) -> bool:
        area, group, serial = value // 1_000_000, value // 10_000 % 100, value % 10_000
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0

    value = int(_digits(text))
    if not valid(value):
        return None
    return _with_digits(text, f"{_permute_until(value, 10**9, key, 'ssn', back, valid):09d}")


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    country, check, account = text[:2], text[2:4], text[4:]
    if _iban_check(country, account) != check:
        return None
    account = permute_symbols(account, [next(c for c in _CLASSES if x in c) for x in account], key, "iban" + country, back)
    return country + _iban_check(country, account) + account


def _spaced_iban(text: str, key: bytes, back: bool) -> str | None:
    symbols = _iban(text.replace(" ", ""), key, back)
    following = iter(symbols or "")
    return "".join(x if x == " " else next(following) for x in text) if symbols else None


def _day(year: int, month: int, day: int) -> int | None:
    try:
        at = (date(year, month, day) - FIRST_DAY).days
    except ValueError:
        return None
    return at if 0 <= at < _DAYS else None


def _date(text: str, key: bytes, back: bool) -> str | None:
    """Year first, or day first; month first only where the second number cannot be a month."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", text))
    mark, order = re.search(r"[-/.]", text)[0], "ymd" if a > 31 else "dmy" if b <= 12 else "mdy"
    at = _day(*{"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order])
    if at is None:
        return None
    widths = [len(x) for x in re.split(r"[-/.]", text)]
    short = [x for x, width in zip(order, widths, strict=True) if width == 1]

    def fits(value: int) -> bool:
        new = FIRST_DAY + timedelta(value)
        return (order != "mdy" or new.day > 12) and ("d" not in short or new.day < 10) and ("m" not in short or new.month < 10)

    new = FIRST_DAY + timedelta(_permute_until(at, _DAYS, key, "date", back, fits))
    parts = {"y": new.year, "m": new.month, "d": new.day}
    return mark.join(f"{parts[x]:0{width}d}" for x, width in zip(order, widths, strict=True))


def _mail(text: str, key: bytes, back: bool) -> str | None:
    """Letters and digits of the name; the domain stays."""
    name, domain = text.split("@")
    fixed = [next((c for c in _CLASSES if x in c), x) for x in name]
    return f"{permute_symbols(name, fixed, key, 'mail@' + domain.lower(), back)}@{domain}"


def _secret(text: str, key: bytes, back: bool) -> str | None:
    """Hexadecimal digits stay ones of their case, other values keep each symbol's class; so all are found again."""

    def form(value: str) -> str | None:
        symbols = _SYMBOLS.sub("", value)
        if len(symbols) < 8:
            return None
        if form := next((x for x in _HEX if not symbols.strip(x)), None):
            return form
        return "mixed" if re.search("[0-9]", symbols) and re.search("[A-Za-z]", symbols) else None

    kind = form(text)
    if kind is None:
        return None
    alphabets = [x if _SYMBOLS.match(x) else kind if kind in _HEX else next(c for c in _CLASSES if x in c) for x in text]
    while True:
        # In blocks of at most 128 symbols, which the permutation mixes in full.
        blocks = range(0, len(text), 128)
        text = "".join(permute_symbols(text[i : i + 128], alphabets[i : i + 128], key, "secret", back) for i in blocks)
        if form(text) == kind:
            return text


def _access_key(text: str, key: bytes, back: bool) -> str | None:
    return "AKIA" + permute_symbols(text[4:], [_CLASSES[2] + _CLASSES[1]] * 16, key, "access", back)


# A run that may hold a number, found by its first digit; the kinds are looked for in and just before it.
_RUN = re.compile(r"[0-9][0-9 ().+/-]*[0-9]")
_IN_RUN: list[tuple[str, re.Pattern, Callable]] = [
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", re.A), _address),
    ("date", re.compile(r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-]|\.[0-9])", re.A), _date),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A), _social),
    ("card", re.compile(r"(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![\w-])", re.A), _card),
    ("phone", re.compile(r"(?<![\w+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])", re.A), _phone),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{11,13}(?!\w)", re.A), _phone),
    ("phone", re.compile(r"(?<![\w+])\+[0-9]{1,3}([ -])[0-9]{2,5}(?:\1[0-9]{2,8}){1,4}(?![\w-])", re.A), _international),
]
_ANYWHERE: list[tuple[str, re.Pattern, Callable]] = [
    ("access_key", re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), _access_key),
    ("secret", re.compile(r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s*[=:]\s*[\"']?(?:bearer\s+)?|bearer\s+)([0-9A-Za-z](?:[0-9A-Za-z_.+/-]*[0-9A-Za-z])?)"), _secret),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])"), _iban),
    ("iban", re.compile(r"[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?(?![0-9A-Za-z])"), _spaced_iban),
]
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_CHARS = frozenset("".join(_CLASSES) + "._%+-")


def _found(text: str, key: bytes, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of all candidates, kind by kind."""
    for kind, pattern, change in _ANYWHERE:
        for m in pattern.finditer(text):
            start, end = m.span(pattern.groups)
            if start and m.start() == start and text[start - 1].isalnum():
                continue
            if new := change(text[start:end], key, back):
                yield start, end, kind, new
    for m in _AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in _NAME_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end(), "mail", _mail(text[start : m.end()], key, back)
    runs = [(max(0, m.start() - 2), m.end()) for m in _RUN.finditer(text)]
    for kind, pattern, change in _IN_RUN:
        for start, end in runs:
            for m in pattern.finditer(text, start, min(len(text), end + 2)):
                if new := change(m[0], key, back):
                    yield m.start(), m.end(), kind, new


def replace(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each span; `back` restores the original."""
    if not text:
        return text, []
    chosen: list[tuple[int, int, str, str]] = []
    for span in _found(text, key, back):
        place = bisect(chosen, span[:2])
        if (not place or chosen[place - 1][1] <= span[0]) and (place == len(chosen) or span[1] <= chosen[place][0]):
            chosen.insert(place, span)
    out, at = [], 0
    for start, end, _, new in chosen:
        out += (text[at:start], new)
        at = end
    out.append(text[at:])
    return "".join(out), [(kind, start, end) for start, end, kind, _ in chosen]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "spans", back: bool = False) -> DataFrame:
    """Replace `text` and add `spans`, an array of (kind, start, end) in the original text.

    Repeated rows are treated alike, an empty table gives no rows, and an input column named like `spans` is replaced.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kept = other_fields(docs, [spans])
    kinds = T.StructType([*kept, T.StructField(spans, T.ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, text, CHUNK):
            done = [replace(v.as_py(), key, back) for v in batch.column(text)]
            columns = {f.name: batch.column(f.name) for f in kept}
            columns[text] = pa.array([d[0] for d in done], pa.string())
            columns[spans] = pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in d[1]] for d in done], arrow_span)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return map_batches(docs, run, kinds)

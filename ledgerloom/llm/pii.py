"""Personal data: format-preserving pseudonyms by Feistel networks.

A validated value is a number in its format's finite domain. A keyed Feistel network over two nearly equal factors of
that domain permutes it; a result outside the format's valid values goes through again until it is valid (cycle
walking), which keeps the map a bijection on them. So a card stays a card with a right check digit, a date stays a date
in its notation, and equal values have equal pseudonyms in all documents, whichever worker meets them.

Kinds: e-mail addresses, phone numbers, payment cards (Luhn), bank accounts (mod 97), social security numbers, IPv4
addresses and calendar dates. Where a find fails its check, its beginnings are tried from the longest to the shortest,
then what starts after its first character. Numbers that fail with all of these are left alone.

Phones: three-three-four digits; with '+', any grouping of 8 to 15 digits; nationally, '0' and groups with 9 to 12 digits
in all. Dates: year first, day first or, where only that is a date, month first.

Defined results: a null text becomes an empty one, an empty one stays, neither has spans; texts of any length are read
whole; of overlapping finds the leftmost, then longest,
counts; repeated rows get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, text_of

ROUNDS = 8
#: Of finds with the same ends, the first kind counts.
KINDS = ("email", "card", "iban", "ssn", "ip", "date", "phone")
#: Dates stay within their stretch of years, so that those of living people stay such dates.
STRETCHES = [(date(1, 1, 1).toordinal(), date(1899, 12, 31).toordinal()), (date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()), (date(2100, 1, 1).toordinal(), date.max.toordinal())]


def feistel(x: int, size: int, key: bytes, tweak: str) -> int:
    """Keyed permutation of range(size). Halves are numbers below a and b, where a * b is the least that holds size."""
    if size < 2:
        return x
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        m, n = a, b
        for r in range(ROUNDS):
            mixed = hashlib.blake2b(f"{tweak}|{size}|{r}|{right}".encode(), key=key, digest_size=16).digest()
            # alternating halves: what was right becomes left, each below its own bound
            left, right = right, (left + int.from_bytes(mixed, "big")) % m
            m, n = n, m
        x = left * n + right
        if x < size:
            return x


def walk(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool]) -> int:
    """Permutation of the valid numbers of range(size); x is one of them."""
    x = feistel(x, size, key, tweak)
    while not valid(x):
        x = feistel(x, size, key, tweak)
    return x


def luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def card(value: str, key: bytes) -> str | None:
    d = only_digits(value)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = len(d) - 2  # the issuer's first digit stays, the last one checks
    body = d[0] + f"{feistel(int(d[1:-1]), 10**n, key, f'card{len(d)}{d[0]}'):0{n}d}"
    return refill(value, body + luhn_digit(body))


def phone(value: str, key: bytes) -> str | None:
    d = only_digits(value)
    if AMERICAN.fullmatch(value) or value[1:] == d and 10 <= len(d) <= 13:
        country, local = d[:-10], d[-10:]
        sound = lambda s: s[0] >= "2" and s[3] >= "2"
        was = sound(local)
        x = walk(int(local), 10**10, key, f"phone{country}", lambda x: sound(f"{x:010d}") == was)
        return refill(value, country + f"{x:010d}")
    if not (8 <= len(d) <= 15 if value[0] == "+" else 9 <= len(d) <= 12) or date_like(value):
        return None
    # The country or the trunk's zero stays, and the digit after it, so that the number stays one of its kind.
    head = re.match(r"\+\d{1,3}|\(?0|", value).group()
    kept = min(len(only_digits(head)) + 1, len(d) - 6)
    n = len(d) - kept
    return refill(value, d[:kept] + f"{feistel(int(d[kept:]), 10**n, key, f'phone{d[:kept]}.{n}'):0{n}d}")


def date_like(value: str) -> bool:
    return re.match(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d(?!\d)", value) is not None


def ssn(value: str, key: bytes) -> str | None:
    ok = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    x = int(only_digits(value))
    return refill(value, f"{walk(x, 10**9, key, 'ssn', lambda y: bool(ok(y))):09d}") if ok(x) else None


def ip(value: str, key: bytes) -> str | None:
    parts = value.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    x = feistel(sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts)), 1 << 32, key, "ip")
    return ".".join(str(x >> 8 * i & 255) for i in (3, 2, 1, 0))


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(value: str, key: bytes) -> str | None:
    s = value.replace(" ", "")
    if not 15 <= len(s) <= 34 or _mod97(s[4:] + s[:4]) != 1:
        return None
    country, body = s[:2], s[4:]
    out = _letters(body, key, f"iban{country}")
    check = 98 - _mod97(out + country + "00")
    it = iter(country + f"{check:02d}" + out)
    return "".join(c if c == " " else next(it) for c in value)


def _letters(s: str, key: bytes, tweak: str) -> str:
    """s with its digits, small and capital letters permuted together within their places' classes."""
    bases = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in s]
    x, size = 0, 1
    for c, b in zip(s, bases, strict=True):
        x = x * b + (0 if b == 1 else int(c) if b == 10 else ord(c.lower()) - 97)
        size *= b
    shape = "".join("d" if b == 10 else "l" if b == 26 else c for c, b in zip(s, bases, strict=True))
    x = feistel(x, size, key, f"{tweak}{shape}")
    out = []
    for c, b in zip(reversed(s), reversed(bases), strict=True):
        x, r = divmod(x, b)
        out.append(c if b == 1 else str(r) if b == 10 else chr((97 if c.islower() else 65) + r))
    return "".join(reversed(out))


def email(value: str, key: bytes) -> str | None:
    name, _, host = value.rpartition("@")
    labels = host.split(".")
    if len(labels) < 2 or not all(labels) or not name:
        return None
    folded = lambda s: s.casefold() if s.isascii() else s  # noqa: E731  addresses that differ in case are one
    return _letters(folded(name), key, "name") + "@" + ".".join([_letters(folded(x), key, "host") for x in labels[:-1]] + [labels[-1]])


#: Date notations, as patterns whose groups are year, month and day in the given order.
NOTATIONS = [("ymd", r"(\d{4})-(\d{2})-(\d{2})"), ("ymd", r"(\d{4})/(\d{2})/(\d{2})"), ("dmy", r"(\d{1,2})[./](\d{1,2})[./](\d{4})"), ("mdy", r"(\d{1,2})/(\d{1,2})/(\d{4})")]
#: Phones with three, three and four digits.
AMERICAN = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})")
#: Characters of a country's IBAN: the beginning of a find to try first.
LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 "
    "JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
).split())
LENGTHS = {k: int(n) for k, n in LENGTHS.items()}


def day(value: str, key: bytes) -> str | None:
    for order, pattern in NOTATIONS:
        if m := re.fullmatch(pattern, value):
            got = dict(zip(order, map(int, m.groups()), strict=True))
            try:
                x = date(got["y"], got["m"], got["d"]).toordinal()
            except ValueError:
                continue
            first, last = next(s for s in STRETCHES if s[0] <= x <= s[1])
            late = order == "mdy"  # a day past the 12th gets another such, so that no other notation's dates are met
            new = date.fromordinal(first + walk(x - first, last - first + 1, key, "date", lambda x: not late or date.fromordinal(first + x).day > 12))
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            marks = re.findall(r"\D+", value)
            return "".join(x for pair in zip((parts[c] for c in order), [*marks, ""], strict=True) for x in pair)
    return None


MAKERS = {"email": email, "phone": phone, "card": card, "iban": iban, "ssn": ssn, "ip": ip, "date": day}
FINDERS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)|(?<!\w)\+\d{10,13}(?!\w)"
        r"|(?<!\w)\+\d{1,3}(?:[ ./-]?\(0?\d{0,4}\))?(?:[ ./-]?\d){6,14}(?!\w)|(?<![\w.,+/-])\(?0\d{1,4}\)?(?:[ ./-]{1,2}\d{2,8}){1,5}(?!\w)"
        r"|(?<![\w.,+/-])(?<!\d )(?:[6-9]\d\d \d{3} \d{3}|[6-9]\d\d \d\d \d\d \d\d|[89]\d \d{3} \d\d \d\d)(?! ?\w*\d)"),
    "card": re.compile(r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"),
    "date": re.compile(r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-])"),
}


def beginnings(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Ends of the kind's finds from start to end, of whole groups only: all, then an IBAN's length, then the longest."""
    yield end
    ends = [i for i in range(end - 1, start, -1) if text[i - 1].isalnum() and not text[i].isalnum()]
    if kind == "iban":
        n = LENGTHS.get(text[start : start + 2])
        ends.sort(key=lambda i: len(text[start:i].replace(" ", "")) != n)
    for i in ends:
        if FINDERS[kind].fullmatch(text, start, i):
            yield i


def pseudonyms(text: str, key: bytes, table: dict | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value, in order and without overlap. table: what is known already."""
    table = {} if table is None else table
    found = []
    for rank, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text:
            continue
        at = 0
        while m := FINDERS[kind].search(text, at):
            at = m.start() + 1
            for end in beginnings(kind, text, *m.span()):
                known = (kind, text[m.start() : end])
                if known not in table:
                    if len(table) > 100_000:
                        table.clear()
                    table[known] = MAKERS[kind](known[1], key)
                if table[known] is not None:
                    found.append((m.start(), -end, rank, kind, table[known]))
                    at = end
                    break
    out, last = [], 0
    for start, end, _, kind, new in sorted(found):
        if start >= last:
            out.append((start, -end, kind, new))
            last = -end
    return out


SCHEMA = "doc_id long, n_spans long, spans string, text string"


KEY_SETTING = "spark.ledgerloom.pseudonym.key"


@lru_cache(maxsize=8)
def _fresh_key(application: str) -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting gives in hexadecimal; else a random one that ends with the application.

    With a random key, equal values are linked within the application, and nobody can undo or repeat its pseudonyms.
    """
    given = spark.conf.get(KEY_SETTING, None)
    return bytes.fromhex(given) if given else _fresh_key(spark.sparkContext.applicationId)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Number and spans (kind:start:end in code points) of the values found in each row, and the text with pseudonyms."""
    if not 16 <= len(key) <= 64:
        raise ValueError("a key has 16 to 64 bytes")
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}
        for batch in batches:
            counts, spans, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = pseudonyms(text, key, table)
                parts, at = [], 0
                for start, end, _, new in found:
                    parts += [text[at:start], new]
                    at = end
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k, _ in found))
                texts.append("".join([*parts, text[at:]]) if found else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_spans", "spans", "text"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir), session_key(spark))

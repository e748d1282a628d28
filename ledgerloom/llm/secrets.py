"""Secret scans: three base patterns and windowed entropy over candidate strings.

A candidate is a maximal run of token characters. For each character class a window slides over its runs of that class;
a run shorter than the window, of 20 characters at least, is one window with a threshold for its length. The counts of the
window's characters, and the sum of n log n over them, change by one character in and one out, so that each step costs
the same whatever the window. A window above its class's threshold marks a span, and overlapping marks are one span.
Candidates that the allow-list knows are passed over; base spans are never suppressed.

Runs under ``SHORTEST`` characters aren't measured: they have too few for entropy to tell a key from a word.

Defined results: a null or empty text has no spans; texts of any length are scanned whole, in time linear in it; of base
finds of one kind that overlap the leftmost counts, and kinds that start together stand in the order of ``KINDS``;
repeated rows get equal results; an empty table gives an empty result; extra columns are ignored by ``scan_secrets`` and
kept by ``redact_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import counted, read, small_batches, text_of

ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest runs of 32 and more: a leftmost run is never part of a longer one.
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST = {"assign": 8, "access": 16}

#: Character class: its characters, window and bits above which a window is too even to be language.
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 32, 3.3),
    "base32": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 32, 3.9),
    "base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 3.95),
}
#: What looks random and is none: words of one case, numbers, identifiers in the usual grouping, paths.
ALLOWED = [
    re.compile(p)
    for p in (
        r"[a-z]+(?:[-_/][a-z]+)*",
        r"[A-Z]+(?:[-_/][A-Z]+)*",
        r"[A-Z]?[a-z]+(?:(?:[-_/][A-Z]?|[A-Z])[a-z]+)*",  # a run of letters can be split in one way only
        r"[0-9+/_=-]+",
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
        r"[=_+/-]+(?:[^=_+/-][=_+/-]+)?",
    )
]
#: Shortest run that is measured.
SHORTEST = 20
_NLOGN = [0.0, *(n * math.log2(n) for n in range(1, 65))]


def threshold(kind: str, n: int) -> float:
    """Bits above which a window of n characters, at most its class's, is too even: lower by what a random key loses."""
    chars, width, bits = CLASSES[kind]
    if kind == "hex":  # of few characters: a random key's expected loss is (characters - 1) / (2 n ln 2), and it varies more
        return bits - 1.4 * 15 / (2 * math.log(2)) * (1 / n - 1 / width)
    return bits + 1.5 * math.log2(n / width)


def runs_of(kind: str, s: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of the class's characters, SHORTEST or longer. Shorter than its window, a number isn't hex.

    Capitals alone aren't base32, nor digits alone.
    """
    chars, width, _ = CLASSES[kind]
    start = 0
    for i in range(len(s) + 1):
        if i == len(s) or s[i] not in chars:
            if i - start >= SHORTEST:
                run = s[start:i]
                if not (kind == "hex" and i - start < width and run.isdigit() or kind == "base32" and (run.isalpha() or run.isdigit())):
                    yield start, i
            start = i + 1


def high_entropy(s: str, allowed: list[re.Pattern] = ALLOWED) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of s that are above their class's threshold."""
    if any(p.fullmatch(s) for p in allowed):
        return []
    found: list[tuple[int, int]] = []
    for kind, (_, most, _) in CLASSES.items():
        for start, end in runs_of(kind, s):
            width = min(most, end - start)
            limit = (math.log2(width) - threshold(kind, width)) * width  # the entropy is log2(width) - sum(n log n) / width
            counts: dict[str, int] = {}
            total = 0.0
            for i in range(start, end):
                if i - start >= width:
                    gone = s[i - width]
                    n = counts[gone]
                    total += _NLOGN[n - 1] - _NLOGN[n]
                    counts[gone] = n - 1
                c = s[i]
                n = counts.get(c, 0)
                total += _NLOGN[n + 1] - _NLOGN[n]
                counts[c] = n + 1
                if i - start + 1 >= width and total < limit:
                    found.append((i + 1 - width, i + 1))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, place in KINDS) of each span in text, sorted by start and then kind; code points, end exclusive."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        out += [(m.start() + a, m.start() + b, 3) for a, b in high_entropy(m.group())]
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return out


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = spans_of(text)
            counts = [0] * len(KINDS)
            for s in spans:
                counts[s[2]] += 1
            base = hashlib.sha256(_said(x for x in spans if x[2] < 3).encode()).hexdigest()
            rows.append((*counts, base, _said(spans)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        arrays = [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_scan, SCHEMA)


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """text with each secret replaced; an assignment keeps its name and loses its value."""
    cuts = []
    for a, b, k in spans_of(text):
        if k == 0:
            a = ASSIGN.match(text, a).start(2)
        if cuts and a < cuts[-1][1]:
            cuts[-1] = (cuts[-1][0], max(b, cuts[-1][1]))
        else:
            cuts.append((a, b))
    parts, at = [], 0
    for a, b in cuts:
        parts += [text[at:a], mask]
        at = b
    return "".join([*parts, text[at:]]) if cuts else text


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs in their own columns, secrets masked in text and n_chars, if it is integral, to match; null texts stay null."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else redacted(x) for x in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if (n := counted(batch.schema)) >= 0:
                kept = batch.column(n).to_pylist()
                arrays[n] = pa.array([k if x is None else len(x) for x, k in zip(texts, kept, strict=True)], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir))

"""Suffix-array dedup: repeated byte strings of a corpus, found by sorting suffixes.

Every string of ``LENGTH`` bytes picks, by its content alone, one of its places: the one whose next ``GRAM`` bytes have
the least fingerprint. Equal strings pick the same place, so it is enough to sort the suffixes that start at picked
places, about one in 35, instead of all. Neighbouring strings mostly pick the same place; a suffix comes with the range
of strings that picked it.

A suffix's tokens are its leading bytes, eight to a token, then a fingerprint of all its strings. Suffixes are ordered by
tokens, then by document and place. Splitters from a bounded sample cut that order into ranges; as they hold all of it, a
suffix that stands everywhere is spread over as many ranges as its part of the sample needs. Blocks and ranges are sorted
by multikey quicksort: three-way partitions by one token at a time.

Suffixes whose strings are all equal form a class, and all its members but the first are repeats altogether. Where one
suffix has several classes, their first members' bytes are fetched and compared string by string. Each range reports its
first and last suffix; where a range begins as the one before it ends, its first member is a repeat, too, and classes on
both sides of the boundary are compared.

Suffixes travel as packed columns. In a block of documents only the first member of a class is sent, so a passage that
stands everywhere costs a row a block. Fingerprints have 64 bits; strings count as equal when two of them agree.

Defined results: a null or empty text, or one under 100 bytes, loses nothing; of equal strings the first in order of
(doc_id, place) stays; rows that share an id share what is removed; null ids are one id, before all others; texts of any
length are worked on in segments; an empty table gives an empty result; extra columns are ignored by
``repeated_spans`` and kept by ``drop_repeats``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets, counted, free, read, small_batches, staged, text_of
from .shingles import _BYTE, mix, powers

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
#: Bytes to a segment of a text and to a block of segments (below 2**24).
SEGMENT, BLOCK = 1 << 18, 2 << 20
#: Bytes whose places are fingerprinted at once, about; each takes some 200 bytes of memory meanwhile.
PIECE = 1 << 18
#: Rows of the sample for the splitters, about, and suffixes that each gives.
SAMPLE, EACH = 1000, 50
NO_ID = -(1 << 63)
TOKENS = ["w0", "w1", "w2", "w3", "content"]
_COLUMNS = [*((t, "<u8") for t in TOKENS), ("doc", "<i8"), ("start", "<u4"), ("more", "u1"), ("back", "u1")]
_SIGN = np.uint64(1 << 63)
#: Suffixes up to which a part of the sort is ended in one go.
LEAF = 200


class Hashes:
    """Fingerprints of stretches of a buffer."""

    def __init__(self, buffer: np.ndarray) -> None:
        n = len(buffer)
        up, self.down = powers(n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_BYTE[buffer] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def suffix_rows(segments: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """Picked suffixes of segments (doc, offset in it, bytes), sorted by doc and offset.

    start: first string of the range in its document; more: strings after it; back: bytes from it to the suffix.
    """
    buffer = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
    hashes = Hashes(buffer)
    sizes = np.array([len(s[2]) for s in segments], np.int64)
    at = np.cumsum(sizes) - sizes
    places = np.arange(len(buffer) - GRAM + 1)
    grams = hashes.of(places, GRAM)
    least = (grams & np.uint64(0xFFFFFFFFFF000000)) | places.astype(np.uint64)
    width = 1
    while 2 * width <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    count = sizes - LENGTH + 1
    string = np.arange(int(count.sum())) + np.repeat(at - (np.cumsum(count) - count), count)
    picked = (least[string] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    start, suffix = string[first], picked[first]
    more = np.diff(np.append(first, len(string))) - 1
    segment = np.repeat(np.arange(len(segments)), count)[first]
    back = suffix - start
    content = mix(hashes.of(start, more + LENGTH) + (more * 128 + back).astype(np.uint64))
    words = buffer[suffix[:, None] + np.arange(GRAM)].view(">u8").astype(np.uint64) if len(suffix) else np.empty((0, 4), np.uint64)
    return {
        **{f"w{k}": words[:, k] for k in range(4)},
        "content": content,
        "doc": np.array([s[0] for s in segments], np.int64)[segment],
        "start": (start - at[segment] + np.array([s[1] for s in segments], np.int64)[segment]).astype(np.uint32),
        "more": more.astype(np.uint8),
        "back": back.astype(np.uint8),
    }


def block_rows(segments: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """``suffix_rows`` of a block, by pieces of it: places see their own segment alone."""
    parts, held, size = [], [], 0
    for s in segments:
        held.append(s)
        size += len(s[2])
        if size >= PIECE:
            parts.append(suffix_rows(held))
            held, size = [], 0
    if held or not parts:
        parts.append(suffix_rows(held))
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def segments_of(doc: int, raw: bytes) -> list[tuple[int, int, bytes]]:
    return [(doc, i, raw[i : i + SEGMENT + LENGTH - 1]) for i in range(0, len(raw) - LENGTH + 1, SEGMENT)]


def pack_rows(rows: dict[str, np.ndarray], take: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(rows[c][take].astype(t)).tobytes() for c, t in _COLUMNS)
    return len(take).to_bytes(4, "little") + zstandard.ZstdCompressor(1).compress(body)


def unpack_rows(blobs: list[bytes]) -> dict[str, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in _COLUMNS}
    for blob in blobs:
        n, body, at = int.from_bytes(blob[:4], "little"), unpack(blob[4:]), 0
        for c, t in _COLUMNS:
            parts[c].append(np.frombuffer(body, t, n, at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(x) for c, x in parts.items()}


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans joined where they touch, per document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # running ends that start afresh with each document
    group = np.cumsum(new).astype(np.int64)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for s in segments_of(doc, text.encode()):
                held.append(s)
                size += len(s[2])
                if size >= BLOCK:
                    yield sorted(held, key=lambda s: s[:2])
                    held, size = [], 0
    if held:
        yield sorted(held, key=lambda s: s[:2])


def sort_tokens(rows: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What suffixes are ordered by, one array a token: tokens, document (unsigned, in the order of its sign), place."""
    return [*(rows[t] for t in TOKENS), rows["doc"].astype(np.int64).view(np.uint64) ^ _SIGN, rows["start"].astype(np.uint64)]


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of suffixes by their tokens: each part is split by one token into less, equal and more; equal goes on with the next."""
    out: list[np.ndarray] = []
    todo = [(np.arange(len(tokens[0])), 0)]
    while todo:
        part, depth = todo.pop()
        if depth == len(tokens):
            out.append(part)
        elif len(part) <= LEAF:
            out.append(part[np.lexsort([t[part] for t in reversed(tokens[depth:])])])
        else:
            x = tokens[depth][part]
            pivot = np.sort(x[:: max(1, len(x) // 31)])[min(15, len(x) // 2)]
            less, more = x < pivot, x > pivot
            todo += [(part[more], depth), (part[~(less | more)], depth + 1), (part[less], depth)]
    return np.concatenate(out)


def repeats(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a row is a later member of its class): rows in the order of their tokens, document and place."""
    order = multikey_quicksort(sort_tokens(rows))
    later = np.zeros(len(order), bool)
    if len(order):
        later[1:] = np.logical_and.reduce([rows[t][order][1:] == rows[t][order][:-1] for t in TOKENS])
    return order, later


def gram_hash(rows: dict[str, np.ndarray], take: np.ndarray) -> np.ndarray:
    h = np.zeros(len(take), np.uint64)
    for k in range(4):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[f"w{k}"][take])
    return h


def ranges_of(splitters: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """The range of each suffix: how many splitters (rows of tokens, in order) it isn't before."""
    if not len(splitters):
        return np.zeros(len(tokens[0]), np.int64)
    low, high = (np.searchsorted(splitters[:, 0], tokens[0], side) for side in ("left", "right"))
    part = low.copy()
    tied = np.flatnonzero(low < high)
    if len(tied):
        cuts = [tuple(c) for c in splitters.tolist()]
        for i, row in zip(tied.tolist(), zip(*(t[tied].tolist() for t in tokens), strict=True), strict=True):
            part[i] = bisect_right(cuts, row, int(low[i]), int(high[i]))
    return part


def _spans(rows: dict[str, np.ndarray], take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = rows["start"][take].astype(np.int64)
    return merged_spans(rows["doc"][take], start, start + rows["more"][take] + LENGTH)


def _send(splitters: np.ndarray) -> Callable:
    """Blocks of picked suffixes by range, and the spans that a block alone shows to be repeats (range null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments in _blocks(batches):
            rows = block_rows(segments)
            order, later = repeats(rows)
            doc, start, end = _spans(rows, order[later])
            sent = order[~later]
            part = ranges_of(splitters, [t[sent] for t in sort_tokens(rows)])
            numbers, cuts = np.unique(part, return_index=True)  # suffixes are in order, so ranges are
            blobs = [pack_rows(rows, x) for x in np.split(sent, cuts[1:])]
            spans = np.stack([doc, start, end], 1).astype("<i8").tobytes() if len(doc) else None
            own = [] if spans is None else [spans]
            # what is already known travels with some range, to be passed on there
            tags = [int(numbers[0])] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.tolist() + tags, pa.int32()), pa.array([False] * len(blobs) + [True] * len(own)), pa.array(blobs + own, pa.binary())],
                names=["part", "known", "block"],
            )

    return work


#: Spans to remove (key null); the first member of a class whose suffix has other classes (key: its suffix's fingerprint);
#: and of each range the first suffix (edge 1) and the last (edge 2) with their classes, and the classes of the first and last
#: suffix where it has one only (edges 3 and 4).
FOUND = "key long, class long, doc long, start long, size int, back int, part int, edge int"
_KINDS = [("key", pa.int64()), ("class", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("back", pa.int32()), ("part", pa.int32()), ("edge", pa.int32())]


def _table(*columns) -> pa.Table:
    return pa.table({n: c if isinstance(c, pa.Array) else pa.array(c, k) for (n, k), c in zip(_KINDS, columns, strict=True)})


def _sort_range(table: pa.Table) -> pa.Table:
    number = table.column("part")[0].as_py()
    known, blobs = table.column("known").to_pylist(), table.column("block").to_pylist()
    spans = [np.frombuffer(b, "<i8").reshape(-1, 3) for k, b in zip(known, blobs, strict=True) if k]
    rows = unpack_rows([b for k, b in zip(known, blobs, strict=True) if not k])
    order, later = repeats(rows)
    gram = gram_hash(rows, order)
    firsts = ~later
    # classes to a suffix
    new = np.concatenate([[True], np.logical_or.reduce([rows[f"w{k}"][order][1:] != rows[f"w{k}"][order][:-1] for k in range(4)])])
    group = np.cumsum(new) - 1
    classes = np.bincount(group, weights=firsts)
    several = classes[group] > 1
    doc, start, end = _spans(rows, order[later])
    if spans:
        more = np.concatenate(spans)
        doc, start, end = np.append(doc, more[:, 0]), np.append(start, more[:, 1]), np.append(end, more[:, 2])
        doc, start, end = merged_spans(doc, start, end)
    m = len(doc)
    none, zero = pa.nulls(m, pa.int64()), np.zeros(m, np.int32)
    cut = _table(none, none, doc, start, (end - start).astype(np.int32), zero, zero + number, zero)

    def rows_at(at: np.ndarray, edge: int) -> pa.Table:
        take = order[at]
        kind = mix(gram[at] + rows["content"][take])
        return _table(
            gram[at].view(np.int64), kind.view(np.int64), rows["doc"][take], rows["start"][take].astype(np.int64), rows["more"][take].astype(np.int32) + LENGTH, rows["back"][take].astype(np.int32),
            np.full(len(at), number, np.int32), np.full(len(at), edge, np.int32),
        )

    out = [cut, rows_at(np.flatnonzero(firsts & several), 0), rows_at(np.array([0]), 1), rows_at(np.array([len(order) - 1]), 2)]
    for g, edge in ((0, 3), (int(group[-1]), 4)):
        if classes[g] == 1:
            out.append(rows_at(np.flatnonzero(firsts & (group == g)), edge))
    return pa.concat_tables(out)


def _fetch(ranges: int) -> Callable:
    """Bytes of wanted strings of a document (doc, text, wanted), packed by the hash of their suffix."""

    def flush(parts: list) -> pa.RecordBatch:
        key = np.concatenate([p[0] for p in parts])
        part = (key.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        flat = [x for p in parts for x in p[1]]
        numbers, cuts = np.unique(part[order], return_index=True)
        pack, blobs = zstandard.ZstdCompressor(1).compress, []
        for chunk in np.split(order, cuts[1:]):
            some = [flat[i] for i in chunk.tolist()]
            head = np.array([(k, d, s, z, b) for k, d, s, z, b, _ in some], "<i8")
            blobs.append(len(some).to_bytes(4, "little") + pack(head.tobytes() + b"".join(x[5] for x in some)))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                # rows that share an id may be shorter than what was asked of another
                got = [(w["key"], doc, w["start"], w["size"], w["back"], x) for w in wanted if len(x := raw[w["start"] : w["start"] + w["size"]]) == w["size"]]
                if got:
                    held.append((np.array([g[0] for g in got], np.int64), got))
                    size += 150 * len(got)
                if size >= BLOCK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return work


def _compare(table: pa.Table) -> pa.Table:
    """Of the first members of classes: the strings that an earlier one has too, as spans."""
    heads, bodies = [], []
    unpack = zstandard.ZstdDecompressor().decompress
    for blob in table.column("block").to_pylist():
        n, body = int.from_bytes(blob[:4], "little"), unpack(blob[4:])
        heads.append(np.frombuffer(body, "<i8", 5 * n).reshape(n, 5))
        bodies.append(body[40 * n :])
    head = np.concatenate(heads)
    key, doc, start, size, back = head.T
    hashes = Hashes(np.frombuffer(b"".join(bodies), np.uint8))
    count = size - LENGTH + 1
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(head)), count)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    content = hashes.of(at[row] + nth, LENGTH)
    place = (nth - back[row]).astype(np.uint64)
    same = mix(content + mix(key[row].view(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((start[row] + nth, doc[row], same))
    s = same[order]
    later = order[np.concatenate([[False], s[1:] == s[:-1]])]
    d, a, b = merged_spans(doc[row[later]], start[row[later]] + nth[later], start[row[later]] + nth[later] + LENGTH)
    return pa.table({"doc": pa.array(d, pa.int64()), "start": pa.array(a, pa.int64()), "size": pa.array(b - a, pa.int32())})


def sample_splitters(texts: DataFrame, ranges: int) -> np.ndarray:
    """Suffixes, as rows of tokens, that cut their order into even ranges, from at most about SAMPLE * EACH of them."""
    total = texts.count()
    part = min(1.0, SAMPLE / max(total, 1))
    names = [f"t{i}" for i in range(len(TOKENS) + 2)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segments in _blocks(batches):
            tokens = sort_tokens(block_rows(segments))
            step = max(1, len(tokens[0]) // (EACH * len(segments)))
            yield pa.RecordBatch.from_arrays([pa.array(t[::step].view(np.int64)) for t in tokens], names=names)

    some = texts.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = some.mapInArrow(work, ", ".join(f"{n} long" for n in names)).collect()
    tokens = [np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in range(len(names))]
    if not rows:
        return np.empty((0, len(names)), np.uint64)
    order = multikey_quicksort(tokens)
    at = order[(np.arange(1, ranges) * len(order)) // ranges]
    return np.unique(np.stack([t[at] for t in tokens], 1), axis=0)


def _across(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans, and members to compare, that only ranges side by side show; edges are two rows a range."""
    first = found.filter("edge = 1").select("part", "key", "class", "doc", "start", "size")
    last = found.filter("edge = 2").select("part", F.col("key").alias("last_key"), F.col("class").alias("last_class"))
    up = Window.orderBy("part")
    ends = first.join(last, "part").withColumns({"before": F.lag("part").over(up), "before_key": F.lag("last_key").over(up), "before_class": F.lag("last_class").over(up)})
    spans = ends.filter(F.col("class") == F.col("before_class")).select("doc", "start", "size")
    meet = ends.filter(F.col("key") == F.col("before_key"))
    facing = meet.select("part", F.lit(3).alias("edge")).unionByName(meet.select(F.col("before").alias("part"), F.lit(4).alias("edge")))
    return spans, found.filter("edge >= 3").join(F.broadcast(facing), ["part", "edge"], "left_semi").select("key", "doc", "start", "size", "back")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spans) of documents with repeats: bytes to remove, not yet merged. doc is doc_id, null as the least long."""
    small_batches(docs.sparkSession)
    texts, ranges = _texts(docs), buckets(docs.sparkSession)
    splitters = sample_splitters(texts, ranges)
    sent = texts.mapInArrow(_send(splitters), "part int, known boolean, block binary")
    found = staged(sent.groupBy("part").applyInArrow(_sort_range, FOUND), "suffixes")
    across, both = _across(found)
    asked = found.filter("edge = 0 AND key IS NOT NULL").select("key", "doc", "start", "size", "back").unionByName(both).distinct()
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "size", "back")).alias("wanted"))
    bodies = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_fetch(ranges), "part int, block binary")
    compared = bodies.groupBy("part").applyInArrow(_compare, "doc long, start long, size int")
    spans = found.filter("key IS NULL").select("doc", "start", "size").unionByName(compared).unionByName(across)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"), text_of(docs).alias("text"))


def cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of raw, and the number of maximal removed runs."""
    if not spans:
        return raw, 0
    start = np.array([s["start"] for s in spans], np.int64)
    end = np.minimum(start + np.array([s["size"] for s in spans], np.int64), len(raw))
    keep = start < end
    _, start, end = merged_spans(np.zeros(int(keep.sum()), np.int64), start[keep], end[keep])
    parts, at = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]), len(start)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_report(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs, and the digest of what is left, of each row of docs (doc_id, text)."""
    spans = repeated_spans(docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                left, runs = cut(raw, marks)
                out.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _texts(docs).join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(work, SCHEMA)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs in their own columns, repeated strings cut out of text and n_chars, if it is integral, to match.

    Cuts keep whole characters: a character that loses a byte goes. Null texts stay null.
    """
    doc, marks_of = free(docs, "__doc", "__spans")
    spans = repeated_spans(docs).select(F.col("doc").alias(doc), F.col("spans").alias(marks_of))
    joined = docs.join(spans, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(doc), "left").drop(doc)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.schema.get_field_index("text"), counted(batch.schema)
            marks = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            left = [t if t is None or not m else cut(t.encode(), m)[0].decode("utf-8", "ignore") for t, m in zip(texts, marks, strict=True)]
            arrays = list(batch.columns)[:-1]
            schema = pa.schema(list(batch.schema)[:-1])
            arrays[at] = pa.array(left, schema.field(at).type)
            if n >= 0:
                known = batch.column(n).to_pylist()
                arrays[n] = pa.array([k if x is None else len(x) for x, k in zip(left, known, strict=True)], schema.field(n).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return joined.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(read(spark, sf_dir))

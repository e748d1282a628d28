"""The label baseline: words and pairs of them, smoothed inverse frequencies, unit length, a multinomial linear model.

It is fitted on all rows. Terms are rows of tables, in the fit and in predictions: neither a vocabulary nor weights by terms
lie in the driver. The squares of the weights are kept small, so the best weights are sums of the training texts' vectors. The
driver seeks what each text of the fit adds to each label; what texts have in common is summed in tasks. Entries of texts by
terms are packed in blocks, ranges of terms by their leading bits: columns of numbers, byte by byte, so that they take few bytes.
"""

from __future__ import annotations

import ctypes
import itertools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: Entries of texts by terms to a block, about.
ENTRIES = 2_000_000
#: Places of terms in texts that are sorted at once, about.
PLACES = 500_000
#: Leading bits of a term by which most of the unknown are told.
BITS = 27
#: Workers get batches of a few MB.
SMALL = ("spark.sql.execution.arrow.maxBytesPerBatch", "4000000b")
_PIECE = "block long, ids binary, terms binary, df binary, rows binary, tf binary"
_BLOCK = "terms binary, df binary, rows binary, tf binary, once binary, once_rows binary, once_tf binary"
_WEIGHTS = "block long, terms binary, idf binary, weights binary"


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _planes(numbers: np.ndarray) -> bytes:
    """How many bytes a number takes, then the numbers' first bytes, their second ones and so on."""
    used = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8) if numbers.dtype.kind == "u" else numbers.itemsize
    return bytes([used]) + numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize)[:, :used].T.tobytes()


def _numbers(planes: bytes, kind: str) -> np.ndarray:
    n = (len(planes) - 1) // planes[0]
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    for i, plane in enumerate(np.frombuffer(planes, np.uint8, offset=1).reshape(planes[0], n)):
        out[:, i] = plane
    return out.view(kind).ravel()


def _coded(numbers: np.ndarray) -> bytes:
    """Numbers of few values: how many values, these, and places in them."""
    values, places = np.unique(numbers, return_inverse=True)
    return np.int64(len(values)).tobytes() + values.tobytes() + _planes(places.astype(np.uint32))


def _decoded(coded: memoryview) -> np.ndarray:
    n = int(np.frombuffer(coded, "<i8", 1)[0])
    return np.frombuffer(coded, "<f8", n, 8)[_numbers(coded[8 + 8 * n :], "<u4")]


def _trim() -> None:
    """A worker lives on after its task: what it doesn't use goes back, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _rows(table: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple[memoryview, ...]]:
    """Rows of binary columns, one at a time and not copied."""
    for batch in [table] if isinstance(table, pa.RecordBatch) else table.to_batches():
        for i in range(len(batch)):
            yield tuple(memoryview(batch.column(name)[i].as_buffer()) for name in names)


def _add(out: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    if 4 * len(rows) < len(out):
        np.add.at(out, rows, x)
    else:
        out += np.bincount(rows, x, len(out))


def _table(schema: str, *columns: list) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.binary()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the one before."""
    n = len(columns[0])
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)])[:n])


def _block_of(terms: np.ndarray, bits: int) -> np.ndarray:
    return (terms >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(terms), np.int64)


def _bits(chars: int | None) -> int:
    """Leading bits of a term that give its block, for texts of so many characters: about three make a term's entry."""
    return max(0, math.ceil(math.log2(max(1, (chars or 0) / 3 / ENTRIES))))


def _bit(term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of a term's byte, and its bit in it."""
    return (term >> np.uint64(67 - BITS)).astype(np.int64), np.uint8(1) << (term >> np.uint64(64 - BITS) & np.uint64(7)).astype(np.uint8)


def _known(blocks: DataFrame) -> bytes:
    """A bit for the leading bits of each term, 16 MB whatever the size: what has none needn't be shuffled to be found unknown."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS >> 3, np.uint8)
        for batch in batches:
            for (terms,) in _rows(batch, "terms"):
                byte, bit = _bit(_numbers(terms, "<u8"))  # terms are in order
                first = _starts(byte)
                bits[byte[first]] |= np.bitwise_or.reduceat(bit, first)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)], pa.binary())], names=["part"])

    bits = np.zeros(1 << BITS >> 3, np.uint8)
    for row in _few(blocks.select("terms")).mapInArrow(work, "part binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row["part"]), np.uint8)
    return zlib.compress(bits, 1)


def _few(blocks: DataFrame) -> DataFrame:
    """In one partition for each core: each makes a result that goes to the driver."""
    return blocks.coalesce(max(1, blocks.sparkSession.sparkContext.defaultParallelism))


def _pieces(batches: Iterator[pa.RecordBatch], bits: int, known: bytes | None) -> Iterator[pa.RecordBatch]:
    bitmap = None if known is None else np.frombuffer(zlib.decompress(known), np.uint8)
    for whole in batches:
        upto, low = np.cumsum(whole.column("terms").value_lengths().to_numpy(zero_copy_only=False)), 0
        while low < len(whole):
            before = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, before + PLACES, "right")))
            batch, low = whole.slice(low, high - low), high
            row = np.repeat(np.arange(len(batch), dtype=np.uint32), batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            term = batch.column("terms").flatten().to_numpy().view(np.uint64)
            if bitmap is not None:
                byte, bit = _bit(term)
                has = bitmap[byte] & bit > 0
                row, term = row[has], term[has]
            order = np.argsort(term, kind="stable")  # rows are in order already
            row, term = row[order], term[order]
            first = _starts(term, row)
            row, term, tf = row[first], term[first], np.diff(np.append(first, len(row))).astype(np.uint32)
            cuts = _starts(block := _block_of(term, bits))
            ids = np.array(batch.column("id").to_pylist(), object)
            for a, b in zip(cuts, np.append(cuts, len(term))[1:], strict=True):
                used, rows = np.unique(row[a:b], return_inverse=True)
                terms = term[a:b][at := _starts(term[a:b])]
                df = np.diff(np.append(at, b - a)).astype(np.uint32)
                yield _table(_PIECE, [int(block[a])], [b"".join(ids[used])], [_planes(terms)], [_planes(df)], [_planes(rows.astype(np.uint32))], [_planes(tf[a:b])])
    _trim()


def pieces_of(texts: DataFrame, key: str, text: str, bits: int, known: bytes | None = None) -> DataFrame:
    """Entries of texts by terms, in pieces: ids of texts, terms in order, how many texts each has, places of their ids, how often.

    Terms are words of two characters and more, and pairs of neighbours, by 64-bit fingerprints. Of terms without a bit in
    known, none comes.
    """
    words = texts.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit("(?U)\\b\\w\\w+\\b"), F.lit(0)).alias("w"))
    pairs = F.filter(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    terms = F.transform(F.concat("w", pairs), lambda t: F.xxhash64(t))
    return words.select("id", terms.alias("terms")).mapInArrow(partial(_pieces, bits=bits, known=known), _PIECE)


def _merged(pieces: pa.Table, places: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
    """A block of the fit: its terms, those of one text apart, in how many texts each is, the texts' places, how often."""
    term, row, tf = [], [], []
    for ids, terms, df, rows, n in _rows(pieces, "ids", "terms", "df", "rows", "tf"):
        term.append(np.repeat(_numbers(terms, "<u8"), _numbers(df, "<u4")))
        row.append(places(np.frombuffer(ids, ">i8"))[_numbers(rows, "<u4")])
        tf.append(_numbers(n, "<u4"))
    term, row, tf = np.concatenate(term), np.concatenate(row).astype(np.uint32), np.concatenate(tf)
    order = np.lexsort((row, term))
    term, row, tf = term[order], row[order], tf[order]
    df = np.diff(np.append(first := _starts(term), len(term))).astype(np.uint32)
    once, each = df == 1, np.repeat(df == 1, df)
    _trim()
    out = [term[first][~once], df[~once], row[~each], tf[~each], term[each], row[each], tf[each]]
    return pa.Table.from_batches([_table(_BLOCK, *[[_planes(x)] for x in out])])


def _idf(n: int, df: np.ndarray | int) -> np.ndarray:
    return np.log((n + 1) / (np.asarray(df, float) + 1)) + 1


def _lengths(blocks: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of texts' lengths, and what of them is by terms of no other text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, n))
        for batch in batches:
            for df, rows, tf, once_rows, once_tf in _rows(batch, "df", "rows", "tf", "once_rows", "once_tf"):
                df = _numbers(df, "<u4")
                _add(out[0], _numbers(rows, "<i8"), (_numbers(tf, "<u4") * np.repeat(_idf(n, df), df)) ** 2)
                _add(out[1], _numbers(once_rows, "<i8"), (_numbers(once_tf, "<u4") * _idf(n, 1)) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

    total = np.zeros((2, n))
    for row in _few(blocks.drop("terms", "once")).mapInArrow(work, "part binary").collect():
        total += np.frombuffer(row["part"]).reshape(2, n)
    return total.sum(0), total[1]


def _products(blocks: DataFrame, scale: np.ndarray, own: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that multiplies the table of products of all texts with shares (texts by labels).

    Lengths are scaled by scale; own is what a text's terms of its own add to its product with itself. A text's shares must
    add up to nothing, as slopes do: the last label's products are what the others lack.
    """
    n, calls = len(scale), itertools.count(1)

    def of(shares: np.ndarray) -> np.ndarray:
        given = np.ascontiguousarray((shares[:, :-1] * scale[:, None]).T)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(given)
            for batch in batches:
                for df, rows, tf in _rows(batch, "df", "rows", "tf"):
                    df, rows, tf = _numbers(df, "<u4"), _numbers(rows, "<i8"), _numbers(tf, "<u4").astype(float)
                    starts, squares = np.append(np.cumsum(df, dtype=np.int64) - df, len(rows)), _idf(n, df) ** 2
                    cuts = np.unique(np.searchsorted(starts[:-1], np.arange(0, len(rows), max(1 << 18, n // 4))))
                    for a, b in zip(cuts, np.append(cuts, len(df))[1:], strict=True):
                        r, t = rows[starts[a] : starts[b]], tf[starts[a] : starts[b]]
                        if len(r):
                            for label, share in enumerate(given):
                                sums = np.add.reduceat(share[r] * t, starts[a:b] - starts[a]) * squares[a:b]
                                _add(out[label], r, np.repeat(sums, df[a:b]) * t)
            _trim()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["part"])

        total = np.zeros_like(given)
        for row in _few(blocks.select("df", "rows", "tf")).mapInArrow(work, "part binary").collect():
            total += np.frombuffer(row["part"]).reshape(total.shape)
        if next(calls) % 5 == 0:
            storage.tidy(blocks.sparkSession)  # what was sent to the tasks stays in memory and on disk until then
        return np.append(total, -total.sum(0, keepdims=True), 0).T * scale[:, None] + shares * own[:, None]

    return of


def _loss(margins: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of labels' margins by texts, and the chances they give."""
    top = margins.max(1, keepdims=True)
    chances = np.exp(margins - top)
    whole = chances.sum(1, keepdims=True)
    return float((counts * (np.log(whole) + top - margins)).sum() / counts.sum()), chances / whole


def best_shares(products: Callable[[np.ndarray], np.ndarray], counts: np.ndarray, decay: float, steps: int = 1000, tolerance: float = 1e-9, pairs: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Shares of texts (rows of counts) in labels, and labels' bases, that make mean loss plus decay / 2 of squared weights least.

    L-BFGS in the space of weights, by what the products say of it. A vector is kept as shares, their products and bases, so
    lines are searched without further products: one multiplication a step.
    """
    n, m = len(counts), counts.sum()
    inner = lambda a, b: float((a[:n] * b[n:-1]).sum() + a[-1] @ b[-1])
    margins = lambda v: v[n:-1] + v[-1]
    at, kept, before = np.zeros((2 * n + 1, counts.shape[1])), [], None
    for _ in range(steps):
        loss, chances = _loss(margins(at), counts)
        left = (counts.sum(1, keepdims=True) * chances - counts) / m
        slope = np.concatenate([left, products(left), left.sum(0, keepdims=True)])
        slope[:-1] += decay * at[:-1]
        value = loss + decay / 2 * float((at[:n] * at[n:-1]).sum())
        if inner(slope, slope) <= tolerance**2 or before is not None and before[0] - value <= tolerance * abs(value):
            break
        if before is not None and (curve := inner(before[1], change := slope - before[2])) > 0:
            kept = [*kept[1 - pairs :], (before[1].astype(np.float32), change.astype(np.float32), curve)]
        way, used = -slope, []
        for step, change, curve in reversed(kept):
            used.append(part := inner(step, way) / curve)
            way = way - part * change
        if kept:
            way = way * (kept[-1][2] / inner(kept[-1][1], kept[-1][1]))
        for (step, change, curve), part in zip(kept, reversed(used), strict=True):
            way = way + (part - inner(change, way) / curve) * step
        # the least point of the line: a convex function of one number, halved after doubling
        ways, squares, cross = margins(way), float((way[:n] * way[n:-1]).sum()), float((at[:n] * way[n:-1]).sum())
        rise = lambda s: float(((counts.sum(1, keepdims=True) * _loss(margins(at) + s * ways, counts)[1] - counts) * ways).sum() / m) + decay * (cross + s * squares)
        low, high = 0.0, 1.0
        while rise(high) < 0 and high < 1e6:
            low, high = high, 2 * high
        for _ in range(30):
            middle = (low + high) / 2
            low, high = (middle, high) if rise(middle) < 0 else (low, middle)
        step = (low + high) / 2 * way
        before = (value, step, slope)
        at = at + step
    return at[:n], at[-1]


def _numbered(train: DataFrame, text: str, label: str) -> tuple[DataFrame, np.ndarray, list[str], np.ndarray, int]:
    """Rows with a label, written; how many come before a file's; labels; each row's label; characters."""
    some = train.filter(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("at"), F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))
    rows = storage.scratch(some, "train")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    labels = sorted(r["label"] for r in rows.select("label").distinct().collect())
    before = np.zeros(max([r["part"] for r in sizes], default=0) + 2, np.int64)
    for r in sizes:
        before[r["part"] + 1] = r["n"]
    before, said = np.cumsum(before), np.zeros(sum(r["n"] for r in sizes), np.int64)
    if labels:
        got = rows.select("at", F.array_position(F.array(*map(F.lit, labels)), F.col("label")).alias("said")).toArrow()
        said[_places(got.column("at").to_numpy(), before)] = got.column("said").to_numpy() - 1
    return rows, before, labels, said, sum(r["chars"] or 0 for r in sizes)


def _places(at: np.ndarray, before: np.ndarray) -> np.ndarray:
    return before[at >> 33] + (at & ((1 << 33) - 1))


def label_baseline(train: DataFrame, text: str, label: str) -> LabelBaseline:
    """Fit on all rows of train that have a label, by all their terms."""
    train.sparkSession.conf.set(*SMALL)
    rows, before, labels, said, chars = _numbered(train, text, label)
    n, bits = len(said), _bits(chars)
    identified = rows.select(F.unhex(F.lpad(F.hex("at"), 16, "0")).alias("at"), "text")
    merge = lambda pieces: _merged(pieces, lambda at: _places(at, before))
    blocks = storage.scratch(pieces_of(identified, "at", "text", bits).groupBy("block").applyInArrow(merge, _BLOCK), "blocks")
    storage.discard(rows)
    counts = np.zeros((n, len(labels)))
    counts[np.arange(n), said] = 1
    squares, once = _lengths(blocks, n) if n else (np.zeros(0), np.zeros(0))
    scale = 1 / np.sqrt(np.where(squares > 0, squares, np.inf))
    shares, bases = best_shares(_products(blocks, scale, once * scale**2), counts, 1.0 / n) if n else (counts, np.zeros(0))
    given = np.ascontiguousarray((shares * scale[:, None]).T)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df, rows, tf, once, once_rows, once_tf in _rows(batch, *batch.schema.names):
                df, once = _numbers(df, "<u4"), _numbers(once, "<u8")
                df, terms = np.append(df, np.ones(len(once), np.uint32)), np.append(_numbers(terms, "<u8"), once)
                rows, tf = (np.append(_numbers(a, "<u4"), _numbers(b, "<u4")) for a, b in ((rows, once_rows), (tf, once_tf)))
                idf, starts, order = _idf(n, df), np.cumsum(df, dtype=np.int64) - df, np.argsort(terms)
                sums = [np.add.reduceat(share[rows] * tf, starts) * idf for share in given]
                yield _table(_WEIGHTS, [int(_block_of(terms[:1], bits)[0])], [_planes(terms[order])], [_coded(idf[order])], [np.stack(sums)[:, order].astype("<f4").tobytes()])
        _trim()

    table = storage.scratch(blocks.mapInArrow(weights, _WEIGHTS), "weights")
    storage.discard(blocks)
    return LabelBaseline(table, bits, labels, [float(b) for b in bases], text)


def _weights(terms: bytes, idf: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms = _numbers(terms, "<u8")
    return terms, _decoded(idf), np.frombuffer(weights, "<f4").reshape(-1, len(terms))


def _split(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Weights in blocks of more bits."""
    for batch in batches:
        for row in _rows(batch, "terms", "idf", "weights"):
            terms, idf, weights = _weights(*row)
            cuts = _starts(block := _block_of(terms, bits))
            for a, b in zip(cuts, np.append(cuts, len(terms))[1:], strict=True):
                yield _table(_WEIGHTS, [int(block[a])], [_planes(terms[a:b])], [_coded(idf[a:b])], [weights[:, a:b].tobytes()])


def _scores(pieces: pa.Table, known: pa.Table, labels: int) -> pa.Table:
    """What a block's terms add to texts' squared lengths and to labels; copies of a text count once."""
    keys, parts, seen = [], [], set()
    terms, idf, weights = _weights(*next(_rows(known, "terms", "idf", "weights"))) if len(known) else (np.zeros(0, np.uint64), np.zeros(0), np.zeros((labels, 0)))
    for ids, found, df, rows, tf in _rows(pieces, "ids", "terms", "df", "rows", "tf"):
        if not len(terms):
            break
        names, found, df = [bytes(ids[i : i + 16]) for i in range(0, len(ids), 16)], _numbers(found, "<u8"), _numbers(df, "<u4")
        at = np.minimum(np.searchsorted(terms, found), len(terms) - 1)
        has = terms[at] == found
        at, each = np.repeat(at[has], df[has]), np.repeat(has, df)
        rows = _numbers(rows, "<u4")[each].astype(np.int64)
        x = _numbers(tf, "<u4")[each] * idf[at]
        sums = np.stack([np.bincount(rows, y, len(names)) for y in (x * x, *(x * w[at] for w in weights))], 1)
        new = [i for i, name in enumerate(names) if sums[i, 0] > 0 and not (name in seen or seen.add(name))]
        keys += [names[i] for i in new]
        parts.append(sums[new])
    sums = np.concatenate([np.zeros((0, labels + 1)), *parts])
    return pa.table({"key": pa.array(keys, pa.binary()), **{f"s{i}": sums[:, i] for i in range(labels + 1)}})


class LabelBaseline:
    """A fitted baseline that predicts labels, and that a folder can hold: blocks of terms, the labels and their bases."""

    def __init__(self, blocks: DataFrame, bits: int, labels: list[str], bases: list[float], text: str) -> None:
        self.blocks, self.bits, self.labels, self.bases, self.text = blocks, bits, labels, bases, text

    @property
    def terms(self) -> DataFrame:
        """A row a term."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch, "terms", "idf", "weights"):
                    terms, idf, weights = _weights(*row)
                    yield pa.RecordBatch.from_arrays([terms.view(np.int64), idf, pa.array(list(weights.T.astype(float)), pa.list_(pa.float64()))], names=["term", "idf", "weights"])

        return self.blocks.mapInArrow(rows, "term long, idf double, weights array<double>")

    def __call__(self, df: DataFrame) -> DataFrame:
        if not self.labels:
            return df.withColumn("predicted", F.lit(None).cast("string"))
        df.sparkSession.conf.set(*SMALL)
        key, said = (f"{name}_{uuid.uuid4().hex}" for name in ("key", "said"))
        keyed = df.withColumn(key, _key(self.text))
        n, bits = len(self.labels), max(self.bits, _bits((df.agg(F.sum(F.length(F.col(self.text).cast("string")))).first()[0] or 0) // 2))
        pieces = pieces_of(keyed, key, self.text, bits, _known(self.blocks))
        known = self.blocks if bits == self.bits else self.blocks.mapInArrow(partial(_split, bits=bits), _WEIGHTS)
        score = lambda pieces, known: _scores(pieces, known, n)
        tasks = max(1 << bits >> 3, min(1 << bits, df.sparkSession.sparkContext.defaultParallelism))  # a task adds up what its blocks say of a text
        parts = pieces.repartition(tasks, "block").groupBy("block").cogroup(known.repartition(tasks, "block").groupBy("block")).applyInArrow(score, ", ".join(["key binary", *(f"s{i} double" for i in range(n + 1))]))
        sums = [F.sum(f"s{i + 1}") / F.sqrt(F.sum("s0")) + b for i, b in enumerate(self.bases)]
        scores = parts.groupBy("key").agg(F.array(*sums).alias(said)).withColumnRenamed("key", key)
        of = F.coalesce(F.col(said), F.array(*map(F.lit, self.bases)))  # a text without known terms has the bases
        first = F.array_position(of, F.array_max(of)).cast("int") - 1
        return keyed.join(scores, key, "left").select(*df.columns, F.get(F.array(*map(F.lit, self.labels)), first).alias("predicted"))

    def save(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        rows = [(i, x, b, self.text, self.bits) for i, (x, b) in enumerate(zip(self.labels, self.bases, strict=True))]
        self.blocks.sparkSession.createDataFrame(rows, "ix int, label string, base double, text string, bits int").coalesce(1).write.parquet(f"{path}/labels")

    @staticmethod
    def load(path: str) -> LabelBaseline:
        spark = SparkSession.active()
        rows = spark.read.parquet(f"{path}/labels").orderBy("ix").collect()
        return LabelBaseline(spark.read.schema(_WEIGHTS).parquet(f"{path}/blocks"), rows[0]["bits"] if rows else 0, [r["label"] for r in rows], [r["base"] for r in rows], rows[0]["text"] if rows else "text")

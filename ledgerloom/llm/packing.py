"""Mixture-controlled packing: every window takes the target proportion of each source.

Each source is a queue of tokens with a target weight. A deficit round-robin gives queue j its part of every window and
carries what rounding withholds to the next one. Served that way, queue j has given ``floor(y P_j) - floor(y P_(j-1))``
tokens after y tokens in all (P: running sums of the targets), so what each window takes, and where in the window it
lies, follows from y alone: windows need no common state, and partitions agree on them without talking to each other.
The carried deficit is ``y p_j`` minus what the queue has given, less than one token either way.

Targets are weights by source (sources without one come last), or, without ``targets``, the sources' tokens to the power
``temperature``: 1 keeps natural proportions, less favours small sources. As each token is packed once, a mixture runs in
phases: every window has the targets' proportions among the sources that are left, until the first of them runs dry.

Sources with less than one token a window share a queue, unless the targets name them, so there are at most as many
queues as a window has tokens and targets have names, whatever the number of sources.

Places within a queue: a hash deals its documents to blocks, block sums give the blocks' starts in two levels, and each
block sums its own documents. A hot source is spread over as many blocks as it needs.

Tokens are those of the tokenizers library (the tests hold them against it); see ``LibraryTokens``.

Defined results: a null or empty text is its end token alone; a null source is a source; repeated rows are packed once
each; rows that share an id, or have none, are packed each on its own; documents longer than a window are cut; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import PATTERN, ByteBPE, default_vocabulary, packed
from .common import read, small_batches, staged, text_of

END = 1
WINDOW = 2048
#: Documents to a block and blocks to a stretch, about; each is one group of a window function.
BLOCK, STRETCH = 1000, 1000
#: Power of the sources' tokens that the query's mixture weights follow.
TEMPERATURE = 0.7


class LibraryTokens(ByteBPE):
    """Pieces are cut and kept as in ByteBPE; new ones are encoded by libraries, with the ids of the tokenizers library.

    Where the ids of a vocabulary follow the order of its merges, and merging any token's bytes gives the token, its
    merge list and its ranks are the same encoder, and the faster of the two libraries reads it as ranks. Otherwise the
    tokenizers library encodes with the file as it is.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        ranks = {b: i for b, i in self.id_of.items()}
        made = self.made[np.array(sorted(ranks.values()))]
        if bool((np.diff(made[made >= 0]) > 0).all()) and (made[:256] < 0).all() and self.sound[sorted(ranks.values())].all():
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.width = np.array([len(b) for b in self.bytes_of], np.int64)
        else:
            from tokenizers import Tokenizer

            self.ranked, self.library = None, Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()

    def encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        if self.ranked is None:
            encoded = self.library.encode_batch(pieces, add_special_tokens=False)
            return {p: packed(e.ids) for p, e in zip(pieces, encoded, strict=True)}
        # Pieces from one blank to the next are encoded as one text: no word crosses from one into another.
        plain = [p for p in pieces if p[0] in " \n\t" and not p[-1].isspace()]
        rest = set(pieces).difference(plain)
        out = {p: packed(self.ranked.encode_ordinary(p)) for p in rest}
        for at in range(0, len(plain), 50_000):
            some = plain[at : at + 50_000]
            ids = np.array(self.ranked.encode_ordinary("".join(some)), "<u4")
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in some])) + 1
            blob, low = ids.tobytes(), 0
            for p, high in zip(some, (4 * ends).tolist(), strict=True):
                out[p], low = blob[low:high], high
        return out


@lru_cache(maxsize=2)
def library(path: str) -> LibraryTokens:
    return LibraryTokens(path)


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n (with the end token), ids (two or four bytes each, little-endian) and their checksum of each row."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library(vocabulary or default_vocabulary())
        for batch in batches:
            ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(END)) for x in tokens.encode_batch(batch.column(2).to_pylist())]
            blobs = [packed_ids(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(blobs, pa.binary()),
                    pa.array([zlib.crc32(x) for x in blobs], pa.int64()),
                ],
                names=["doc_id", "source", "n", "ids", "tag"],
            )

    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"), text_of(docs).alias("text"))
    return rows.mapInArrow(work, "doc_id long, source string, n long, ids binary, tag long")


def packed_ids(ids: np.ndarray) -> bytes:
    """A leading byte with the width, then the ids."""
    narrow = not len(ids) or int(ids.max()) < 65536
    return (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())


def unpacked_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype("<u4")


class Plan:
    """Where each queue's tokens go. ends[j]: tokens of the queues up to j."""

    def __init__(self, sizes: list[int], window: int = WINDOW) -> None:
        self.window, self.total = window, sum(sizes)
        self.ends = [0]
        for n in sizes:
            self.ends.append(self.ends[-1] + n)
        self.windows = -(-self.total // window)
        rest = self.total - (self.windows - 1) * window if self.total else 0
        #: The last window, if it isn't full, is cut at powers of two, which need no padding.
        self.tail = [0]
        while self.tail[-1] < rest:
            self.tail.append(self.tail[-1] + (1 << ((rest - self.tail[-1]).bit_length() - 1)))

    def given_below(self, w: int, j: int) -> int:
        """Tokens that the queues before j have given after w windows."""
        return min(w * self.window, self.total) * self.ends[j] // self.total

    def given(self, w: int, j: int) -> int:
        return self.given_below(w, j + 1) - self.given_below(w, j)

    def deficit(self, w: int, j: int) -> float:
        """What queue j is owed after w windows."""
        share = (self.ends[j + 1] - self.ends[j]) / self.total
        return min(w * self.window, self.total) * share - self.given(w, j)

    def pieces(self, j: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document of n tokens at start in queue j."""
        size = self.ends[j + 1] - self.ends[j]
        at, end = start, start + n
        w = max(0, at * self.total // (size * self.window) - 1)
        while self.given(w + 1, j) <= at:
            w += 1
        while at < end:
            low, high = self.given(w, j), self.given(w + 1, j)
            upto = min(end, high)
            offset = self.given_below(w + 1, j) - self.given_below(w, j) + at - low
            if w == self.windows - 1 and len(self.tail) > 1:
                while at < upto:
                    k = bisect_right(self.tail, offset) - 1
                    length = min(upto - at, self.tail[k + 1] - offset)
                    yield at - start, length, w + k, offset - self.tail[k]
                    at, offset = at + length, offset + length
            elif upto > at:
                yield at - start, upto - at, w, offset
            at, w = upto, w + 1


class Mixture:
    """Where each queue's tokens go, phase by phase."""

    def __init__(self, sizes: list[int], weights: list[float], window: int = WINDOW) -> None:
        self.phases: list[tuple[Plan, int]] = []  # with the phase's first sequence
        self.begins: list[list[int]] = [[] for _ in sizes]  # of each queue, by phase
        at, first = [0] * len(sizes), 0
        for windows, take in phases(dict(enumerate(sizes)), dict(enumerate(weights)), window):
            part = [take.get(j, 0) for j in range(len(sizes))]
            self.phases.append((Plan(part, window), first))
            for j, n in enumerate(part):
                self.begins[j].append(at[j])
                at[j] += n
            first += windows

    def pieces(self, j: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset) of a document of n tokens at start in queue j."""
        begins, at, end = self.begins[j], start, start + n
        k = bisect_right(begins, at) - 1
        while at < end:
            upto = min(end, begins[k + 1]) if k + 1 < len(begins) else end
            if upto > at:
                plan, first = self.phases[k]
                for s, length, sequence, offset in plan.pieces(j, at - begins[k], upto - at):
                    yield at - start + s, length, first + sequence, offset
            at, k = upto, k + 1


def queues_of(sums: DataFrame, total: int, window: int = WINDOW, named: list[str] | None = None) -> list[tuple[list[str | None] | None, int]]:
    """(sources, tokens) of each queue, largest first; None: all sources that have no queue of their own.

    Only sources that are named, or have a token a window or more, are fetched: the latter are fewer than a window has
    tokens.
    """
    own = F.col("n") * window >= total
    own = own | F.coalesce(F.col("source").isin(named), F.lit(False)) if named else own
    large = [(r["source"], r["n"]) for r in sums.filter(own).orderBy(F.desc("n"), "source").collect()]
    rest = total - sum(n for _, n in large)
    out: list[tuple[list[str | None] | None, int]] = [([s], n) for s, n in large]
    if rest and rest * window < total and out and not named:
        rest += out.pop()[1]  # too small even together: they join the smallest queue
    if rest:
        out.append((None, rest))
    return out


def phases(tokens: dict[str, int], targets: dict[str, float], window: int = WINDOW) -> list[tuple[int, dict[str, int]]]:
    """(windows, tokens a phase takes of each source) for targets other than the sources' own shares.

    In a phase every window has the targets' proportions among the sources left, and a token at least of each that has a
    weight; it ends when the first runs dry.
    """
    left, out = {s: n for s, n in tokens.items() if n}, []
    while left:
        weight = {s: max(targets.get(s, 0.0), 0.0) for s in left}
        if not sum(weight.values()):
            weight = dict(left)
        live = _shares(weight, window)
        count = min(int(left[s] // (window * p)) for s, p in live.items())
        if count:
            take = {s: min(left[s], int(count * window * p)) for s, p in live.items()}
            short = count * window - sum(take.values())
            for s in sorted(live, key=lambda s: (-(left[s] - take[s]), s)):
                more = min(short, left[s] - take[s])
                take[s], short = take[s] + more, short - more
        else:  # less than a window of the scarcest source: the rest goes in proportion to what there is
            take = dict(left) if sum(left.values()) <= window else _one_window(left, live, window)
        out.append((-(-sum(take.values()) // window), {s: n for s, n in take.items() if n}))
        left = {s: n - take.get(s, 0) for s, n in left.items() if n > take.get(s, 0)}
    return out


def _shares(weight: dict, window: int) -> dict:
    """Parts of a window by weight, none below one token; of more sources than a window has tokens, the heaviest."""
    some = sorted((s for s in weight if weight[s]), key=lambda s: -weight[s])[:window]
    least: list = []
    while True:
        others = sum(weight[s] for s in some if s not in least)
        part = {s: 1 / window if s in least else weight[s] / others * (1 - len(least) / window) for s in some}
        small = [s for s in some if s not in least and part[s] < 1 / window]
        if not small:
            return part
        least += small


def _one_window(left: dict[str, int], live: dict[str, float], window: int) -> dict[str, int]:
    take = {s: min(left[s], int(window * p)) for s, p in live.items()}
    for s in sorted(left, key=lambda s: (-live.get(s, 0.0), s)):
        more = min(window - sum(take.values()), left[s] - take.get(s, 0))
        take[s] = take.get(s, 0) + more
    return take


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(
    docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 1.0, window: int = WINDOW, vocabulary: str | None = None
) -> DataFrame:
    """One row per piece of each document. targets: weights by source, as many as a window has tokens at most."""
    if targets is not None and (len(targets) > window or not all(0 <= w < float("inf") for w in targets.values())):
        raise ValueError("targets are weights from 0 on, as many as a window has tokens at most")
    spark = docs.sparkSession
    table = staged(token_table(docs, vocabulary), "tokens")
    sums = table.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    totals = sums.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).first()
    if not totals["n"]:
        return spark.createDataFrame([], SCHEMA)
    queues = queues_of(sums, totals["n"], window, sorted(targets or {}))
    sizes = [n for _, n in queues]
    if targets is None:
        weights = [float(n) ** temperature for n in sizes]
    else:
        weights = [sum(targets.get(s, 0.0) for s in names or []) for names, _ in queues]
    mixture = Mixture(sizes, weights, window)
    blocks = max(1, totals["docs"] // BLOCK)
    # At most `window` names and as many again that targets name, so the map is bounded.
    own = {s: j for j, (names, _) in enumerate(queues) for s in names or []}
    last = len(queues) - 1
    named = [x for s, j in own.items() if s is not None for x in (F.lit(s), F.lit(j))]
    queue = F.coalesce(F.element_at(F.create_map(*named), F.col("source")), F.lit(last)) if named else F.lit(last)
    queue = F.when(F.col("source").isNull(), F.lit(own.get(None, last))).otherwise(queue)
    block = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(blocks))
    placed = table.withColumns({"q": queue, "b": block.cast("long")})
    sums = placed.groupBy("q", "b").agg(F.sum("n").alias("n")).withColumn("c", (F.col("b") / STRETCH).cast("long"))
    wide = sums.groupBy("q", "c").agg(F.sum("n").alias("m")).select(
        "q", "c", (F.sum("m").over(Window.partitionBy("q").orderBy("c")) - F.col("m")).alias("before")
    )
    starts = sums.withColumn("own", F.sum("n").over(Window.partitionBy("q", "c").orderBy("b")) - F.col("n")).join(wide, ["q", "c"])
    starts = starts.select("q", "b", (F.col("own") + F.col("before")).alias("block_start"))
    within = Window.partitionBy("q", "b").orderBy("doc_id", "n", "tag", "ids")
    rows = (
        placed.join(starts, ["q", "b"])
        .withColumn("at", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + F.col("block_start"))
        .select("doc_id", "source", "q", "at", "ids")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, source, q, at, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpacked_ids(blob)
                for start, length, sequence, offset in mixture.pieces(q, at, len(ids)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    out.append((doc, start, length, crc, len(ids), sequence, offset, source))
            columns = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return rows.mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir), temperature=TEMPERATURE)

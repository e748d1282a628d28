"""N-gram Jaccard join: size bands, tiles of neighbouring bands, hashed bitmaps, exact intersections.

Sets of sizes a <= b with similarity p % differ in at most (a + b)(100 - p)/(100 + p) elements, and b is at most
100 a / p. So sizes are cut into bands such that links stay within a band or reach the next, and the two make a tile.
A tile deals elements to one part more than sets may differ in: two linked sets agree in at least one whole part, whose
fingerprint both emit. Where parts are empty in a set, agreement there says nothing; a tile has parts in reserve for
that, and a set with more empty parts than the reserve is dealt anew with another salt as well, as any other such set
is. So no link is lost, and sets meet only if they share a whole part, however common single shingles are.

Sets that meet are compared with the least of those they meet. The bits of one's bitmap that the other lacks bound the
overlap from above; what passes is intersected exactly as sorted arrays. Where a meeting is in several components after
that, the set with the most links that wasn't yet compared with all is, and so on for HUBS rounds: copies of a text that
are near to it and not to each other become one component by that text, in as many comparisons as there are copies.
Members of a meeting that are in different components even then are compared tile by tile on bitmaps, and what passes
exactly.

Fingerprints travel as packed blocks: a few bytes each, a block per key range. Equal sets of a block are sent once.

Defined results: a null or empty text, or one of white space, has the empty set and is linked with nothing; repeated
rows are linked, and rows that share an id stay or go together; texts of any length count whole; a null id is less than
all others; an empty table gives an empty result; extra columns are ignored by ``jaccard_classes`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, discard, free, read, small_batches, staged, text_of
from .components import components
from .shingles import mix, shingle_sets

#: Bytes of text and rows to a block of sets.
BLOCK_BYTES, BLOCK_ROWS = 3 << 20, 16000
#: Bits of a bitmap to an element, and sets to a side of a tile of bitmaps.
BITS, SIDE = 8, 512
#: Rounds in which hubs are compared; more or fewer change the work, not the result.
HUBS = 1
#: Members of a meeting to a row.
CHUNK = 4096
_PAIR = np.dtype([("sig", "<u4"), ("at", "<u2")])
_HIGH = 1 << 15
NO_ID = -(1 << 63)


class Bands:
    """Size bands and the tiles' numbers of parts, extended as sizes need."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.lows = [1]
        self.parts: list[int] = []
        self.reserve: list[int] = []

    def of(self, sizes: np.ndarray) -> np.ndarray:
        p = self.percent
        while not self.parts or self.lows[-1] <= int(sizes.max(initial=1)):
            low = self.lows[-1]
            self.lows.append(100 * low // p + 1)
            largest = self.lows[-1] - 1
            differ = (largest + 100 * largest // p) * (100 - p) // (100 + p)
            spare = int(np.ceil(2 * (differ + 1) * np.exp(-low / (differ + 1)))) if differ else 0
            self.reserve.append(spare)
            self.parts.append(differ + 1 + spare)
        return np.searchsorted(np.array(self.lows), sizes, "right") - 1


def fingerprints(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprint, set and role) of the parts of non-empty sets in their tiles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    band = bands.of(sizes)
    parts, reserve = np.array(bands.parts), np.array(bands.reserve)
    found, places = [], []

    def deal(rows: np.ndarray, tile: np.ndarray, high: int, salt: int) -> None:
        while len(rows):
            k = parts[tile]
            elements = np.concatenate([sets[i] for i in rows])
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            start = np.cumsum(k) - k
            salted = mix(elements ^ mix((tile * 1000 + salt).astype(np.uint64))[owner])
            part = (salted >> np.uint64(20)) % k[owner].astype(np.uint64)
            at = start[owner] + part.astype(np.int64)
            total = np.zeros(int(k.sum()), np.uint64)
            np.add.at(total, at, salted)
            filled = np.zeros(len(total), bool)
            filled[at] = True
            place = np.repeat(np.arange(len(rows)), k)
            number = np.arange(len(total)) - start[place]
            tag = (tile[place] * 1000 + salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64)
            found.append(mix(total + mix(tag))[filled])
            places.append(rows[place[filled]] | high)
            empty = np.bincount(place[~filled], minlength=len(rows))
            again = empty > reserve[tile]
            rows, tile, salt = rows[again], tile[again], salt + 1

    some = np.flatnonzero(sizes > 0)
    deal(some, band[some], 0, 0)
    upper = some[band[some] > 0]
    deal(upper, band[upper] - 1, _HIGH, 0)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


STAGED = "bucket int, node long, doc_id long, said long, n long, key binary, block binary"


def _emit(width: int, percent: int, ranges: int):
    """Rows of documents (bucket null) and blocks of fingerprints (bucket, first node of the block)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bands, block = TaskContext.get().partitionId(), Bands(percent), 0

        def flush(ids: list, said: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal block
            base = (task << 40) | (block << 15)
            block += 1
            sets = shingle_sets(texts, width)
            keys = [_key(s) if len(s) else None for s in sets]
            first: dict[bytes, int] = {}
            nodes = [base + (first.setdefault(k, i) if k else i) for i, k in enumerate(keys)]
            sent = np.array(sorted(first.values()), np.int64)
            sig, at = fingerprints([sets[i] for i in sent], bands)
            at = sent[at & (_HIGH - 1)] | (at & _HIGH) if len(at) else at
            bucket = (sig >> np.uint64(33)) % np.uint64(ranges)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty(len(sig), _PAIR)
            packed["sig"], packed["at"] = (sig & np.uint64(0xFFFFFFFF))[order], at[order]
            numbers, cuts = np.unique(bucket[order], return_index=True)
            blocks = [x.tobytes() for x in np.split(packed, cuts[1:])] if len(numbers) else []
            m, k = len(ids), len(blocks)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * m + numbers.tolist(), pa.int32()),
                    pa.array(nodes + [base] * k, pa.int64()),
                    pa.array(ids + [None] * k, pa.int64()),
                    pa.array(said + [None] * k, pa.int64()),
                    pa.array([len(s) for s in sets] + [None] * k, pa.int64()),
                    pa.array(keys + [None] * k, pa.binary()),
                    pa.array([None] * m + blocks, pa.binary()),
                ],
                names=["bucket", "node", "doc_id", "said", "n", "key", "block"],
            )

        ids, hashes, texts, size = [], [], [], 0
        for batch in batches:
            for doc, text, hashed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                ids.append(doc)
                hashes.append(hashed)
                texts.append(raw)
                size += len(raw)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield flush(ids, hashes, texts)
                    ids, hashes, texts, size = [], [], [], 0
        if ids:
            yield flush(ids, hashes, texts)

    return work


MEETINGS = "a long, b long, list long, members array<long>"


def _list_rows(members: list[int]) -> list[tuple[int, int, list[int]]]:
    """Rows (name, first member, some members) of a meeting; the name is a hash of all, so the same meeting has it anywhere."""
    name = int.from_bytes(hashlib.blake2b(np.array(members, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
    return [(name, members[0], members[i : i + CHUNK]) for i in range(0, len(members), CHUNK)]


def _meet(table: pa.Table) -> pa.Table:
    """Of a key range's blocks: pairs (a, b) of the least set of each meeting and another; meetings of three or more, b their least."""
    sigs, nodes, highs = [], [], []
    for base, blob in zip(table.column("node").to_pylist(), table.column("block").to_pylist(), strict=True):
        rows = np.frombuffer(blob, _PAIR)
        sigs.append(rows["sig"])
        nodes.append((rows["at"] & (_HIGH - 1)).astype(np.int64) + base)
        highs.append(rows["at"] >= _HIGH)
    sig, node, high = np.concatenate(sigs), np.concatenate(nodes), np.concatenate(highs)
    order = np.argsort(sig, kind="stable")
    sig, node, high = sig[order], node[order], high[order]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lengths = np.diff(np.append(starts, len(sig)))
    pairs: set[tuple[int, int]] = set()
    lists: dict[int, list[tuple[int, int, list[int]]]] = {}
    for s, n in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
        lower = ~high[s : s + n]
        if not lower.any():
            continue  # sets of the upper band meet in their own tile
        members = node[s : s + n]
        pivot = int(members[lower].min())
        others = sorted(set(members.tolist()) - {pivot})
        pairs.update((pivot, x) for x in others)
        if len(others) > 1:
            rows = _list_rows([pivot, *others])
            lists.setdefault(rows[0][0], rows)
    listed = [r for rows in lists.values() for r in rows]
    k, m = len(pairs), len(listed)
    return pa.table(
        {
            "a": pa.array([p[0] for p in pairs] + [None] * m, pa.int64()),
            "b": pa.array([p[1] for p in pairs] + [r[1] for r in listed], pa.int64()),
            "list": pa.array([None] * k + [r[0] for r in listed], pa.int64()),
            "members": pa.array([None] * k + [r[2] for r in listed], pa.list_(pa.int64())),
        }
    )


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap with a power of two of bits, BITS to an element at least."""
    n = max(64, 1 << int(BITS * len(s) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(mix(s) % np.uint64(n)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """A bitmap at a smaller power of two: remainders agree, so halves are laid on one another bit by bit."""
    while len(bits) > n:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(a: int, b: int, x: bytes, y: bytes, percent: int) -> bool:
    """Whether bitmaps x and y of sets of a and b elements leave room for a link."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(p), len(q))
    p, q = folded(p, n), folded(q, n)
    missing = int(np.bitwise_count(p & ~q).sum()), int(np.bitwise_count(q & ~p).sum())
    common = min(a - missing[0], b - missing[1])
    return linked(common, a, b, percent)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _verify(width: int, percent: int):
    """Of pairs with sizes, bitmaps and packed texts, those that are linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            keep = []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for i, (a, _, na, nb, xa, xb, za, zb) in enumerate(rows):
                if not may_link(na, nb, xa, xb, percent):
                    continue
                if last is None or last[0] != a:
                    last = a, shingle_sets([unpack(za)], width)[0]
                other = shingle_sets([unpack(zb)], width)[0]
                if linked(len(np.intersect1d(last[1], other, assume_unique=True)), na, nb, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return work


def _tile(percent: int):
    """Pairs of a tile that are in different components and whose bitmaps leave room for a link."""

    def work(table: pa.Table) -> pa.Table:
        node, comp, side, n = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "component", "side", "n"))
        maps = table.column("bits").to_pylist()
        least = min(map(len, maps))
        bits = np.unpackbits(np.stack([folded(np.frombuffer(x, np.uint8), least) for x in maps]), axis=1).astype(np.float32)
        same = (side == side[0]).all()
        rows = np.arange(len(node)) if same else np.flatnonzero(side == side.min())
        cols = rows if same else np.flatnonzero(side != side.min())
        both = bits[rows] @ bits[cols].T
        ones = bits.sum(1)
        common = np.minimum(n[rows, None] - (ones[rows, None] - both), n[None, cols] - (ones[None, cols] - both))
        union = n[rows, None] + n[None, cols] - common
        near = (100 * common >= percent * union) & (comp[rows, None] != comp[None, cols])
        i, j = np.nonzero(near)
        a, b = node[rows[i]], node[cols[j]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return work


def jaccard_classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs).alias("text")).withColumn("said", F.xxhash64("text"))
    made = staged(texts.mapInArrow(_emit(width, percent, buckets(spark)), STAGED), "shingles")
    rows = staged(made.filter("bucket IS NULL").select("doc_id", "said", "node", "n", "key"), "rows")
    met = staged(made.filter("bucket IS NOT NULL").select("bucket", "node", "block").groupBy("bucket").applyInArrow(_meet, MEETINGS), "meetings")
    discard(made)
    pairs = met.filter("a IS NOT NULL").select("a", "b").distinct()
    chunks = met.filter("members IS NOT NULL").groupBy("list", F.element_at("members", 1).alias("from")).agg(F.first("b").alias("pivot"), F.first("members").alias("members"))
    lists = chunks.select("list", F.explode("members").alias("node"))

    # What has met: sizes, bitmaps and packed texts, of one text for each set.
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = rows.join(nodes, "node").groupBy("node").agg(F.first("key").alias("key"))
    one = rows.join(named.select("key").distinct(), "key").groupBy("key").agg(F.min(F.struct("doc_id", "said")).alias("r")).select("key", "r.doc_id", "r.said")
    packed = staged(texts.join(one, ["doc_id", "said"]).select("key", "text").mapInArrow(_pack_sets(width), "key binary, n long, bits binary, z binary"), "packed")
    sets = staged(named.join(packed.dropDuplicates(["key"]), "key").select("node", "n", "bits", "z"), "sets")
    discard(packed)

    def verified(pairs: DataFrame) -> DataFrame:
        right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("z").alias("zb"))
        left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("z").alias("za"))
        full = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "xa", "xb", "za", "zb")
        return full.mapInArrow(_verify(width, percent), "a long, b long")

    # Equal sets in different blocks are links as well.
    filled = rows.filter("key IS NOT NULL")
    first = filled.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("top")).filter("b != top").select("key", "b")
    equal = filled.select("node", "key").distinct().join(first, "key").select(F.col("node").alias("a"), "b").filter("a != b")
    links = staged(verified(pairs).unionByName(equal), "links")
    comps = components(links)

    # Meetings that aren't in one component yet: hubs, then tiles.
    mixed = staged(_mixed(lists, comps), "mixed")
    used = chunks.select("list", F.col("pivot").alias("node")).distinct()
    for _ in range(HUBS):
        if mixed.isEmpty():
            break
        new, hubs = _by_hubs(mixed, links, used)
        used = used.unionByName(staged(hubs, "hubs"))
        before, links = links, staged(links.unionByName(verified(new)), "links")
        comps = components(links)
        wider, mixed = mixed, staged(_mixed(mixed.select("list", "node"), comps), "mixed")
        discard(before, wider)
    rest = staged(_tiles(mixed, sets, percent).distinct(), "rest")
    if not rest.isEmpty():
        comps = components(links.unionByName(verified(rest)))
    discard(met, sets, links, mixed, rest)
    placed = rows.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return placed.join(least, "component").select(known("doc_id"), F.col("n").alias("n_shingles"), known("component_id"))


def _mixed(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """(list, node, component) of the meetings whose members are in several components."""
    placed = lists.join(comps, "node", "left").select("list", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("list")
    return placed.join(several, "list")


def _by_hubs(mixed: DataFrame, links: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each meeting's hub with its members in other components; and (list, node) of the hubs.

    The hub is the member with the most links, of equals the largest, that wasn't one before.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    able = mixed.join(used, ["list", "node"], "left_anti").join(degree, "node", "left").select("list", "node", "component", F.coalesce("links", F.lit(0)).alias("links"))
    hubs = able.groupBy("list").agg(F.max_by(F.struct("node", "component"), F.struct("links", "node")).alias("h")).select("list", F.col("h.node").alias("hub"), F.col("h.component").alias("own"))
    met = mixed.join(hubs, "list").filter("component != own")
    new = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    return new, hubs.select("list", F.col("hub").alias("node"))


def _tiles(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a meeting in different components whose bitmaps leave room for a link."""
    order = Window.partitionBy("list").orderBy("node")
    side = mixed.withColumn("side", ((F.row_number().over(order) - 1) / SIDE).cast("int"))
    last = side.groupBy("list").agg(F.max("side").alias("last"))
    tiles = side.join(last, "list").select("list", "node", "component", "side", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    tiles = tiles.select("list", "node", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    return tiles.join(sets.select("node", "n", "bits"), "node").groupBy("list", "i", "j").applyInArrow(_tile(percent), "a long, b long")


def _pack_sets(width: int):
    """Of texts with the key that their set shall have: key, size, bitmap and packed text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                s = shingle_sets([raw], width)[0]
                if _key(s) == key:  # texts of one id and hash may differ
                    out.append((key, len(s), bitmap(s), pack(raw)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n", "bits", "z"])

    return work


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs in their own columns, of each class the one with the smallest doc_id."""
    classes = jaccard_classes(docs, width, percent)
    (name,) = free(docs, "__kept")
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read(spark, sf_dir))

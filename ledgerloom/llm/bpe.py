"""Byte-pair encoding by speculation: propose tokens greedily, verify all adjacent pairs at once, merge only what fails.

A sequence of tokens is what merging gives if, and only if, each token is what merging its own bytes gives and each
adjacent pair is compatible: merging the pair's bytes gives the pair. So a word's tokens are proposed by longest match
in the vocabulary, all pairs of a batch of words are tested together on arrays, and words with a failing pair (or a
token that merging doesn't give) are merged exactly.

A text is cut where no word of the pre-tokeniser crosses: before each run of white space. Each piece's ids are kept in
a bounded table, so that a worker encodes a piece once.

Defined results: a null or empty text has no ids; repeated rows get equal results; very long pieces are merged with a
heap in n log n; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches, text_of

#: Pieces that a worker's table holds before it starts afresh.
TABLE = 600_000
#: Failing words up to these lengths in bytes are merged together, a matrix for each; longer ones one by one.
TOGETHER = (8, 12, 16, 24, 40)
#: Bytes of a token's beginning by which the lengths to try are looked up.
LEAD = 3
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Fixed value: how the vocabulary's pre-tokeniser cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file, with whole-text ids equal to the library's."""

    room = TABLE

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        if odd := [t["content"] for t in spec["added_tokens"] if any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized"))]:
            raise ValueError(f"added tokens that are found in other ways than as they stand: {odd}")
        self.id_of = {raw(t): i for t, i in vocab.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        #: For each id, the rank of the merge that makes it (-1: a byte) and its two parts (itself for a byte).
        self.made = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, (a, b) in enumerate(merges):
            x, y = self.id_of[raw(a)], self.id_of[raw(b)]
            z = self.id_of[raw(a) + raw(b)]
            self.rank.setdefault((x, y), (r, z))
            if self.made[z] < 0:
                self.made[z], self.left[z], self.right[z] = r, x, y
        pairs = sorted((x * size + y, r) for (x, y), (r, _) in self.rank.items())
        self.size = size
        self.merge_id = np.full(len(merges), -1, np.int64)
        for r, z in self.rank.values():
            self.merge_id[r] = z
        self.byte_id = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self._cutters(self.special)
        #: Lengths of the tokens with a beginning, longest first; those of one and two bytes may be met anywhere.
        lengths: dict[bytes, set[int]] = {}
        for b in self.id_of:
            lengths.setdefault(b[:LEAD], {1, 2}).add(len(b))
        self.lengths = {b: tuple(sorted(n, reverse=True)) for b, n in lengths.items() if len(b) == LEAD}
        #: Tokens that merging their own bytes gives; others are never taken from a proposal.
        self.sound = np.ones(size, bool)
        some = [i for i, b in enumerate(self.bytes_of) if len(b) > 1]
        for i, x in zip(some, self.merged_all([self.bytes_of[i] for i in some]), strict=True):
            self.sound[i] = x == [i]
        self.stats = {"words": 0, "merged": 0}

    def _cutters(self, special: dict[str, int]) -> None:
        self.special = special
        self.words = regex.compile(PATTERN)
        self.pieces = regex.compile(r"\s*\S+|\s+")
        self.doubled = re.compile(r"\s\x20")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.table: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of least rank, leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.rank[p], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heap = [(r, i, z, p) for r, z, i, p in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, p = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != p[0] or j >= n or ids[j] != p[1]:
                continue
            ids[i], ids[j] = z, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (q := (ids[a], ids[b])) in self.rank:
                    r, made = self.rank[q]
                    heapq.heappush(heap, (r, a, made, q))
        return [x for x in ids if x is not None]

    def proposed(self, word: bytes) -> list[int]:
        """The word itself if it is a token, else the longest match from the left."""
        if (t := self.id_of.get(word)) is not None:
            return [t]
        out, i, n, id_of, lengths = [], 0, len(word), self.id_of, self.lengths
        while i < n:
            for k in lengths.get(word[i : i + LEAD], (2, 1)):
                if k <= n - i and (t := id_of.get(word[i : i + k])) is not None:
                    out.append(t)
                    i += k
                    break
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or NEVER."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], NEVER)

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many short words: in each round every word makes its own next merge."""
        width = max(map(len, words))
        ids = np.full((len(words), width + 1), -1, np.int64)
        for n in {len(w) for w in words}:
            rows = [i for i, w in enumerate(words) if len(w) == n]
            ids[rows, :n] = self.byte_id[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(-1, n)]
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(words)
        live = np.arange(len(words))
        while len(live):
            at = rank.argmin(1)
            row = np.arange(len(live))
            best = rank[row, at]
            if (done := best == NEVER).any():
                for i, x in zip(live[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = [t for t in x if t >= 0]
                keep = ~done
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
                if not len(live):
                    break
                row = np.arange(len(live))
            column = np.arange(ids.shape[1])
            shift = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            ids[row, at] = self.merge_id[best]
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], rank.shape[1] - 1), 1)
            rank[:, -1] = NEVER
            rank[row, at] = self.ranks(ids[row, at], ids[row, at + 1])
            has = at > 0
            rank[row[has], at[has] - 1] = self.ranks(ids[row[has], at[has] - 1], ids[row[has], at[has]])
        return out

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of words of any lengths."""
        out: list[list[int]] = [[]] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(next((n for n in TOGETHER if len(w) <= n), 0), []).append(i)
        for n, group in groups.items():
            some = [words[i] for i in group]
            for i, x in zip(group, self.merged_together(some) if n else map(self.merged, some), strict=True):
                out[i] = x
        return out

    def check_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives the pair.

        Undo both tokens' merges from the last to the first. At each step the tokens beside the seam stood there until
        the later of the two merges; had they a merge of their own that came earlier, it would have crossed the seam.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok, limit = np.ones(len(a), bool), np.full(len(a), NEVER)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks(x, y)
            # a merge on the right side of the seam is later in place, so that of equal ranks the left comes first
            crossed = rank < limit[live]
            ok[live[crossed]] = False
            keep = ~crossed & ((self.made[x] >= 0) | (self.made[y] >= 0))
            live, x, y = live[keep], x[keep], y[keep]
            rx, ry = self.made[x], self.made[y]
            left = rx > ry
            # undoing x's last merge: a merge across must come before it; y's: not after it
            limit[live] = np.where(left, rx, ry + 1)
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: proposals, kept where all pairs hold."""
        out = [self.proposed(w) for w in words]
        self.stats["words"] += len(words)
        lengths = np.array([len(x) for x in out], np.int64)
        flat = np.fromiter((t for x in out for t in x), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(out)), lengths)
        bad = np.zeros(len(out), bool)
        bad[owner[~self.sound[flat]]] = True
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        if len(seam):
            key, back = np.unique(flat[seam] * self.size + flat[seam + 1], return_inverse=True)
            holds = self.check_pairs(key // self.size, key % self.size)
            bad[owner[seam[~holds[back]]]] = True
        failed = np.flatnonzero(bad).tolist()
        self.stats["merged"] += len(failed)
        for i, x in zip(failed, self.merged_all([words[i] for i in failed]), strict=True):
            out[i] = x
        return out

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        find = self.words.findall
        cut = [[p] if p[:1] == " " and p[1:].isalpha() else find(p) for p in pieces]
        flat = list(dict.fromkeys(w for x in cut for w in x))
        ids = dict(zip(flat, (packed(x) for x in self.encode_words([w.encode() for w in flat])), strict=True))
        return {p: b"".join([ids[w] for w in x]) for p, x in zip(pieces, cut, strict=True)}

    def _pieces(self, text: str) -> list[str]:
        parts = [text] if self.cut is None or not any(s in text for s in self.special) else self.cut.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._cut(part))]

    def _cut(self, text: str) -> list[str]:
        """Each run of white space with what follows it; at lone blanks where there are no others."""
        if self.doubled.search(text):
            return self.pieces.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + x for x in rest]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._pieces(t) for t in texts]
        table = self.table
        new = list({p for x in cut for p in x if p not in table})
        if new:
            if len(table) + len(new) > self.room:
                table = self.table = {}
                new = list({p for x in cut for p in x})
            for s, i in self.special.items():
                table[s] = np.array([i], "<u4").tobytes()
            new = [p for p in new if p not in self.special]
            table.update(self.encode_new(new))
        return [b"".join([table[p] for p in x]) for x in cut]

    def encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        return self.encode_pieces(pieces)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """The worker's codec of a vocabulary file."""
    return ByteBPE(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode each text of docs (doc_id, text), decode the ids, and return counts and digests of both."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary or default_vocabulary())
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir))

"""Ranked lexical search: hashed max-sketches bound the scores from above, exact rescoring goes down the bounds.

A first pass over the documents counts them, their terms and, for the terms of a batch of queries, the documents that
hold each; every task sends one row a term. With these counts a document's impacts are known. The second pass folds
each document's impacts into a sketch: a term's hash picks one of WIDTH coordinates, which holds the largest impact of
its terms. One product of the sketches of a block with the weights of all queries at their terms' coordinates bounds
every score from above. Per query, documents are rescored exactly by descending bound, and the rest of a block falls
away once a bound is below the score that stands at rank k. These scores stay from block to block of a task, so a task
holds and sends k rows a query at most. Two rounds of ranks, the first over parts of the tasks, merge them.

Queries are taken in batches of BATCH_ITEMS queries and BATCH_TERMS terms, each a pass of its own; a longer query is a
batch alone. Terms are told apart by 64-bit hashes of their bytes.

Defined results: null texts and texts without a term are no documents and no queries; repeated rows of documents each
take a rank; equal rows of queries count once, and texts that share an item_id are ranked each for itself; equal scores
go by doc_id, a null first; an empty table gives an empty result; texts of any length are read whole; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import read, small_batches, text_of
from .shingles import word_hashes

#: Coordinates of a sketch, a power of two.
WIDTH = 512
BATCH_ITEMS, BATCH_TERMS = 2048, 200_000
#: Bytes of text and documents to a block.
BLOCK_BYTES, BLOCK_ROWS = 3 << 20, 4096
#: Documents rescored at first; then twice as many, and so on.
FIRST = 32
#: Parts of the first round of ranks.
PARTS = 64
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SCALE = 10**9


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of all terms of the texts, in order."""
    start, hashed = word_hashes(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), _BETWEEN)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashed, np.searchsorted(ends, start, "right")


def places(vocabulary: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term's place in the sorted vocabulary, which of the hashes) for the hashes that are in it."""
    at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
    found = np.flatnonzero(vocabulary[at] == hashed)
    return at[found], found


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc)
            texts.append(raw := text.encode())
            size += len(raw)
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _count(shared):
    """A row (term's place, documents) for each term of the vocabulary; -1 counts documents, -2 their terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        holding, docs, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for _, texts in blocks(batches):
            hashed, owner = terms_of(texts)
            at, found = places(vocabulary, hashed)
            held = np.unique(owner[found] * len(vocabulary) + at) % len(vocabulary)
            holding += np.bincount(held, minlength=len(vocabulary))
            docs += len(np.unique(owner))
            length += len(hashed)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int32()), pa.array([docs, length, *holding[some].tolist()], pa.int64())], names=["term", "docs"])

    return work


def norms(lengths: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A document's m by its number of terms."""
    return np.array([25 + 75 * n * docs // terms for n in lengths.tolist()], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _SCALE * tf // (1000 * tf + 8 * m)


class Queries:
    """A batch of queries with the counts of the corpus: weights by term, and by coordinate of a sketch."""

    def __init__(self, vocabulary: np.ndarray, texts: list[bytes], counts: dict[int, int], width: int) -> None:
        self.vocabulary, self.docs, self.terms, self.width = vocabulary, counts.get(-1, 0), counts.get(-2, 0), width
        weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        self.shift = np.uint64(64 - width.bit_length() + 1)
        coordinate = (vocabulary >> self.shift).astype(np.int64)
        self.each: list[tuple[np.ndarray, np.ndarray]] = []
        self.at = np.zeros((width, len(texts)))
        for q, text in enumerate(texts):
            term, times = np.unique(places(vocabulary, terms_of([text])[0])[0], return_counts=True)
            self.each.append((term, weight[term] * times))
            np.add.at(self.at[:, q], coordinate[term], (weight[term] * times).astype(float))

    def sketches(self, hashed: np.ndarray, owner: np.ndarray, m: np.ndarray) -> np.ndarray:
        """By document and coordinate the largest impact of its terms there.

        Terms are counted by the upper 52 bits of their hashes: two that agree in them count as one, which can only
        raise the maximum.
        """
        keys, tf = np.unique((owner.astype(np.uint64) << np.uint64(52)) | (hashed >> np.uint64(12)), return_counts=True)
        doc = (keys >> np.uint64(52)).astype(np.int64)
        coordinate = ((keys << np.uint64(12)) >> self.shift).astype(np.int64)
        out = np.zeros((len(m), self.width), np.int64)
        np.maximum.at(out, (doc, coordinate), impact(tf.astype(np.int64), m[doc]))
        return out

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """By document and query an upper bound of the score; a little is added for sums that doubles round."""
        return np.floor(sketches.astype(float) @ self.at * (1 + 1e-12)) + 1


class Best:
    """Of one query the k best (score, doc_id) so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score that a document needs at least."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(int(s), i) for s, i in zip(scores, ids, strict=True) if s >= self.least()]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is not None, r[1]))[: self.k]


def search_block(queries: Queries, best: list[Best], ids: list, texts: list[bytes]) -> int:
    """Bring the k best up to date with a block of documents; the number of exact scores that it took."""
    hashed, owner = terms_of(texts)
    m = norms(np.bincount(owner, minlength=len(ids)), queries.docs, queries.terms)
    size = len(queries.vocabulary)
    at, found = places(queries.vocabulary, hashed)
    held, tf = np.unique(owner[found] * size + at, return_counts=True)
    if not len(held):
        return 0
    exact = impact(tf.astype(np.int64), m[held // size])
    bounds = queries.bounds(queries.sketches(hashed, owner, m))
    rescored = 0
    for q, (term, weight) in enumerate(queries.each):
        bound = bounds[:, q]
        order = np.flatnonzero(bound >= best[q].least())
        order = order[np.argsort(-bound[order], kind="stable")]
        done, step = 0, FIRST
        while done < len(order) and bound[order[done]] >= best[q].least():
            docs = order[done : done + step]
            keys = docs[:, None] * size + term[None, :]
            place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            scores = (np.where(held[place] == keys, exact[place], 0) * weight).sum(1)
            best[q].add(scores, [ids[i] for i in docs])
            rescored += len(docs)
            done, step = done + step, 2 * step
    return rescored


FOUND = "query int, part int, doc_id long, score long"


def _search(shared, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, part = shared.value, TaskContext.get().partitionId() % PARTS
        best = [Best(k) for _ in queries.each]
        for ids, texts in blocks(batches):
            search_block(queries, best, ids, texts)
        rows = [(q, part, doc, score) for q, b in enumerate(best) for score, doc in b.rows]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query", "part", "doc_id", "score"])

    return work


def query_batches(items: DataFrame) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """(item_id, text, sorted hashes of all terms) of batches of queries, as many at a time as the bounds allow."""
    ids, texts, terms = [], [], np.empty(0, np.uint64)
    for item, text in items.toLocalIterator():
        own = np.unique(terms_of([text.encode()])[0])
        if not len(own):
            continue
        if ids and (len(ids) >= BATCH_ITEMS or len(terms) + len(own) > BATCH_TERMS):
            yield ids, texts, terms
            ids, texts, terms = [], [], np.empty(0, np.uint64)
        ids.append(item)
        texts.append(text.encode())
        terms = np.union1d(terms, own)
    if ids:
        yield ids, texts, terms


def search(docs: DataFrame, items: DataFrame, k: int = 10, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents (doc_id, text) with the highest scores above 0 for each query
    of items (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    asked = items.select("item_id", text_of(items).alias("text")).distinct()
    kind = StructType([StructField("query", IntegerType()), StructField("item_id", items.schema["item_id"].dataType)])
    out = spark.createDataFrame([], kind).selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
    for ids, said, vocabulary in query_batches(asked):
        counts = texts.mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
        queries = Queries(vocabulary, said, dict(map(tuple, counts.collect())), width)
        if not queries.docs:
            continue
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(queries), k), FOUND)
        best = [F.desc("score"), F.asc_nulls_first("doc_id")]
        for by in (["query", "part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), kind)
        out = out.unionByName(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


ORACLE_SQL = r"""
WITH said AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), items AS (
    SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM said GROUP BY ALL
), lengths AS (
    SELECT doc_id, count(*) AS n FROM said GROUP BY ALL
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
    FROM items JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))

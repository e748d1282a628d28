"""Ranked lexical search against a plain loop over all documents."""

import math
import random
import re

import duckdb
import numpy as np
import pytest

from ledgerloom.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, item_id string, score double, query int, rank string, part int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scores = []
        for i, t in held:
            m = 100 - 75 + (75 * len(t) * n_docs) // length
            score = 0
            for x in terms(text):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = ["Alpha", "beta", "Gamma", "straße", "Ünder", "x9", "don't", "a-b", "日本", "ÀB"] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) if rng.random() < 0.4 else rng.choice(words[:25]) for _ in range(n))
    out = [None, "", " .,;\n", "alpha", "ALPHA alpha", say(9000), "beta " * 500, "-- beta --", "beta"]
    return out + ["beta gamma x9"] * 30 + [say(rng.randrange(1, 120)) for _ in range(160)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 50 else None, t, "x", 0.5, 1, "r", 2) for i, t in enumerate(texts)] + [(7, "-- beta --", "x", 0.5, 1, "r", 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


ITEMS = [(1, "Beta gamma x9 beta"), (1, "Beta gamma x9 beta"), (2, None), (3, ""), (4, "nowhere else"), (5, "w1 w2 w3 w4 straße Ünder 日本"), (6, "?!"), (None, "alpha"), (7, "w5 " * 40 + "w6"), (7, "àb ÀB ünder")]


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_equals_a_plain_loop(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, query int, rank int")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert rows_of(ranking.search(docs, items)) == want
    assert len([r for r in want if r[0] == 1]) == 10 and not [r for r in want if r[0] in (2, 3, 6)]
    assert rows_of(ranking.search(docs, items, k=3, width=8)) == [r for r in want if r[1] <= 3]
    monkeypatch.setattr(ranking, "BATCH_ITEMS", 2)
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 7)
    assert rows_of(ranking.search(docs, items)) == want


def test_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("text = ''"), items)):
        out = ranking.search(d, q)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_bounds_hold_and_prune(texts):
    raw = [(t or "").encode() for t in texts]
    hashed, owner = ranking.terms_of(raw)
    said = [t.encode() for _, t in ITEMS if t and terms(t)]
    vocabulary = np.unique(ranking.terms_of(said)[0])
    at, found = ranking.places(vocabulary, hashed)
    df = np.bincount(np.unique(owner[found] * len(vocabulary) + at) % len(vocabulary), minlength=len(vocabulary))
    counts = dict(enumerate(df.tolist())) | {-1: len(np.unique(owner)), -2: len(hashed)}
    for width in (4, 64, 4096):
        queries = ranking.Queries(vocabulary, said, counts, width)
        bounds = queries.bounds(queries.sketches(hashed, owner, ranking.norms(np.bincount(owner, minlength=len(raw)), queries.docs, queries.terms)))
        best = [ranking.Best(len(raw)) for _ in said]
        ranking.search_block(queries, best, list(range(len(raw))), raw)
        for q, b in enumerate(best):
            assert all(score <= bounds[doc, q] for score, doc in b.rows)
    best = [ranking.Best(10) for _ in said]
    took = sum(ranking.search_block(queries, best, list(range(i, i + 40)), raw[i : i + 40]) for i in range(0, 160, 40))
    assert took < 0.6 * 160 * len(said)


def test_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert rows_of(ranking.query(spark, data)) == sorted(con.sql(ranking.ORACLE_SQL).fetchall(), key=repr)

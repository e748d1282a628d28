"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learnt from labelled rows: stems and whole words that stand in toxic texts and hardly elsewhere. A trie
holds them; the automaton of "within k edits of some entry" is the product of the trie with the counters of a
Levenshtein automaton. Its states are made as words need them, so that a word costs a step per letter until it can match
nothing. Stems match beginnings; whole words match misspellings, where two letters that changed places are one edit. What
comes that close but is a usual word of clean texts isn't a hit. Tokens are matched whole, digits and signs included,
and by their runs of letters.

A hit's window says whether it is quoted or reported, or addressed to somebody. Counts of hits by exactness and context
are the features of a logistic regression; words, language, source and identifiers are not.

Both are fitted on at most about ``SAMPLE`` labelled rows, taken by a hash of doc_id. Scoring covers all rows.

Defined results: a null or empty text has no hits and the score of clean texts; texts of any length count whole; rows
without a label are scored alike; an id with several labels is toxic if one of them is;
without labelled rows of both kinds the lexicon is empty and the score is one half or the labels' mean; repeated rows
get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, text_of

#: Labelled rows that are fitted on, about. The lexicon holds what they show, without another bound.
SAMPLE = 8000
THRESHOLD = 0.3
#: Stem lengths; toxic texts that an entry must stand in, copies counted once (what only copies of a few texts hold says
#: nothing); the share of toxic ones among its texts.
STEMS, LEAST, PRECISION = (4, 5, 6, 7, 8), 5, 0.9
#: Letters of a whole word at least, and clean texts that make a word usual.
LETTERS, USUAL = 3, 2
WINDOW = 6

WORD = re.compile(r"[^\W\d_]+")
#: Words that report what somebody said, and words that address somebody.
REPORTS = frozenset("said says say wrote writes called calling quote quoted quotes reported according term word slur sagte schrieb zitat genannt dit disait écrit citation appelé dijo escribió cita llamado".split())
ADDRESS = frozenset("you your youre u ya du dich dein deine ihr euch tu te ton ta vous votre toi tú tu vosotros usted ustedes".split())
QUOTES = "\"“”„«»‹›"
EDGES = ".,;:?!()[]{}<>'‘’…" + QUOTES


def edits_for(stem: str) -> int:
    """Edits that a stem's length bears."""
    return 0 if len(stem) < 5 else 1


def edits_of(word: str) -> int:
    """Edits that a whole word's length bears."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


def forms(token: str) -> set[str]:
    """A token without the marks around it, and its runs of letters."""
    return {token} if token.isalpha() else {x for x in (token.strip(EDGES), *WORD.findall(token)) if x}


class Trie:
    """Lexicon trie with the deterministic product automaton, made as it is needed.

    A state is a set of (node, edits) with the fewest edits of each node. A word matches when a state holds the end of
    a stem within its edits; stems are beginnings, so what follows doesn't matter. With ``whole`` they are words that
    must be met to the end, and neighbours that changed places are one edit: a node between waits for the first of them.
    """

    def __init__(self, stems: list[str], whole: bool = False) -> None:
        self.whole = whole
        self.children: list[dict[str, int]] = [{}]
        self.budget: list[int] = [0]  # most edits of a stem below the node
        self.ends: list[int] = [-1]  # edits of a stem that ends here
        for stem in stems:
            k, node = (edits_of if whole else edits_for)(stem), 0
            self.budget[0] = max(self.budget[0], k)
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                    self.ends.append(-1)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], k)
            self.ends[node] = max(self.ends[node], k)
        self.swaps: dict[tuple[int, str], list[int]] = {}  # nodes between, by where from and the letter that came early
        self.waits: dict[int, tuple[str, int]] = {}  # of a node between: the letter still due, and where it leads
        for node, below in enumerate(self.children[:] if whole else []):
            for first, child in below.items():
                for second, to in self.children[child].items():
                    if first != second:
                        self.swaps.setdefault((node, second), []).append(len(self.children))
                        self.waits[len(self.children)] = first, to
                        self.children.append({})
                        self.budget.append(self.budget[to])
                        self.ends.append(-1)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.best: list[int] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, reached: dict[int, int]) -> frozenset:
        """With letters of stems left out, and without what no stem's edits allow."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            e = reached[node] + 1
            for child in self.children[node].values():
                if e <= self.budget[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        return frozenset((n, e) for n, e in reached.items() if e <= self.budget[n])

    def _state(self, key: frozenset) -> int:
        if key not in self.states:
            if len(self.states) > 200_000:  # bound the memory: start afresh
                self.states.clear()
                self.sets, self.steps, self.best = [], [], []
                self.start = self._state(self._closed({0: 0}))
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.best.append(min((e for n, e in key if 0 <= e <= self.ends[n]), default=99))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.budget[node] and e < reached.get(node, 99):
                reached[node] = e

        for node, e in self.sets[state]:
            if node in self.waits:
                letter, to = self.waits[node]
                if letter == c:
                    put(to, e)
                continue
            put(node, e + 1)  # a letter too many
            for between in self.swaps.get((node, c), ()):
                put(between, e + 1)
            for letter, child in self.children[node].items():
                put(child, e if letter == c else e + 1)
        if not reached:
            return -1
        key = self._closed(reached)
        return self._state(key) if key else -1

    def match(self, word: str) -> int:
        """Fewest edits between a beginning of word (with ``whole``: all of it) and a stem, or -1."""
        state, best = self.start, 99
        for c in word:
            steps = self.steps[state]
            to = steps.get(c)
            if to is None:
                was = self.sets[state]
                to = self._step(state, c)
                if state < len(self.sets) and self.sets[state] is was:
                    self.steps[state][c] = to
            if to < 0:
                if self.whole:
                    return -1
                break
            state = to
            if self.whole:
                continue
            best = min(best, self.best[state])
            if not best:
                break
        if self.whole:
            best = self.best[state]
        return best if best < 99 else -1


NAMES = ["bias", "any", "exact", "near", "density", "quoted", "addressed", "shouted", "spread"]


@dataclass
class Model:
    stems: list[str]
    weights: list[float]
    words: list[str] = field(default_factory=list)
    usual: list[str] = field(default_factory=list)


class Scorer:
    """Features of texts for one lexicon. Matches of words are kept in a bounded table."""

    def __init__(self, stems: list[str], words: list[str] = (), usual: list[str] = ()) -> None:
        self.tries = Trie(stems), Trie(words, whole=True)
        self.usual = frozenset(usual)
        self.known: dict[str, int] = {}

    def matches(self, words: set[str]) -> dict[str, int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in words.difference(known):
            known[w] = min((e for x in forms(w) if (e := self.edits(x)) >= 0), default=-1)
        return {w: e for w in words if (e := known[w]) >= 0}

    def edits(self, form: str) -> int:
        e = min((e for t in self.tries if (e := t.match(form)) >= 0), default=-1)
        return -1 if e > 0 and form in self.usual else e

    def features(self, text: str) -> list[float]:
        lowered = text.lower()
        tokens = lowered.split()
        hits = self.matches(set(tokens))
        if not hits:
            return [1.0] + [0.0] * (len(NAMES) - 1)
        exact = near = quoted = addressed = 0
        kinds, shouted = set(), 0
        open_quote = False
        raw = text.split()
        for i, w in enumerate(tokens):
            marks = sum(map(w.count, QUOTES)) if not w.isalpha() else 0
            if w in hits:
                around = [x.strip(".,;:!?") for x in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
                quoted += open_quote or marks > 0 or any(x in REPORTS for x in around)
                addressed += any(x in ADDRESS for x in around)
                shouted += i < len(raw) and len(raw[i]) > 2 and raw[i].isupper()
                exact += hits[w] == 0
                near += hits[w] > 0
                kinds.add(w)
            if marks % 2:
                open_quote = not open_quote
        n = exact + near
        return [1.0, 1.0, math.log1p(exact), math.log1p(near), math.log1p(1000 * n / len(tokens)), quoted / n, addressed / n, shouted / n, math.log1p(len(kinds))]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def entries(token: str) -> set[str]:
    """What a token may add to the lexicon: stems of its runs of letters, and its forms, marked with a blank, as words."""
    if len(token) < LETTERS:
        return set()
    runs = WORD.findall(token)
    return {w[:k] for w in runs for k in STEMS if len(w) >= k} | {f"{w} " for w in forms(token) if len(w) >= LETTERS and not w.isdigit()}


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic texts and all texts of each entry, of a part of the sample."""
    bad: Counter = Counter()
    n: Counter = Counter()
    for batch in batches:
        for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = set().union(*map(entries, set(text.lower().split())))
            n.update(keys)
            if toxic:
                bad.update(keys)
    keys = list(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())],
        names=["entry", "bad", "n"],
    )


def _places(wanted: frozenset[str]):
    """Each text's entries that are wanted, each with one pair of words that it stands between: the same one in copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text in batch.column(0).to_pylist():
                tokens = ["", *text.lower().split(), ""]
                hits = {t: found for t in set(tokens) if (found := entries(t) & wanted)}
                least: dict[str, int] = {}
                for i, t in enumerate(tokens):
                    if t in hits:
                        h = zlib.crc32(f"{tokens[i - 1]} {tokens[i + 1]}".encode())
                        least.update((k, h) for k in hits[t] if h < least.get(k, 1 << 32))
                seen.update(least.items())
            keys, beside = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string()), pa.array(list(beside), pa.int64())], names=["entry", "beside"])

    return work


def _near_words(stems: list[str], words: list[str]):
    """Of the words given, those that the automata reach by edits only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(stems, words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if scorer.edits(w) > 0], pa.string())], names=["word"])

    return work


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon and weights from labelled rows that are not held out."""
    rows = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    total = rows.count()
    part = min(1.0, SAMPLE / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text")  # about SAMPLE rows
    counts = sample.mapInArrow(_entry_counts, "entry string, bad long, n long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    precise = counts.filter((F.col("bad") >= LEAST) & (F.col("bad") >= PRECISION * F.col("n")))
    found = precise.collect()  # of SAMPLE texts
    places = sample.filter("toxic = 1").select("text").mapInArrow(_places(frozenset(r["entry"] for r in found)), "entry string, beside long")
    apart = {r["entry"] for r in places.groupBy("entry").agg(F.countDistinct("beside").alias("n")).filter(F.col("n") >= LEAST).collect()}
    kept = [r["entry"] for r in found if r["entry"] in apart]
    words = sorted(x[:-1] for x in kept if x.endswith(" "))
    chosen: list[str] = []
    for stem in sorted((k for k in kept if not k.endswith(" ")), key=lambda s: (len(s), s)):
        if not any(stem.startswith(s) for s in chosen):
            chosen.append(stem)
    clean = counts.filter(F.col("entry").endswith(" ") & (F.col("n") - F.col("bad") >= USUAL) & (F.col("bad") < PRECISION * F.col("n")))
    near = clean.select(F.expr("substring(entry, 1, length(entry) - 1)").alias("word")).mapInArrow(_near_words(chosen, words), "word string")
    usual = sorted(r["word"] for r in near.collect())  # of SAMPLE texts
    fitted = sample.mapInArrow(_features(chosen, words, usual), "toxic int, x array<double>").collect()  # bounded by SAMPLE
    x = np.array([r["x"] for r in fitted], float).reshape(-1, len(NAMES))
    y = np.array([r["toxic"] for r in fitted], float)
    return Model(chosen, logistic(x, y).tolist(), words, usual)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(len(NAMES))
    if not len(y):
        return w
    penalty = np.full(len(NAMES), ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _features(*lexicon: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*lexicon)
        for batch in batches:
            x = [scorer.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    return work


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_hits int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of each row of docs (doc_id, text)."""
    lexicon, weights = (model.stems, model.words, model.usual), np.array(model.weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*lexicon)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(2).to_pylist()], float).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            hits = np.rint(np.expm1(x[:, 2]) + np.expm1(x[:, 3])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(hits)],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"],
            )

    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), text_of(docs).alias("text")).mapInArrow(work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir)
    return score(docs, learn(docs, read(spark, sf_dir, "labels")))

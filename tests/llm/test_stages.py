"""Stages keep any columns; the join's hubs; ids that are null on many rows."""

import random

import pytest

import corpus_pipeline
from ledgerloom.llm import jaccard, quality, secrets, suffixes

rng = random.Random(12)
say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
SHARED = say(30)
TEXTS = [None, "", "one", say(40), say(5000), say(30) + "\n" + SHARED, SHARED + "\n" + say(25), 'token = "abcdefgh12345678" ' + say(30)] + [say(50)] * 3


def table(spark, rows):
    names = "doc_id long, text string, lang string, source string, n_chars string, __kept int, __doc string, __spans int, __row int, key string, node long, __KEPT_ int"
    return spark.createDataFrame([(i, t, "en", "s", "many", 1, "d", 2, 3, "k", 4, 5) for i, t in rows], names).repartition(3)


@pytest.mark.parametrize("stage", [quality.quality_filter, jaccard.drop_near_duplicates, suffixes.drop_repeats, secrets.redact_secrets])
def test_columns_of_any_name(spark, stage):
    rows = list(enumerate(TEXTS)) + [(None, None), (None, "x y"), (3, TEXTS[3])]
    docs = table(spark, rows)
    out = stage(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = out.collect()
    assert {r["n_chars"] for r in got} <= {"many"} and {r["__spans"] for r in got} <= {2} and 0 < len(got) <= len(rows)
    assert stage(docs.limit(0)).collect() == []
    if stage is jaccard.drop_near_duplicates:
        assert sorted(r["doc_id"] for r in got if r["text"] == TEXTS[-1]) == [8]
    if stage is suffixes.drop_repeats:
        left = {r["doc_id"]: r["text"] for r in got}
        assert SHARED in left[5] and SHARED not in left[6] and left[0] is None and left[4] == TEXTS[4]
    if stage is secrets.redact_secrets:
        assert not any("abcdefgh12345678" in (r["text"] or "") for r in got)


def test_copies_meet_through_their_text(spark):
    """Copies with a changed word each are near the text, not each other; the text isn't the least id."""
    words = say(60).split()
    copies = {}
    for i in range(40):
        own = list(words)
        own[rng.randrange(60)] = f"w{i}"
        copies[i] = " ".join(own)
    copies[100] = " ".join(words)
    docs = spark.createDataFrame([*copies.items(), (200, say(60))], "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs, 5, 80).collect()}
    assert set(got) == {*copies, 200} and got[200] == 200 and {got[i] for i in copies} == {0}


def test_null_ids_on_many_rows(spark):
    rows = [(None, say(30) if i % 2 else "the same words on many rows " * 3) for i in range(300)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect()
    assert len(got) == 300 and {r["doc_id"] for r in got} == {None}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "suffix_array_dedup", "secret_scans", "packing"]

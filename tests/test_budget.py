"""The budget guard against a plain loop, over streams that come shuffled, late, in gaps and more than once."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import budget
from ledgerloom.streaming.jobs import finished

ENTRIES = "ledger string, place long, kind string, call string, usd double"


def plain(entries, cap, warn):
    """Verdicts by sums over all that came before, made anew for each entry."""
    out, accepted, done, spent, warned = {}, {}, set(), [], False
    for ledger, place, kind, call, usd in entries:
        usd, warns = usd or 0.0, False
        still = {c: u for c, u in accepted.items() if c not in done}
        if kind == "reserve":
            fits = call not in still and sum(spent) + sum(still.values()) + usd <= cap
            verdict = "accepted" if fits else "refused"
            if fits:
                accepted[call] = usd
                done.discard(call)
        elif kind in ("settle", "release") and call in still:
            done.add(call)
            verdict = "settled" if kind == "settle" else "released"
            if kind == "settle":
                spent.append(usd)
                warns, warned = not warned and sum(spent) >= warn, warned or sum(spent) >= warn
        else:
            verdict = "unknown"
        still = {c: u for c, u in accepted.items() if c not in done}
        out[(ledger, place)] = (verdict, sum(spent), sum(still.values()), warns)
    return out


def log_of(rng, ledger, n):
    """Entries with amounts in eighths, so that sums are exact in any order."""
    return [(ledger, i, rng.choice(["reserve"] * 5 + ["settle"] * 3 + ["release", "other"]), f"c{rng.randrange(12)}", rng.choice([None, *(k / 8 for k in range(1, 9))])) for i in range(n)]


def streamed(spark, tmp_path, batches, cap, warn):
    """Decisions on batches, each a file of its own."""
    path = str(tmp_path / "log")
    for batch in batches:
        spark.createDataFrame(batch, ENTRIES).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(path)
    rows = finished(budget.guarded(stream.withColumn("note", F.lit("x")), cap, warn), ["ledger", "place"]).collect()
    assert len({(r.ledger, r.place) for r in rows}) == len(rows)
    return {(r.ledger, r.place): (r.verdict, r.spent_usd, r.reserved_usd, r.warns) for r in rows}


def test_equals_a_plain_loop_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    logs = {name: log_of(rng, name, n) for name, n in (("a", 160), ("b", 40), ("", 1))}
    entries = [e for log in logs.values() for e in log]
    rng.shuffle(entries)
    entries += rng.sample(entries, 30)  # delivered again
    want = {k: v for log in logs.values() for k, v in plain(log, 9.0, 4.0).items()}
    third = len(entries) // 3
    got = streamed(spark, tmp_path, [entries[:third], entries[third : 2 * third], entries[2 * third :]], 9.0, 4.0)
    assert got == want
    assert {v[0] for v in want.values()} == {"accepted", "refused", "settled", "released", "unknown"}
    assert [ledger for (ledger, _), v in sorted(got.items()) if v[3]] == ["a"]  # once, and not where the level isn't reached


def test_gaps_wait_and_rows_without_a_place_go(spark, tmp_path):
    rows = [("a", 0, "reserve", "x", 1.0), ("a", 2, "settle", "x", 1.0), (None, 0, "reserve", "x", 1.0), ("a", None, "reserve", "y", 1.0), ("b", 0, None, "x", 1.0), ("a", -1, "reserve", "z", 1.0), ("a", 0, "reserve", "x", 1.0)]
    assert streamed(spark, tmp_path, [rows], 5.0, None) == {("a", 0): ("accepted", 0.0, 1.0, False)}


@pytest.mark.parametrize(("usd", "verdict"), [(2.0, "accepted"), (2.125, "refused")])
def test_what_is_reserved_counts_until_it_is_settled(usd, verdict):
    b = budget.Budget(5.0, None)
    assert [b.decide("reserve", c, u)[0] for c, u in (("x", 2.0), ("y", 1.5), ("z", 1.75))] == ["accepted", "accepted", "refused"]
    assert b.decide("settle", "x", 1.5)[0] == "settled" and b.decide("settle", "x", 1.5)[0] == "unknown"
    assert b.decide("reserve", "w", usd)[0] == verdict


def test_an_empty_log(spark, tmp_path):
    assert streamed(spark, tmp_path, [[]], 5.0, 1.0) == {}


def test_recorded_spend(spark):
    rows = budget.budget_guard(spark, "/root/testdata/sf0.001").collect()
    kinds = {r.verdict for r in rows}
    moves = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() * 2
    assert len(rows) == moves and {"accepted", "refused", "settled", "released"} <= kinds
    assert all(r.spent_usd + r.reserved_usd <= 14.5 * 1.2 for r in rows)


def test_rows_that_wait_are_no_state(spark, tmp_path):
    """The same decisions by tables, for any order, repeats and gaps; a pass holds no entries that wait."""
    rng = random.Random(5)
    logs = {name: log_of(rng, name, n) for name, n in (("a", 160), ("b", 40), ("", 1))}
    gap = [("c", 0, "reserve", "x", 1.0), ("c", 2, "settle", "x", 1.0), (None, 0, "reserve", "x", 1.0), ("d", 3, "reserve", "x", 1.0)]
    entries = [e for log in logs.values() for e in log]
    rng.shuffle(entries)
    entries += rng.sample(entries, 30) + gap
    want = {k: v for log in logs.values() for k, v in plain(log, 9.0, 4.0).items()} | {("c", 0): ("accepted", 0.0, 1.0, False)}
    path, third = str(tmp_path / "log"), len(entries) // 3
    for batch in (entries[:third], entries[third : 2 * third], [], entries[2 * third :]):
        spark.createDataFrame(batch, ENTRIES).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(path)
    rows = budget.guarded_rows(stream, 9.0, 4.0).collect()
    assert len({(r.ledger, r.place) for r in rows}) == len(rows)
    assert {(r.ledger, r.place): (r.verdict, r.spent_usd, r.reserved_usd, r.warns) for r in rows} == want


def test_a_pass_over_a_log_in_reverse_batches_is_a_stream():
    """Far more entries that wait than fit a frame pass through without being held."""
    import tracemalloc

    import pandas as pd

    def frames(n=200):
        for i in range(n):
            yield pd.DataFrame({"ledger": "a", "place": range(1 + i * 1000, 1001 + i * 1000), "kind": "reserve", "call": "c", "usd": 1.0})

    tracemalloc.start()
    rows = sum(len(f) for f in budget._passed(5.0, None)(frames()))
    assert rows == 200_001 and tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()

"""Date phrases by hand, on both engines."""

import duckdb
import pytest

from ledgerloom import sql
from ledgerloom.functions import dates

REF = "2024-01-30"  # a Tuesday
CASES = [
    # a reference date, a text, the days it means
    (REF, "next tuesday, this tuesday, tomorrow, in two weeks, on the 31st", ["2024-01-30", "2024-01-31", "2024-02-06", "2024-02-13"]),
    (REF, "14 October, October 3, 2025, 2024-02-29, 5/6/2024", ["2024-02-29", "2024-06-05", "2024-10-14", "2025-10-03"]),
    (REF, "2024-02-30 and 31/02/2024 and 30 Feb 2024", ["2024-02-30"]),  # an ISO date stands for itself
    (REF, "in a week, 3 Sept? no: 3rd Sep. 2025, Oct 4th, in 0 days", ["2024-02-06", "2024-10-04", "2025-09-03"]),
    (REF, "NEXT Friday; This\tMonday; TOMORROW", ["2024-01-31", "2024-02-02", "2024-02-05"]),
    (REF, "in 10 days in 010 days In Ten Days in ten week", ["2024-02-09", "2024-04-09"]),
    (REF, "in 2914000 days in 99999999999999999999 days in 5000000 weeks", []),
    (REF, "on the 30th", []),  # not after the reference, and February has none
    (REF, "on the 29th, on the  5th, on the 6, upon the 7th", ["2024-02-29"]),
    ("2024-12-20", "on the 5th", ["2025-01-05"]),
    ("2024-12-20", "on the 21st", ["2024-12-21"]),
    ("2024-12-20", "on the 00th or 0 May or 32 May or 12/13/2024", []),
    (REF, "2nd,March 2nd.March 2 March,2026 may 4,2027 4 may.,  2028", ["2024-03-02", "2026-03-02", "2027-05-04", "2028-05-04"]),
    (REF, "14 Oct2024 October 142026 October 32027 May 3rd2028", ["2024-10-14", "2026-10-14", "2027-10-03", "2028-05-03"]),
    (REF, "October 2024, 2024 October, 142024 days, May 4 20245", ["2024-05-04"]),
    (REF, "nexttuesday next tuesdays thistuesday tomorrows 14 Octopus x14 May, 14 Mayx _5/6/2024 5/6/2024_", []),
    (REF, "in 2912000 days", ["9996-11-12"]),
    (REF, "1-2024-02-03-4 2024-02-03T10:00 2024-2-3 2024/02/03", ["2024-02-03"]),
    (REF, "5/6/2024/7, 05/06/2025", ["2024-06-05", "2025-06-05"]),
    (REF, "3 May 4 May 5 May", ["2024-05-03", "2024-05-04", "2024-05-05"]),
    (REF, "in in two days in three weeks", ["2024-02-01", "2024-02-20"]),
    (REF, "01/01/0000 1 May 0000 1 May 0999", ["0999-05-01"]),
    ("9999-12-31", "tomorrow, in one week, this friday", ["9999-12-31"]),
    ("2024-01-30T10:00:00Z", "tomorrow", ["2024-01-31"]),
    ("2024-13-30", "2024-02-03", []),
    ("soon", "2024-02-03", []),
    (None, "2024-02-03", []),
    (REF, None, []),
    (REF, "", []),
    (REF, "été 14 mai; 五 May 5", ["2024-05-05"]),
]


@pytest.fixture(scope="module")
def statement():
    sql.relation("given_notes", "SELECT id, ref, text FROM given")
    yield f"{dates.date_phrases('given_notes', ['id'])}"
    del sql.RELATIONS["given_notes"]


def shown(rows):
    found = {}
    for i, day in rows:
        found.setdefault(i, []).append(day)
    return [sorted(found.get(i, [])) for i in range(len(CASES))]


def test_phrases_on_spark(spark, statement):
    given = spark.createDataFrame([(i, ref, text) for i, (ref, text, _) in enumerate(CASES)], "id long, ref string, text string")
    got = sql.run(spark, "", statement, {"given_notes": given})
    assert shown(got.collect()) == [want for *_, want in CASES]


def test_phrases_on_duckdb(statement):
    con = duckdb.connect()
    con.execute("CREATE TABLE given (id BIGINT, ref VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?)", [(i, ref, text) for i, (ref, text, _) in enumerate(CASES)])
    assert shown(con.sql(sql.duck(statement)).fetchall()) == [want for *_, want in CASES]


def test_windows_are_not_shuffled(spark, statement):
    """Words are looked up by broadcast joins; what is shuffled is made distinct before."""
    given = spark.createDataFrame([(1, REF, "tomorrow")], "id long, ref string, text string")
    plan = sql.run(spark, "", statement, {"given_notes": given})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan.replace("Scan ExistingRDD", "")

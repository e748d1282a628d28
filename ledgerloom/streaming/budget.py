"""Exact budget guard over logs of reservations: a call is refused if what is spent and reserved leaves no room for it.

Whether a call is refused depends on all that came before it in its ledger, so a ledger is a key with state: the place of the
next entry, sums, open reservations, and entries that came ahead of their place. Entries carry their place in the ledger,
without gaps from 0 on, so they may come in any order, late by any time, and more than once: each is decided once, when all
before it are. Entries that came ahead are held in state by ``guarded``, which suits streams that are nearly in order, and in a table by
``guarded_rows``, which bears any order: a batch is sorted with what waits, on disk where memory ends. Ledgers are
independent of one another and run side by side; within one the order is the meaning, and no task could decide ahead of it.

Defined results: an entry without a ledger, a place or a kind has no meaning and is left out; a null amount is 0; a settlement
or release of a call without an open reservation changes nothing and is ``unknown``; so is an entry of another kind; a call
that reserves again while it is open is refused; an entry behind a gap isn't decided until the gap is filled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import sql
from ..sources import views  # noqa: F401  the recorded spend
from ..storage import exists, listed, remove, shared_dir

#: verdict: accepted, refused, settled, released or unknown; spent and reserved: the sums after it; warns: once, where spent
#: reaches the level of warning.
DECIDED = "ledger string, place long, call string, verdict string, spent_usd double, reserved_usd double, warns boolean"
_STATE = "following long, spent double, reserved double, warned boolean, opened string, ahead string"


class Budget:
    """A ledger's sums and open reservations."""

    def __init__(self, cap_usd: float, warn_usd: float | None, spent: float = 0.0, reserved: float = 0.0, warned: bool = False, opened: dict[str, float] | None = None) -> None:
        self.cap_usd, self.warn_usd = cap_usd, warn_usd
        self.spent, self.reserved, self.warned = spent, reserved, warned
        self.opened = {} if opened is None else opened

    def decide(self, kind: str, call: str, usd: float) -> tuple[str, bool]:
        """The verdict on the next entry, and whether it is the one that reaches the level of warning."""
        if kind == "reserve":
            if call in self.opened or self.spent + self.reserved + usd > self.cap_usd:
                return "refused", False
            self.opened[call] = usd
            self.reserved += usd
            return "accepted", False
        if kind not in ("settle", "release") or call not in self.opened:
            return "unknown", False
        self.reserved -= self.opened.pop(call)
        if kind == "release":
            return "released", False
        self.spent += usd
        warns = self.warn_usd is not None and not self.warned and self.spent >= self.warn_usd
        self.warned |= warns
        return "settled", warns


def guarded(entries: DataFrame, cap_usd: float, warn_usd: float | None = None) -> DataFrame:
    """Decisions on a stream of entries (ledger, place, kind, call, usd), in update mode; other columns are ignored."""

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, budget, ahead = 0, Budget(cap_usd, warn_usd), {}
        if state.exists:
            following, spent, reserved, warned, opened, waiting = state.get
            budget = Budget(cap_usd, warn_usd, spent, reserved, warned, json.loads(opened))
            ahead = {p: (k, c, u) for p, k, c, u in json.loads(waiting)}
        for frame in frames:
            for place, kind, call, usd in zip(*(frame[c].tolist() for c in ("place", "kind", "call", "usd")), strict=True):
                if place >= following:
                    ahead[place] = (kind, call, usd)
            out = []
            while following in ahead:
                kind, call, usd = ahead.pop(following)
                verdict, warns = budget.decide(kind, call, usd)
                out.append((key[0], following, call, verdict, budget.spent, budget.reserved, warns))
                following += 1
            if out:
                yield pd.DataFrame(out, columns=["ledger", "place", "call", "verdict", "spent_usd", "reserved_usd", "warns"])
        waiting = [[p, *ahead[p]] for p in sorted(ahead)]
        state.update((following, budget.spent, budget.reserved, budget.warned, json.dumps(budget.opened), json.dumps(waiting)))

    return _placed(entries).groupBy("ledger").applyInPandasWithState(work, DECIDED, _STATE, "update", GroupStateTimeout.NoTimeout)


def _placed(entries: DataFrame) -> DataFrame:
    return entries.filter("ledger IS NOT NULL AND place >= 0 AND kind IS NOT NULL").select(
        F.col("ledger").cast("string").alias("ledger"), F.col("place").cast("long").alias("place"), F.col("kind").cast("string").alias("kind"),
        F.coalesce(F.col("call").cast("string"), F.lit("")).alias("call"), F.coalesce(F.col("usd").cast("double"), F.lit(0.0)).alias("usd"),
    )


#: Entries with their decision, entries that wait (no verdict), and a ledger's sums and open reservations, as JSON in call, at place -1.
_PASSED = "ledger string, place long, kind string, call string, usd double, verdict string, spent_usd double, reserved_usd double, warns boolean"


def _passed(cap_usd: float, warn_usd: float | None):
    """A pass over rows in order of ledger and place, frame by frame: it holds one frame, sums and open reservations."""
    names = [c.split()[0] for c in _PASSED.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, following, budget, last = None, 0, Budget(cap_usd, warn_usd), -1

        def head() -> tuple:
            held = json.dumps([following, budget.spent, budget.reserved, budget.warned, budget.opened])
            return (ledger, -1, "", held, 0.0, None, None, None, None)

        for frame in frames:
            out = []
            for own, place, kind, call, usd in zip(*(frame[c].tolist() for c in names[:5]), strict=True):
                if own != ledger:
                    if ledger is not None:
                        out.append(head())
                    ledger, following, budget, last = own, 0, Budget(cap_usd, warn_usd), -1
                if place < 0:
                    following, spent, reserved, warned, opened = json.loads(call)
                    budget = Budget(cap_usd, warn_usd, spent, reserved, warned, opened)
                elif place == following:
                    verdict, warns = budget.decide(kind, call, usd)
                    out.append((own, place, kind, call, usd, verdict, budget.spent, budget.reserved, warns))
                    following += 1
                elif place > following and place != last:  # behind a gap
                    out.append((own, place, kind, call, usd, None, None, None, None))
                    last = place
            yield pd.DataFrame(out, columns=names)
        if ledger is not None:
            yield pd.DataFrame([head()], columns=names)

    return work


def guarded_rows(entries: DataFrame, cap_usd: float, warn_usd: float | None = None) -> DataFrame:
    """Decisions on such a stream, run to the end of what there is; what waits between batches is a table, not state."""
    spark = entries.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    part = lambda number, decided: f"{base}/rows/batch={number}/decided={str(decided).lower()}"

    def put(batch: DataFrame, number: int) -> None:
        rows = batch
        if number and exists(spark, part(number - 1, False)):
            rows = batch.unionByName(spark.read.schema(_PASSED).parquet(part(number - 1, False)).select(batch.columns))
        ordered = rows.repartition("ledger").sortWithinPartitions("ledger", "place")
        done = ordered.mapInPandas(_passed(cap_usd, warn_usd), _PASSED).withColumn("decided", F.col("verdict").isNotNull())
        done.write.mode("overwrite").partitionBy("decided").parquet(f"{base}/rows/batch={number}")
        remove(spark, part(number - 2, False))

    _placed(entries).writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = [f"{base}/rows/{name}/decided=true" for name, _ in listed(spark, f"{base}/rows")]
    rows = [path for path in rows if exists(spark, path)]
    found = spark.read.schema(_PASSED).parquet(*rows) if rows else spark.createDataFrame([], _PASSED)
    return found.select(*[c.split()[0] for c in DECIDED.split(", ")])


#: What recorded spend says of reservations: each is made on its day, and settled two days later or, one in ten, released.
sql.relation("spend_moves", """
SELECT command AS ledger, CAST(ts AS DATE) AS day, 1 AS turn, 'reserve' AS kind, seq AS call, reserved_usd AS usd FROM ledger_v
UNION ALL SELECT command, CAST(ts AS DATE) + 2, 0, CASE WHEN seq % 10 = 0 THEN 'release' ELSE 'settle' END, seq, actual_usd FROM ledger_v
""")
#: Places without gaps, in two levels: by day, and within a day, so that a ledger's history is no single task.
sql.relation("spend_log", """
SELECT m.ledger, d.before + m.own - 1 AS place, m.kind, m.call, m.usd FROM (SELECT ledger, day, kind, call, usd, row_number() OVER (PARTITION BY ledger, day ORDER BY turn, call) AS own FROM spend_moves) m
JOIN (SELECT ledger, day, sum(n) OVER (PARTITION BY ledger ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM (SELECT ledger, day, count(*) AS n FROM spend_moves GROUP BY ledger, day) x) d ON d.ledger = m.ledger AND d.day = m.day
""")
#: Batches, about, that a log's files are read in.
BATCHES = 4


def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded spend as a stream that comes out of order, guarded by the run's cap."""
    path = f"{shared_dir(spark)}/spend-{uuid.uuid4().hex}"
    log = sql.run(spark, sf_dir, "SELECT ledger, place, kind, CAST(call AS STRING) AS call, usd FROM spend_log")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    log.repartition(files, "call").write.parquet(path)  # by calls, so that no batch has a ledger in order
    settings = sql.run(spark, sf_dir, "SELECT cap_usd, warn_usd FROM run_settings").first()
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", -(-files // BATCHES)).parquet(path)
    out = guarded_rows(stream, settings["cap_usd"], settings["warn_usd"])
    remove(spark, path)
    return out

"""Jobs as state machines with a timer: legal steps are taken, others rejected, what takes too long is escalated.

A job is pending, then processing, then completed or failed.  If it is processing ``days`` after it became pending (or
starts to later), it is escalated; after that and after its end nothing is taken any more.  ``outcomes`` reads a log at
rest, ``stream_outcomes`` one that arrives in any order: it keeps what the watermark has not passed yet, and works it
off in order of time when it has.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.registry import query
from ..plans.views import Views

c = F.col
DAYS = 35
#: The events span thirty days, so the query's timer is shorter; its log is read as of this moment.
QUERY_DAYS, QUERY_NOW = 7, "2024-01-25"
ENDS = ("completed", "failed")
OUTCOME = "id string, seq long, status string, at_us long, outcome string"
DAY = 86_400_000_000


def outcomes(log: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """What became of each row of ``log`` (id, seq, status, ts) up to ``now``, and the escalations (without a seq).

    Returns id, seq, status, at_us (microseconds) and outcome: accepted, rejected or escalated.  Rows of one time are taken by
    seq.  All windows share one shuffle by job and one order, and hold no more than counts and times.
    """
    seen = log.where(c("ts") <= F.lit(now).cast("timestamp")).select("id", "seq", "status", F.unix_micros("ts").alias("at_us"))
    order = Window.partitionBy("id").orderBy("at_us", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(what) -> F.Column:
        return F.coalesce(F.max(what).over(before), F.lit(False))

    born = seen.withColumn("_born", (c("status") == "pending") & ~earlier(c("status") == "pending"))
    born = born.withColumn("_due", F.max(F.when(c("_born"), c("at_us"))).over(order) + days * DAY)
    went = born.withColumn("_start", (c("status") == "processing") & earlier("_born")).withColumn("_began", c("_start") & ~earlier("_start"))
    done = went.withColumn("_end", c("status").isin(*ENDS) & earlier("_began")).withColumn("_first_end", c("_end") & ~earlier("_end"))
    steps = done.withColumn("_taken", c("_born") | c("_began") | (c("_first_end") & (c("at_us") < c("_due"))))
    taken = steps.select("id", "seq", "status", "at_us", F.when(c("_taken"), "accepted").otherwise("rejected").alias("outcome"))
    jobs = steps.groupBy("id").agg(F.max("_due").alias("due"), F.max(F.when(c("_began"), c("at_us"))).alias("began"), F.max(F.coalesce(c("_first_end") & c("_taken"), F.lit(False))).alias("ended"))
    late = jobs.where(c("began").isNotNull() & ~c("ended")).select("id", F.lit(None).cast("long").alias("seq"), F.lit("escalated").alias("status"), F.greatest("due", "began").alias("at_us"), F.lit("escalated").alias("outcome"))
    return taken.unionByName(late.where(c("at_us") <= F.unix_micros(F.lit(now).cast("timestamp"))))


class Job:
    """A job's state between batches: its status, when it is due, and rows that the watermark has not passed."""

    def __init__(self):
        self.status, self.due, self.waiting = None, None, []

    def step(self, seq: int, status: str, at: int) -> str:
        legal = {None: ("pending",), "pending": ("processing",), "processing": ENDS}.get(self.status, ())
        if status not in legal:
            return "rejected"
        self.status = status
        return "accepted"

    def until(self, mark: int, days: int) -> Iterator[tuple]:
        """Work off all rows and the timer up to ``mark``: (seq, status, at, outcome)."""
        self.waiting.sort()
        while True:
            at = self.waiting[0][0] if self.waiting else None
            if self.status == "processing" and self.due <= mark and (at is None or self.due <= at):
                self.status = "escalated"
                yield None, "escalated", self.due, "escalated"
            elif at is not None and at <= mark:
                at, seq, status = self.waiting.pop(0)
                outcome = self.step(seq, status, at)
                if outcome == "accepted" and status == "pending":
                    self.due = at + days * DAY
                elif outcome == "accepted" and status == "processing":
                    self.due = max(self.due, at)
                yield seq, status, at, outcome
            else:
                return

    def next(self) -> int | None:
        times = [self.waiting[0][0]] if self.waiting else []
        return min([*times, self.due] if self.status == "processing" else times, default=None)


def stream_outcomes(log: DataFrame, late: str, days: int = DAYS) -> DataFrame:
    """``outcomes`` over a stream of (id, seq, status, ts): each is given out when the watermark, ``late`` behind the newest
    row, has passed it.  A job holds only its rows within ``late`` and one timer."""

    def work(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = pickle.loads(state.get[0]) if state.exists else Job()
        mark = state.getCurrentWatermarkMs() * 1000
        for part in rows:
            for seq, status, at in zip(part["seq"].tolist(), part["status"].tolist(), part["at_us"].tolist(), strict=True):
                job.waiting.append((at, seq, status))
        found = [(key[0], *x) for x in job.until(mark, days)]
        state.update((pickle.dumps(job),))
        if job.next() is not None:
            state.setTimeoutTimestamp(max(job.next() // 1000 + 1, mark // 1000 + 1))
        yield pd.DataFrame(found, columns=["id", "seq", "status", "at_us", "outcome"]).astype({"seq": "Int64"})

    rows = log.where(c("ts").isNotNull()).withWatermark("ts", late).select("id", "seq", "status", "ts", F.unix_micros("ts").alias("at_us"))
    return rows.groupBy("id").applyInPandasWithState(work, OUTCOME, "job binary", "append", GroupStateTimeout.EventTimeTimeout)


JOB_SQL = f"""WITH l AS (SELECT id, seq, status, epoch_us(ts) AS at_us FROM job_log WHERE ts <= TIMESTAMP '{QUERY_NOW}'),
    b AS (SELECT id, min(row(at_us, seq)) FILTER (WHERE status = 'pending') AS born FROM l GROUP BY id),
    p AS (SELECT b.id, born, min(row(at_us, seq)) FILTER (WHERE status = 'processing' AND row(at_us, seq) > born) AS began FROM b JOIN l ON b.id = l.id WHERE born IS NOT NULL GROUP BY ALL),
    f AS (SELECT p.id, born, began, min(row(at_us, seq)) FILTER (WHERE status IN ('completed', 'failed') AND row(at_us, seq) > began) AS ended FROM p JOIN l ON p.id = l.id GROUP BY ALL),
    j AS (SELECT id, born, began, CASE WHEN ended[1] < born[1] + {QUERY_DAYS * DAY} THEN ended END AS ended, born[1] + {QUERY_DAYS * DAY} AS due FROM f)
    SELECT l.id, l.seq, l.status, l.at_us, CASE WHEN row(l.at_us, l.seq) IN (j.born, j.began, j.ended) THEN 'accepted' ELSE 'rejected' END AS outcome FROM l LEFT JOIN j ON l.id = j.id
    UNION ALL SELECT id, NULL, 'escalated', greatest(due, began[1]), 'escalated' FROM j WHERE began IS NOT NULL AND ended IS NULL AND greatest(due, began[1]) <= epoch_us(TIMESTAMP '{QUERY_NOW}')"""


@query("R4_R5_job_timers", JOB_SQL)
def job_timers(v: Views) -> DataFrame:
    return outcomes(v.job_log, QUERY_NOW, QUERY_DAYS)

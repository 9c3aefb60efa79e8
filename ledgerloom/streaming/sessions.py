"""Debounced saves: the last of a run of changes, once nothing has changed for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import Views

c = F.col
#: The tables' changes are hours apart, so the pause that ends a run is hours too.
PAUSE_HOURS = 8


def debounced(changes: DataFrame, key: str, ts: str, order: str, last: list[str], pause: str, late: str | None = None) -> DataFrame:
    """One row for each run of changes of a key in which no two neighbours are ``pause`` or more apart.

    It has the key, how many changes the run has, its first time, the time of the save (``pause`` after its last change),
    and the columns ``last`` of the change that is highest by ``order``.  Over a stream ``late`` is how far behind the
    newest change one may come; a run is given out when it cannot grow any more.  Changes without a time are left out.
    """
    timed = changes.where(c(ts).isNotNull())
    timed = timed.withWatermark(ts, late) if late else timed
    runs = timed.groupBy(F.session_window(ts, pause).alias("_run"), key).agg(F.count("*").alias("n_changes"), F.max_by(F.struct(*last), order).alias("_last"))
    return runs.select(key, "n_changes", c("_run.start").alias("first_at"), c("_run.end").alias("saved_at"), "_last.*")


@query("R8_debounced_saves", f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {PAUSE_HOURS} HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
    SELECT user_id, count(*) AS n_changes, epoch_us(min(ts)) AS first_at, epoch_us(max(ts) + INTERVAL {PAUSE_HOURS} HOURS) AS saved_at, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM r GROUP BY user_id, run""")  # fmt: skip
def debounced_saves(v: Views) -> DataFrame:
    """Each user's runs of events; times in microseconds."""
    runs = debounced(v.table("events").withColumn("ts", c("ts").cast("timestamp")), "user_id", "ts", "event_id", ["event_type", "event_id"], f"{PAUSE_HOURS} hours")
    return runs.select("user_id", "n_changes", F.unix_micros("first_at").alias("first_at"), F.unix_micros("saved_at").alias("saved_at"), "event_type", "event_id")

"""Change feeds, landing folders and timelines as Structured Streaming.

The streams below read Parquet that arrives in a folder.  ``availableNow`` drains what is there and stops, a processing
time keeps polling.  State lives in the checkpoint folder, so a restart goes on where it stopped.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.empties import needs_enrichment
from ..operators.resolution import ENRICH, FIELDS, KEY, keyed
from ..operators.scalars import FIRST4_SQL
from ..plans.registry import query
from ..plans.views import AS_OF, Views
from .keyed import KeyedState, latest

c = F.col


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a temporary one only in a local session that has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/feed-{uuid.uuid4().hex}"


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run a stream over all that has arrived, batch by batch."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def poll(stream: DataFrame, state: KeyedState, folder: str, every: str = "3 seconds", seconds: float = 120) -> None:
    """Look for arrivals time and again and merge them, for so many seconds at most."""
    running = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
    running.awaitTermination(seconds)
    running.stop()


def arrivals(spark: SparkSession, folder: str, schema: T.StructType, files: int = 4) -> DataFrame:
    """The Parquet files of a landing folder as a stream, so many for each batch; a single file is a folder with one file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", path.getName()).parquet(folder.rpartition("/")[0])


def land_and_upsert(spark: SparkSession, landing: str, schema: T.StructType, key: list[str], order: str) -> DataFrame:
    """Files of a landing folder, upserted by key into a compact state: the row with the highest order of each key."""
    folder = shared_folder(spark)
    state = KeyedState(spark, f"{folder}/state", schema, key, latest(schema.names, key, order))
    drain(arrivals(spark, landing, schema), state.merge, folder)
    return state.rows()


def pending_queue(v: Views, folder: str) -> KeyedState:
    """Disputes by id with their newest status; one whose status is "deleted" is gone."""
    schema = v.dispute_log.schema
    return KeyedState(v.spark, folder, schema, ["id"], latest(schema.names, ["id"], "seq"), removed="status = 'deleted'")


@query("R1_R2_R3_landing_upsert", "SELECT id, max_by(status, seq) AS status, max(seq) AS seq FROM dispute_log GROUP BY id HAVING max_by(status, seq) <> 'deleted'")
def landing_upsert(v: Views) -> DataFrame:
    """The newest status of each dispute, kept up to date by a stream over the events as they arrive; deleted ones go."""
    folder = shared_folder(v.spark)
    state = pending_queue(v, f"{folder}/state")
    drain(v.over("dispute_log", lambda name: arrivals(v.spark, f"{v.sf_dir}/{name}.parquet", v.table(name).schema)), state.merge, folder)
    return state.rows().select("id", "status", "seq")


#: The day on which the second batch of the change feed begins.
SECOND = "2024-01-20"


@query("R1_change_feed", f"""WITH a AS (SELECT id, max_by(status, seq) AS status, max(seq) AS seq FROM dispute_log WHERE ts < TIMESTAMP '{SECOND}' GROUP BY id), b AS (SELECT id, max_by(status, seq) AS status, max(seq) AS seq FROM dispute_log GROUP BY id)
    SELECT b.id, b.status, b.seq, CASE WHEN b.status = 'deleted' THEN 'deleted' WHEN coalesce(a.status, 'deleted') = 'deleted' THEN 'inserted' ELSE 'updated' END AS change
    FROM b LEFT JOIN a ON a.id = b.id WHERE a.seq IS DISTINCT FROM b.seq AND NOT (b.status = 'deleted' AND coalesce(a.status, 'deleted') = 'deleted')""")  # fmt: skip
def change_feed(v: Views) -> DataFrame:
    """What the second of two batches changed: disputes inserted, updated and deleted, as the difference of two snapshots."""
    state, log = pending_queue(v, f"{shared_folder(v.spark)}/state"), v.dispute_log
    first = c("ts") < F.lit(SECOND).cast("timestamp")
    state.merge(log.where(first), 0)
    state.merge(log.where(~first), 1)
    return state.changes(1).select("id", "status", "seq", "change")


def arrival_states(arrivals: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """Each arrival as a state of its own: of every field its value if that is good, and its value as the last one."""
    parts = [F.lit(1).cast("long").alias("arrivals"), c(order).alias("first_order")]
    for f in fields:
        good = ~needs_enrichment(c(f))
        parts += [F.when(good, c(f)).alias(f"good_{f}"), F.when(good, c(order)).alias(f"good_order_{f}"), c(f).alias(f"last_{f}"), c(order).alias(f"last_order_{f}")]
    return arrivals.select(*key, *parts)


def enrichment_state(spark: SparkSession, folder: str, key_types: dict[str, str], fields: list[str], types: dict[str, str], order_type: str, buckets: int = 32) -> KeyedState:
    """Records that arrivals enrich one after another, as states that merge in any grouping and order.

    What a field holds after all arrivals is its first good value, else its last one.  So a state keeps both with their
    order, and arrivals that come late take their place.
    """
    merge = {"arrivals": F.sum("arrivals"), "first_order": F.min("first_order")}
    columns = {"arrivals": "long", "first_order": order_type, **key_types}
    for f in fields:
        columns |= {f"good_{f}": types[f], f"good_order_{f}": order_type, f"last_{f}": types[f], f"last_order_{f}": order_type}
        merge |= {f"good_{f}": F.min_by(f"good_{f}", f"good_order_{f}"), f"good_order_{f}": F.min(f"good_order_{f}"), f"last_{f}": F.max_by(f"last_{f}", f"last_order_{f}"), f"last_order_{f}": F.max(f"last_order_{f}")}
    schema = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
    return KeyedState(spark, folder, schema, list(key_types), merge, buckets=buckets)


def enriched(states: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    return states.select(*key, "first_order", "arrivals", *[F.when(c(f"good_order_{f}").isNotNull(), c(f"good_{f}")).otherwise(c(f"last_{f}")).alias(f) for f in fields])


@query("M6_W10_streamed_enrichment", f"""WITH k AS (SELECT *, {FIRST4_SQL} AS first4 FROM tradelines WHERE date_opened <> '' AND credit_bureau <> '') SELECT user_id, creditor_name, first4, date_opened, credit_bureau, min(ord) AS first_order, count(*) AS arrivals,
    {", ".join(f"coalesce(min_by({f}, ord) FILTER (WHERE NOT {ENRICH.format(f)}), max_by({f}, ord)) AS {f}" for f in FIELDS)} FROM k GROUP BY 1, 2, 3, 4, 5""")  # fmt: skip
def streamed_enrichment(v: Views) -> DataFrame:
    """The records after all arrivals, folded by a stream over the orders as they land."""
    folder = shared_folder(v.spark)
    stream = keyed(v.over("tradelines", lambda name: arrivals(v.spark, f"{v.sf_dir}/{name}.parquet", v.table(name).schema)).where("date_opened <> '' and credit_bureau <> ''"))
    types = dict(stream.dtypes)
    state = enrichment_state(v.spark, f"{folder}/state", {k: types[k] for k in KEY}, FIELDS, types, types["ord"])
    drain(arrival_states(stream, KEY, FIELDS, "ord"), state.merge, folder)
    return enriched(state.rows(), KEY, FIELDS)


@query("R4_escalations", f"SELECT id, CASE WHEN status = 'processing' AND date_diff('day', created_on, DATE '{AS_OF}') >= 35 THEN 'escalated' ELSE status END AS status, date_diff('day', created_on, DATE '{AS_OF}') >= 40 AS past_deadline FROM disputes")
def escalations(v: Views) -> DataFrame:
    age = F.datediff(F.lit(AS_OF).cast("date"), "created_on")
    return v.disputes.select("id", F.when((c("status") == "processing") & (age >= 35), "escalated").otherwise(c("status")).alias("status"), (age >= 40).alias("past_deadline"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Extension: events by type in event-time windows; what is later than ``late`` behind the newest event is dropped."""
    timed = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


@query("R8_windowed_events", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(v: Views) -> DataFrame:
    """The same windows over the table at rest, as one aggregate."""
    return v.table("events").groupBy(c("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))

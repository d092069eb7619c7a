"""Streams over whole tables: each query writes its source, runs a stream over it to the end, and reads what the stream has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlake.catalog.base import Tables, query, when
from depotlake.catalog.decisions import event_rows
from depotlake.sources import files as SRC
from depotlake.streaming import events as EV
from depotlake.streaming.state import LatestTable, track

ACCEPTED = "FROM {events} WHERE event_id % 4 >= 1 AND value IS NOT NULL"


class Run:
    """A source folder that grows, and a stream over it that ends when it has read all there is, and can be started again."""

    def __init__(self, t: Tables, name: str):
        self.spark = t.spark
        self.source, self.out, self.mark = (SRC.scratch(t.spark, f"{name}-{part}") for part in ("in", "out", "offsets"))
        self.schema = None

    def add(self, rows: DataFrame, files: int = 4) -> Run:
        rows.repartition(files).write.mode("append").parquet(self.source)
        self.schema = rows.schema
        return self

    def stream(self, files: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(self.source)

    def append(self, rows: DataFrame) -> Run:
        """One run of the stream, each batch of which is added to the result."""
        rows.writeStream.format("parquet").option("checkpointLocation", self.mark).trigger(availableNow=True).start(self.out).awaitTermination()
        return self

    def result(self) -> DataFrame:
        return self.spark.read.parquet(self.out)


def parsed(t: Tables) -> DataFrame:
    run = Run(t, "parse").add(event_rows(t))
    return run.append(EV.parse(run.stream(2), "order").drop("value")).result()


def routed(t: Tables) -> DataFrame:
    run = Run(t, "route").add(event_rows(t))
    return run.append(EV.route(run.stream(2), "orders_stream")).result()


def by_date(t: Tables) -> DataFrame:
    """The stream's partitions, and their rows."""
    run = Run(t, "dates").add(event_rows(t))
    EV.append_batches(EV.route(run.stream(2), "orders_stream"), run.out, run.mark).awaitTermination()
    return run.result().groupBy(F.to_date("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def micro_batches(t: Tables) -> DataFrame:
    run = Run(t, "batches").add(event_rows(t))
    EV.append_batches(EV.route(run.stream(2), "orders_stream"), run.out, run.mark).awaitTermination()
    return run.result().select("order_id", "total_items", F.to_date("date").alias("date"))


def redelivered(t: Tables) -> DataFrame:
    """All events, and all once more after a restart: the second time they are repeated within the delay, or late."""
    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("event_time"))
    run = Run(t, "dedup")
    for _ in range(2):
        run.add(events)
        run.append(EV.dedup_redelivered(run.stream(), ["event_id"], "2 hours"))
    return run.result()


def status_changes(t: Tables) -> DataFrame:
    """Two events of each order: it was placed, and two days later it has its status."""
    at = F.col("order_date").cast("timestamp")
    each = F.array(F.struct(F.lit("Placed").alias("order_status"), at.alias("event_at")), F.struct("order_status", (at + F.expr("interval 2 days")).alias("event_at")))
    return t.fact_orders.select("order_id", F.explode(each).alias("e")).select("order_id", "e.*")


def loaded(t: Tables) -> DataFrame:
    """The final states first, then the earlier ones, then all again, in three runs of one stream into a table in which the latest wins."""
    changes, run = status_changes(t), Run(t, "load")
    table = LatestTable(t.spark, SRC.scratch(t.spark, "orders-latest"), ["order_id"], "event_at", buckets=16)
    for part in (changes.where("order_status <> 'Placed'"), changes.where("order_status = 'Placed'"), changes):
        run.add(part)
        EV.for_each_batch(run.stream(), run.mark, table.write).awaitTermination()
    return table.read()


def delivery_events(t: Tables) -> DataFrame:
    """Events of each delivery: assigned with its promised time, picked up, and its end; a failed one ends when it is picked up."""
    due = F.col("assigned_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("sla_minutes").cast("int"))
    e = lambda status, at: F.struct(F.lit(status).alias("delivery_status"), at.alias("event_time"))
    end = F.when(F.col("delivered_time").isNotNull(), e("Delivered", F.col("delivered_time"))).when(F.col("delivery_status") == "Failed", e("Failed", F.col("pickup_time")))
    each = F.array(e("Assigned", F.col("assigned_time")), e("Picked up", F.col("pickup_time")), end)
    return t.fact_deliveries.select("delivery_id", due.alias("due"), F.explode(each).alias("e")).select("delivery_id", "due", "e.*").where("event_time is not null")


def tracked(t: Tables) -> DataFrame:
    """Statuses and alerts from two runs: events up to a day, and after a restart those after it and, once more, the day's own."""
    events, run = delivery_events(t), Run(t, "track")
    middle = F.lit("1995-06-30").cast("timestamp")
    for part in (events.where(F.col("event_time") <= middle), events.where(F.col("event_time") > middle - F.expr("interval 1 hour"))):
        run.add(part)
        run.append(track(run.stream()))
    return run.result().withColumnRenamed("at", "event_at")


EVENTS = """(SELECT delivery_id, assigned_time + INTERVAL 1 MINUTE * CAST(sla_minutes AS INTEGER) AS due, 'Assigned' AS status, assigned_time AS event_at FROM {fact_deliveries}
    UNION ALL SELECT delivery_id, assigned_time + INTERVAL 1 MINUTE * CAST(sla_minutes AS INTEGER), 'Picked up', pickup_time FROM {fact_deliveries} WHERE pickup_time IS NOT NULL
    UNION ALL SELECT delivery_id, assigned_time + INTERVAL 1 MINUTE * CAST(sla_minutes AS INTEGER), CASE WHEN delivered_time IS NULL THEN 'Failed' ELSE 'Delivered' END, COALESCE(delivered_time, pickup_time)
        FROM {fact_deliveries} WHERE delivered_time IS NOT NULL OR delivery_status = 'Failed' AND pickup_time IS NOT NULL)"""
ORDER_ROWS = f"SELECT CONCAT('O-', CAST(event_id AS VARCHAR)) AS order_id, CAST(event_id % 4 AS BIGINT) AS total_items, strftime(ts, '%Y-%m-%d') AS date {ACCEPTED}"
query(
    "stream_parse_validate", parsed, "order_id total_items return_flag valid",
    "SELECT CONCAT('O-', CAST(event_id AS VARCHAR)) AS order_id, CAST(event_id % 4 AS BIGINT) AS total_items, FALSE AS return_flag, COALESCE(event_id % 4 >= 1 AND value IS NOT NULL, FALSE) AS valid FROM {events}",
)
query("stream_route", routed, "order_id total_items date", ORDER_ROWS)
query("stream_partition_date", by_date, None, f"SELECT strftime(ts, '%Y-%m-%d') AS date, COUNT(*) AS n {ACCEPTED} GROUP BY 1")
query("stream_microbatch", micro_batches, None, ORDER_ROWS)
query("stream_dedup", redelivered, "event_id event_type", "SELECT event_id, event_type FROM {events}")
query("stream_load_table", loaded, None, f"SELECT order_id, order_status, {when('event_at')} FROM (SELECT order_id, order_status, CAST(order_date AS TIMESTAMP) + INTERVAL 2 DAY AS event_at FROM {{fact_orders}}) x")
query(
    "stream_delivery_state", lambda t: tracked(t).where("kind = 'status'").groupBy("delivery_id").agg(F.max_by("delivery_status", F.struct("event_at", "delivery_status")).alias("delivery_status"), F.max("event_at").alias("event_at")), None,
    f"SELECT delivery_id, arg_max(status, (event_at, status)) AS delivery_status, strftime(MAX(event_at), '%Y-%m-%d %H:%M:%S') AS event_at FROM {EVENTS} e GROUP BY 1",
)
query(
    "stream_sla_alerts", lambda t: tracked(t).where("kind = 'alert'"), "delivery_id event_at",
    f"""SELECT delivery_id, strftime(due, '%Y-%m-%d %H:%M:%S') AS event_at FROM (SELECT delivery_id, MIN(due) AS due, MIN(CASE WHEN status IN ('Delivered', 'Failed') THEN event_at END) AS ended FROM {EVENTS} e GROUP BY 1) x
    WHERE (ended IS NULL OR ended > due) AND due < (SELECT MAX(event_at) FROM {EVENTS} m) - INTERVAL 1 HOUR""",
)

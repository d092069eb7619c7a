"""Event streams: parsing and validation, routing, business dates, micro-batches, duplicates.

Each function takes a streaming or a batch frame. Sources are Kafka topics, or folders of JSON lines in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depotlake.operators.keyed import dedup_latest, upsert

# The events' fields, their constraints and defaults, and the topics.
SCHEMAS = {
    "order": "event_type string, event_time timestamp, order_id string, order_date string, customer_id string, assigned_warehouse_id string, nearest_warehouse_id string, allocation_strategy string, order_priority string, total_items int, total_amount decimal(12,2), total_fulfillment_cost decimal(12,2), order_status string, return_flag boolean, experiment_id string, experiment_group string",
    "delivery": "event_type string, event_time timestamp, delivery_id string, order_id string, driver_id string, warehouse_id string, delivery_status string, distance_km double, estimated_eta_minutes double, actual_delivery_minutes double, delivery_cost decimal(10,2), on_time_flag boolean, sla_minutes int",
    "inventory": "event_type string, event_time timestamp, snapshot_date string, warehouse_id string, product_id string, opening_stock int, units_sold int, units_received int, units_returned int, closing_stock int, stockout_flag boolean, reorder_triggered_flag boolean, days_of_supply double, holding_cost double",
}
RULES = {
    "order": "order_id is not null and total_items >= 1 and total_amount >= 0 and total_fulfillment_cost >= 0",
    "delivery": "delivery_id is not null and distance_km >= 0 and estimated_eta_minutes >= 0 and delivery_cost >= 0",
    "inventory": "snapshot_date is not null and opening_stock >= 0 and units_sold >= 0 and units_received >= 0 and units_returned >= 0 and closing_stock >= 0",
}
DEFAULTS = {"order": {"return_flag": False}, "delivery": {}, "inventory": {}}
TOPICS = {"orders_stream": ("order", "fact_orders", "order_date"), "deliveries_stream": ("delivery", "fact_deliveries", "assigned_time"), "inventory_stream": ("inventory", "fact_inventory_snapshot", "snapshot_date")}
ENVELOPE = ["event_type", "event_time"]


def read_kafka(spark: SparkSession, brokers: str, topics: list[str] | None = None, per_batch: int = 5000) -> DataFrame:
    """topic, key and value of the subscribed topics from the earliest offset; needs Spark's Kafka connector."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", ",".join(topics or TOPICS))
    return stream.option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_batch).load().select("topic", F.col("key").cast("string"), F.col("value").cast("string"))


def parse(messages: DataFrame, kind: str) -> DataFrame:
    """value parsed into the event's columns, with defaults, and ``valid``: the JSON parsed and the constraints hold. value stays, for the quarantine."""
    parsed = messages.withColumn("e", F.from_json("value", SCHEMAS[kind]))
    flat = parsed.select(*messages.columns, "e.*")
    flat = flat.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS[kind].items()})
    return flat.withColumn("valid", F.coalesce(F.expr(RULES[kind]), F.lit(False)))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("valid").drop("valid", "value")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("not valid").select("value")


def route(messages: DataFrame, topic: str) -> DataFrame:
    """The valid events of a topic as rows of its table: without the envelope, with the partition column date."""
    kind, _, day = TOPICS[topic]
    events = accepted(parse(messages.where(F.col("topic") == topic), kind))
    return events.withColumn("date", business_date(events, day)).drop("topic", "key", *ENVELOPE)


def business_date(df: DataFrame, field: str) -> Column:
    """The first ten characters of the business date, else the date of the event, else ``unknown``."""
    own = F.col(field).cast("string") if field in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.substring(own, 1, 10), F.date_format("event_time", "yyyy-MM-dd"), F.lit("unknown"))


def append_batches(rows: DataFrame, path: str, checkpoint: str, by: str = "date") -> StreamingQuery:
    """Appends each micro-batch to a table partitioned by date; offsets are committed after the write, and a restart goes on from there."""
    return rows.writeStream.format("parquet").partitionBy(by).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def for_each_batch(rows: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_redelivered(events: DataFrame, keys: list[str], delay: str = "1 hour", at: str = "event_time") -> DataFrame:
    """Drops repeated events of the same key within the delay; state older than that is forgotten."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest_into(table: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table after a micro-batch: the latest row of each key wins, in the batch and against the table, so a batch can be repeated and late rows don't win."""
    newest = dedup_latest(batch, keys, order)
    if table is None:
        return newest
    old = table.select(*keys, F.col(order).alias("_old"))
    on = [newest[k].eqNullSafe(old[k]) for k in keys]
    newer = newest.join(old, on, "left").where(F.col("_old").isNull() | (F.col(order) >= F.col("_old"))).select(*[newest[c] for c in newest.columns])
    return upsert(table, newer, keys, [c for c in table.columns if c not in keys])


def tumbling_counts(events: DataFrame, length: str = "1 day", delay: str = "1 day", at: str = "event_time", by: str = "event_type") -> DataFrame:
    """An extension: events of each kind in windows of event time."""
    timed = events.withWatermark(at, delay) if events.isStreaming else events
    return timed.groupBy(F.window(at, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sla_alerts(deliveries: DataFrame) -> DataFrame:
    """An extension: deliveries that took longer than promised."""
    return deliveries.where(F.col("actual_delivery_minutes") > F.col("sla_minutes"))

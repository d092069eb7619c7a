"""Drivers' days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up

SHIFT_HOURS, MOST_HOURS, HOURS_PER_STOP = 8, 10, 0.25


def driver_activity(drivers: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row for each active driver and day with deliveries anywhere: stops, distance, hours at work and idle, utilization. Idle drivers stay, with zeros."""
    done = deliveries.where("delivery_status in ('Delivered', 'Failed')").groupBy("driver_id", F.to_date("assigned_time").alias("activity_date")).agg(F.count(F.lit(1)).alias("n"), F.sum("distance_km").cast("double").alias("km"))
    days = deliveries.select(F.to_date("assigned_time").alias("activity_date")).distinct()
    active = drivers.where("availability_status <> 'Inactive'").select("driver_id", "warehouse_id", "avg_speed_kmh")
    # drivers x days is the grain of the result itself
    spine = days.crossJoin(active).join(done, ["driver_id", "activity_date"], "left")
    n, km = F.coalesce("n", F.lit(0)), F.coalesce("km", F.lit(0.0))
    hours = F.least(km / F.col("avg_speed_kmh").cast("double") + F.lit(HOURS_PER_STOP) * n, F.lit(float(MOST_HOURS)))
    return spine.select(
        "driver_id", "activity_date", "warehouse_id", n.alias("deliveries_completed"), half_up(km, 2).alias("total_distance_km"), half_up(hours, 2).alias("total_active_hours"),
        half_up(F.greatest(F.lit(0.0), SHIFT_HOURS - hours), 2).alias("idle_hours"), half_up(F.least(F.lit(100.0), hours / SHIFT_HOURS * 100), 2).alias("utilization_pct"),
    )

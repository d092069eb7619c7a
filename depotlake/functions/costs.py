"""Distances and costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up

# earth's radius in km, road km for each km of air line, delivery cost as base and rate, and the platform's other rates.
EARTH_KM, ROAD, BASE_COST, COST_PER_KM = 6371.0, 1.3, 3.50, 0.85
HOLDING_RATE, DAYS = 0.001, 365


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Air-line km between two points in degrees."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def delivery_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return half_up(haversine(lat1, lon1, lat2, lon2) * ROAD, 2)


def delivery_cost(km: Column) -> Column:
    return half_up(F.lit(BASE_COST) + F.lit(COST_PER_KM) * km, 2)


def holding_cost(units: Column, cost_price: Column) -> Column:
    return half_up(units * cost_price.cast("double") * HOLDING_RATE, 2)


def inventory_value(units: Column, cost_price: Column) -> Column:
    return half_up(units * cost_price.cast("double"), 2)


def shipment_cost(units: Column, weight_kg: Column, base: float = 50.0, per_kg: float = 0.5) -> Column:
    return half_up(F.lit(base) + units * weight_kg * per_kg, 2)


def fulfillment_cost(delivery: Column, items: Column, per_item: float = 1.25) -> Column:
    return half_up(delivery + items * per_item, 2)


def cost_matrix(customers: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Customer, warehouse, road km and cost. The warehouses are a handful and are broadcast; a customer's row becomes one for each."""
    w = warehouses.select("warehouse_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    pairs = customers.select("customer_id", "latitude", "longitude").join(F.broadcast(w))
    km = delivery_distance(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    return pairs.select("customer_id", "warehouse_id", km.alias("distance_km")).withColumn("cost", delivery_cost(F.col("distance_km")))


def nearest_warehouse(customers: DataFrame, warehouses: DataFrame) -> DataFrame:
    """The nearest warehouse of each customer; of equally near ones the first by id. A customer's row looks at all warehouses in one array, so that no pairs are made or sorted."""
    all_of = warehouses.agg(F.collect_list(F.struct("warehouse_id", "latitude", "longitude")).alias("_w"))  # one row
    seen = F.transform("_w", lambda w: F.struct(delivery_distance(F.col("latitude"), F.col("longitude"), w["latitude"], w["longitude"]).alias("distance_km"), w["warehouse_id"].alias("warehouse_id")))
    near = customers.select("customer_id", "latitude", "longitude").join(F.broadcast(all_of)).where(F.size("_w") > 0).select("customer_id", F.array_min(seen).alias("b"))
    best = near.groupBy("customer_id").agg(F.min("b").alias("b"))  # a customer has one row, as a rule
    return best.select("customer_id", F.col("b.warehouse_id").alias("nearest_warehouse_id"), F.col("b.distance_km").alias("distance_km"))

"""Scans over time, versions as of a time, allocation with full warehouses, seasonal demand, a database, keys in one pass, bucketed facts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from depotlake.catalog.base import ORACLES, Tables, big, day, dbl, query, when
from depotlake.catalog.decisions import MATRIX
from depotlake.catalog.scoring import GENERATED, TRAIN_END, VALID_END
from depotlake.catalog.series import D, dates_of, kpis_of, rounded, scd2
from depotlake.catalog.staging import CUSTOMERS, DELIVERIES, DRIVERS, INT_DELIVERIES, INT_ORDERS, ITEMS, ORDERS, PRODUCTS, Staged
from depotlake.functions import costs as C
from depotlake.operators import enrich as E
from depotlake.operators import optimize as O
from depotlake.operators import quality as Q
from depotlake.operators import scans
from depotlake.operators import staging as S
from depotlake.plans import features as P
from depotlake.plans import models as ML
from depotlake.plans import seasonal as SE
from depotlake.sources import files as SRC
from depotlake.sources import jdbc
from depotlake.sources.bucketed import bucketed

# Means over earlier deliveries, as the trained delivery model has them.
EARLIER = "ORDER BY epoch(assigned_time) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
query(
    "eta_history",
    lambda t: rounded(P.eta_features(Staged(t).int_deliveries, dates_of(t), as_of_start=True, facts=Staged(t).deliveries), ["delivery_id", "driver_avg_delivery", "driver_hist_speed_kmh", "warehouse_avg_delivery"], 5),
    None,
    f"""SELECT delivery_id, ROUND(COALESCE(own, every), 5) AS driver_avg_delivery, ROUND(CASE WHEN own IS NULL THEN 30 ELSE LEAST(120, own_km / (own / 60)) END, 5) AS driver_hist_speed_kmh,
        ROUND(COALESCE(there, every), 5) AS warehouse_avg_delivery
    FROM (
        SELECT delivery_id, AVG(m) OVER (PARTITION BY driver_id {EARLIER}) AS own, AVG(km) OVER (PARTITION BY driver_id {EARLIER}) AS own_km,
            AVG(m) OVER (PARTITION BY warehouse_id {EARLIER}) AS there, AVG(m) OVER () AS every
        FROM (SELECT *, CAST(actual_delivery_minutes AS DOUBLE) AS m, CAST(distance_km AS DOUBLE) AS km FROM {D} d) e
    ) x""",
)

# Orders with the customer's segment as of their day, from the history of two looks at the customers.
query(
    "join_as_of",
    lambda t: scans.as_of(t.fact_orders.select("order_id", "customer_id", "order_date"), S.scd_columns(scd2(t)), "customer_id", "order_date", "valid_from", ["customer_segment"], "valid_to"),
    None,
    f"""SELECT o.order_id, o.customer_id, {day('o.order_date').replace('AS o.order_date', 'AS order_date')}, CASE WHEN CAST(o.order_date AS TIMESTAMP) < COALESCE(CAST(v.valid_to AS TIMESTAMP), TIMESTAMP '9999-12-31') THEN v.customer_segment END AS customer_segment
    FROM {{fact_orders}} o ASOF LEFT JOIN (SELECT customer_id AS c, customer_segment, CAST(valid_from AS TIMESTAMP) AS valid_from, valid_to FROM ({ORACLES['scd2_snapshot']}) h) v
    ON o.customer_id = v.c AND CAST(o.order_date AS TIMESTAMP) >= v.valid_from""",
)


# Small warehouses, which each busy day fills.
def full_allocation(t: Tables):
    tiny = t.dim_warehouse.withColumn("capacity_units", F.col("capacity_units") % 7 + 2)
    return O.greedy_allocation(Staged(t).orders.where("order_status <> 'Cancelled'"), C.cost_matrix(t.dim_customer, t.dim_warehouse), tiny)


query(
    "greedy_allocation_full", full_allocation, None,
    f"""SELECT * FROM (WITH RECURSIVE w AS (SELECT list(CAST(FLOOR((capacity_units % 7 + 2) * 0.9E0) AS BIGINT) ORDER BY warehouse_id) AS room, list(warehouse_id ORDER BY warehouse_id) AS ids FROM {{dim_warehouse}}),
    m AS (SELECT customer_id, list(cost ORDER BY warehouse_id) AS cost FROM {MATRIX} x GROUP BY 1),
    o AS (
        SELECT order_id, order_date, assigned_warehouse_id, CAST(total_items AS BIGINT) AS items, CAST(total_fulfillment_cost AS DOUBLE) AS baseline_cost, cost,
            ROW_NUMBER() OVER (PARTITION BY order_date ORDER BY CASE order_priority WHEN 'Same-Day' THEN 0 WHEN 'Express' THEN 1 ELSE 2 END, order_id) AS n
        FROM {ORDERS} x LEFT JOIN m ON m.customer_id = x.customer_id WHERE order_status <> 'Cancelled'
    ),
    c AS (SELECT DISTINCT order_date, CAST(0 AS BIGINT) AS n, room, ids, CAST(NULL AS VARCHAR) AS order_id, CAST(NULL AS BIGINT) AS k FROM o CROSS JOIN w),
    r AS (
        SELECT * FROM c
        UNION ALL
        SELECT order_date, n, CASE WHEN k IS NULL THEN room ELSE list_transform(range(1, len(room) + 1), lambda i: CASE WHEN i = k THEN GREATEST(0, room[i] - items) ELSE room[i] END) END AS room, ids, order_id, k
        FROM (
            SELECT o.order_date, o.n, r.room, r.ids, o.order_id, o.items,
                CASE WHEN o.cost IS NULL THEN NULL ELSE list_min(list_transform(list_filter(range(1, len(r.room) + 1), lambda i: r.room[i] > 0), lambda i: struct_pack(c := o.cost[i], k := i))).k END AS k
            FROM r JOIN o ON o.order_date = r.order_date AND o.n = r.n + 1
        ) step
    )
    SELECT o.order_id, strftime(o.order_date, '%Y-%m-%d') AS order_date, COALESCE(r.ids[r.k], o.assigned_warehouse_id) AS warehouse_id, o.assigned_warehouse_id AS original_warehouse_id,
        COALESCE(o.cost[r.k], o.baseline_cost) AS optimal_cost, o.baseline_cost, COALESCE(r.ids[r.k], o.assigned_warehouse_id) = o.assigned_warehouse_id AS is_optimal_assignment
    FROM o JOIN r ON r.order_id = o.order_id) allocated""",
)


query("allocation_savings_full", lambda t: O.allocation_savings(full_allocation(t)), None)
ORACLES["allocation_savings_full"] = f"""SELECT ROUND(b, 2) AS total_baseline_cost, ROUND(o, 2) AS total_optimized_cost, ROUND(b - o, 2) AS total_savings, ROUND(CASE WHEN b > 0 THEN (b - o) / b * 100 ELSE 0 END, 2) AS savings_pct, ROUND(e * 100, 2) AS allocation_efficiency_pct
    FROM (SELECT CAST(SUM(CAST(baseline_cost AS DECIMAL(18,2))) AS DOUBLE) AS b, CAST(SUM(CAST(optimal_cost AS DECIMAL(18,2))) AS DOUBLE) AS o, AVG(CASE WHEN is_optimal_assignment THEN 1.0E0 ELSE 0 END) AS e FROM ({ORACLES['greedy_allocation_full']}) g) x"""


# The network's daily demand: a seasonal model beside the last weeks' means.
def seasonal_rows(t: Tables):
    return P.temporal_split(SE.daily_totals(kpis_of(t), dates_of(t)), "date", TRAIN_END, VALID_END)


def seasonal_model(t: Tables, until: date = TRAIN_END):
    return SE.fit_seasonal(seasonal_rows(t).where(F.col("date") <= F.lit(until)), date(1992, 1, 1))


def seasonal_metrics(t: Tables):
    days = seasonal_rows(t).where("split <> 'test'")
    scored = SE.seasonal_scores(days, seasonal_model(t)).withColumnRenamed("split", "model")
    return ML.regression_metrics(scored, "units", "demand_forecast", ["model"]).withColumnRenamed("model", "split")


query("train_seasonal", seasonal_metrics, "split mape rmse mae r2 n")
query("forecast_seasonal", lambda t: SE.seasonal_forecast(seasonal_model(t, GENERATED), GENERATED, 180, t.spark), None)


# A database: written in batches, read in parts by the quantiles of the key with filters handed down, and by a query that it evaluates.
def in_database(t: Tables):
    url = jdbc.embedded(t.spark)
    facts = t.fact_orders.select("order_id", F.expr("cast(substring(order_id, 3) as bigint)").alias("order_key"), "order_status", "total_items", "total_amount", "order_date")
    jdbc.write_rows(facts.coalesce(4), url, "orders", "overwrite", createTableColumnTypes="order_id VARCHAR(32), order_status VARCHAR(32)")
    return url


def database_read(t: Tables):
    orders = jdbc.read_partitioned(t.spark, in_database(t), "orders", "order_key")
    return orders.where("order_date >= date'1997-01-01' and total_items > 2").select("order_id", "total_items", "order_date")


def database_sums(t: Tables):
    sums = 'SELECT "order_status", COUNT(*) AS "n", SUM("total_items") AS "items" FROM orders GROUP BY "order_status"'
    return SRC.read_table(t.spark, in_database(t), query=sums)


query("src_jdbc_partitioned", database_read, None, f"SELECT order_id, total_items, {day('order_date')} FROM {{fact_orders}} WHERE order_date >= DATE '1997-01-01' AND total_items > 2")
query("sink_jdbc", database_sums, None, f"SELECT order_status, n, {big('items')} FROM (SELECT order_status, COUNT(*) AS n, SUM(total_items) AS items FROM {{fact_orders}} GROUP BY 1) x")


# All foreign keys of the deliveries and of the items, each table scanned once.
def foreign_keys(t: Tables):
    s = Staged(t)
    deliveries = Q.relationships(s.deliveries, {"order_id": (s.orders.where("order_id not like '%7'"), "order_id"), "driver_id": (s.drivers.where("driver_id not like '%3'"), "driver_id"), "warehouse_id": (t.dim_warehouse, "warehouse_id")})
    items = Q.relationships(s.items, {"order_id": (s.orders.where("order_status <> 'Cancelled'"), "order_id"), "product_id": (s.products, "product_id")})
    return deliveries.withColumn("child", F.lit("deliveries")).unionByName(items.withColumn("child", F.lit("items")))


query(
    "dq_relationships", foreign_keys, None,
    " UNION ALL ".join(
        f"SELECT '{child}' AS child, '{key}' AS relation, CAST({key} AS VARCHAR) AS key, COUNT(*) AS rows FROM {rows} c WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {parent} p WHERE {kept} AND {key} IS NOT NULL) GROUP BY 3"
        for child, key, rows, parent, kept in (
            ("deliveries", "order_id", DELIVERIES, ORDERS, "order_id NOT LIKE '%7'"), ("deliveries", "driver_id", DELIVERIES, DRIVERS, "driver_id NOT LIKE '%3'"),
            ("deliveries", "warehouse_id", DELIVERIES, "{dim_warehouse}", "TRUE"), ("items", "order_id", ITEMS, ORDERS, "order_status <> 'Cancelled'"), ("items", "product_id", ITEMS, PRODUCTS, "TRUE"),
        )
    ),
)


# Facts in buckets of their order, whose joins need no exchange.
def bucketed_orders(t: Tables, buckets: int = 16):
    s = Staged(t)
    return E.order_enriched(bucketed(s.orders, "orders", "order_id", buckets), s.customers, s.warehouses, bucketed(s.items, "items", "order_id", buckets))


def bucketed_deliveries(t: Tables, buckets: int = 16):
    s = Staged(t)
    return E.delivery_enriched(bucketed(s.deliveries, "deliveries", "order_id", buckets), s.drivers, bucketed(s.orders, "orders", "order_id", buckets), s.warehouses)


query("int_order_bucketed", bucketed_orders, "order_id customer_segment line_item_count item_total_revenue allocation_result", f"SELECT order_id, customer_segment, {big('line_item_count')}, {dbl('item_total_revenue')}, allocation_result FROM {INT_ORDERS} x")
query("int_delivery_bucketed", bucketed_deliveries, "delivery_id order_priority vehicle_type pickup_wait_minutes warehouse_region", f"SELECT delivery_id, order_priority, vehicle_type, {big('pickup_wait_minutes')}, warehouse_region FROM {INT_DELIVERIES} x")

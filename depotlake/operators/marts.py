"""Daily marts. Each fact is aggregated to its day and warehouse (or product) first; only these small results are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up
from depotlake.operators.enrich import items_of_orders
from depotlake.operators.staging import ratio

DAY = ["date", "warehouse_id"]


def r2(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return half_up(c.cast("double"), 2)


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def delivered(minutes: str = "actual_delivery_minutes") -> Column:
    return F.when(F.col("delivery_status") == "Delivered", F.col(minutes))


def daily_warehouse_kpis(orders: DataFrame, deliveries: DataFrame, inventory: DataFrame, shipments: DataFrame, warehouses: DataFrame) -> DataFrame:
    o = orders.where("order_status <> 'Cancelled'").groupBy(F.col("order_date").alias("date"), F.col("assigned_warehouse_id").alias("warehouse_id")).agg(
        F.count(F.lit(1)).alias("total_orders"), F.sum("total_amount").alias("revenue"), F.count_if("return_flag").alias("return_count"), F.count_if("is_experiment_order").alias("experiment_orders"),
    )
    d = deliveries.groupBy(F.col("delivery_date").alias("date"), "warehouse_id").agg(
        F.avg(delivered()).alias("minutes"), F.sum("delivery_cost").alias("delivery"), F.count_if((F.col("delivery_status") == "Delivered") & F.col("on_time_flag")).alias("on_time"),
        F.count_if(F.col("delivery_status") == "Delivered").alias("delivered"), F.count_if("sla_breach_flag").alias("breaches"), F.count(F.lit(1)).alias("records"),
    )
    i = inventory.groupBy(F.col("snapshot_date").alias("date"), "warehouse_id").agg(
        F.sum("holding_cost").alias("holding"), F.sum("inventory_value").alias("value"), F.count_if("stockout_flag").alias("stockouts"), F.count(F.lit(1)).alias("products"), F.sum("closing_stock").alias("stock"),
    )
    s = shipments.groupBy(F.col("shipment_date").alias("date"), "warehouse_id").agg(F.sum("shipment_cost").alias("shipment"))
    w = F.broadcast(warehouses.select("warehouse_id", "operating_cost_per_day", "capacity_units"))
    all_of = o.join(d, DAY, "left").join(i, DAY, "left").join(s, DAY, "left").join(w, "warehouse_id", "left")
    return all_of.select(
        *DAY, "total_orders", r2("revenue").alias("total_revenue"), r2(zero("holding") + zero("delivery") + zero("shipment") + F.col("operating_cost_per_day")).alias("total_cost"),
        ratio(F.col("on_time"), F.col("delivered"), factor=100.0).alias("service_level_pct"), ratio(F.col("stockouts"), F.col("products"), 4).alias("stockout_rate"), r2("minutes").alias("avg_delivery_time_min"),
        ratio(F.col("stock"), F.col("capacity_units"), factor=100.0).alias("capacity_utilization_pct"), r2(zero("holding")).alias("total_holding_cost"), r2(zero("delivery")).alias("total_delivery_cost"),
        r2(zero("shipment")).alias("total_shipment_cost"), r2(zero("value")).alias("total_inventory_value"), ratio(F.col("breaches"), F.col("records"), 4).alias("sla_breach_rate"), "return_count", "experiment_orders",
    )


def volatility_of(units: str, rows: int = 7) -> Column:
    """Standard deviation of a product's daily units over so many rows; null for one row."""
    return half_up(F.stddev_samp(units).over(Window.partitionBy("product_id").orderBy("date").rowsBetween(1 - rows, 0)), 2)


def demand_volatility(inventory: DataFrame, rows: int = 7) -> DataFrame:
    daily = inventory.groupBy(F.col("snapshot_date").alias("date"), "product_id").agg(F.sum("units_sold").alias("units"))
    return daily.select("date", "product_id", volatility_of("units", rows).alias("demand_volatility"))


def daily_product_kpis(inventory: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    key = ["date", "product_id"]
    # a product has one category and price tier, so that the groups are those of day and product
    i = inventory.groupBy(F.col("snapshot_date").alias("date"), "product_id", "category", "price_tier").agg(
        F.sum("units_sold").alias("total_units_sold"), F.avg("closing_stock").alias("stock"), F.count_if("stockout_flag").alias("stockout_count"), F.sum("holding_cost").alias("holding"),
        F.sum("inventory_value").alias("value"), F.avg("days_of_supply").alias("days"),
    )
    r = items_of_orders(items, orders).groupBy(F.col("order_date").alias("date"), "product_id").agg(F.sum("revenue").alias("revenue"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    i = i.withColumn("demand_volatility", volatility_of("total_units_sold"))
    return i.join(r, key, "left").select(
        *key, "category", "price_tier", "total_units_sold", r2(zero("revenue")).alias("total_revenue"), "stockout_count", r2("stock").alias("avg_closing_stock"),
        ratio(F.col("total_units_sold"), F.col("stock")).alias("inventory_turnover"), r2("days").alias("avg_days_of_supply"), r2("holding").alias("total_holding_cost"), r2("value").alias("total_inventory_value"),
        null("double", "demand_forecast"), null("double", "forecast_error"), "demand_volatility", null("double", "stockout_risk_score"), F.lit(False).alias("is_forecast"), null("int", "forecast_horizon"), null("date", "forecast_generated_date"),
    )


def delivery_performance(deliveries: DataFrame, activity: DataFrame) -> DataFrame:
    d = deliveries.groupBy(F.col("delivery_date").alias("date"), "warehouse_id").agg(
        F.count(F.lit(1)).alias("total_deliveries"), F.avg(delivered()).alias("minutes"), F.avg("distance_km").alias("km"), F.count_if("on_time_flag").alias("on_time"), F.count_if(F.col("delivery_status") == "Delivered").alias("delivered"),
        F.count_if("sla_breach_flag").alias("breaches"), F.sum("delivery_cost").alias("cost"), F.count_if(F.col("delivery_status") == "Failed").alias("failed_delivery_count"), F.avg("eta_accuracy_pct").alias("accuracy"),
        F.avg("eta_error_minutes").alias("error"), F.count_if(F.col("order_priority").isin("Express", "Same-Day")).alias("express"),
    )
    u = activity.groupBy(F.col("activity_date").alias("date"), "warehouse_id").agg(F.avg("utilization_pct").alias("use"))
    n = F.col("total_deliveries")
    return d.join(u, DAY, "left").select(
        *DAY, "total_deliveries", r2("minutes").alias("avg_delivery_time_min"), r2("km").alias("avg_distance_km"), ratio(F.col("on_time"), F.col("delivered"), factor=100.0).alias("on_time_pct"),
        ratio(F.col("breaches"), n, factor=100.0).alias("sla_breach_pct"), r2("cost").alias("total_delivery_cost"), r2(zero("use")).alias("avg_driver_utilization"), "failed_delivery_count",
        ratio(F.col("express"), n, factor=100.0).alias("express_order_pct"), r2("accuracy").alias("avg_eta_accuracy_pct"), r2("error").alias("avg_eta_error_minutes"),
    )


def allocation_rates(orders: DataFrame) -> DataFrame:
    """Orders by day and assigned warehouse, with those that went to the nearest one, came from elsewhere, and crossed regions."""
    nearest = F.col("assigned_warehouse_id") == F.col("nearest_warehouse_id")
    crossed = F.count_if(F.col("allocation_result") == "Cross Region") if "allocation_result" in orders.columns else F.lit(None).cast("long")
    return orders.where("order_status <> 'Cancelled'").groupBy(F.col("order_date").alias("date"), F.col("assigned_warehouse_id").alias("warehouse_id")).agg(
        F.count(F.lit(1)).alias("total_orders_assigned"), F.count_if(nearest).alias("orders_from_nearest"), F.count_if("is_cross_region").alias("orders_redirected_in"), crossed.alias("crossed"),
    )


def allocation_efficiency(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
    a = allocation_rates(orders)
    moved = (F.col("order_status") != "Cancelled") & (F.col("assigned_warehouse_id") != F.col("nearest_warehouse_id"))
    out = orders.where(moved).groupBy(F.col("order_date").alias("date"), F.col("nearest_warehouse_id").alias("warehouse_id")).agg(F.count(F.lit(1)).alias("moved_out"))
    d = deliveries.groupBy(F.col("delivery_date").alias("date"), "warehouse_id").agg(F.avg("distance_km").alias("km"), F.avg("delivery_cost").alias("cost"))
    n = F.col("total_orders_assigned")
    return a.join(out, DAY, "left").join(d, DAY, "left").select(
        *DAY, "total_orders_assigned", "orders_from_nearest", "orders_redirected_in", zero("moved_out").alias("orders_redirected_out"), ratio(F.col("orders_from_nearest"), n, factor=100.0).alias("nearest_assignment_rate"),
        r2(zero("km")).alias("avg_delivery_distance_km"), r2(zero("cost")).alias("avg_cost_per_order"), ratio(F.col("crossed"), n, factor=100.0).alias("cross_region_pct"),
    )


def cost_optimization(orders: DataFrame, deliveries: DataFrame, inventory: DataFrame, warehouses: DataFrame) -> DataFrame:
    h = inventory.groupBy(F.col("snapshot_date").alias("date"), "warehouse_id").agg(F.sum("holding_cost").alias("h"))
    t = deliveries.groupBy(F.col("delivery_date").alias("date"), "warehouse_id").agg(F.sum("delivery_cost").alias("t"))
    w = F.broadcast(warehouses.select("warehouse_id", "operating_cost_per_day"))
    both = h.join(t, DAY, "full_outer").join(w, "warehouse_id", "left").join(allocation_rates(orders), DAY, "left")
    base = (zero("h") + zero("t") + F.col("operating_cost_per_day")).cast("double")
    return both.select(
        *DAY, half_up(base, 2).alias("baseline_total_cost"), half_up(base * 0.92, 2).alias("optimized_total_cost"), half_up(base * 0.08, 2).alias("savings_amount"), F.lit(8.0).alias("savings_pct"),
        r2(zero("h")).alias("holding_cost_baseline"), r2(zero("h").cast("double") * 0.9).alias("holding_cost_optimized"), r2(zero("t")).alias("transport_cost_baseline"), r2(zero("t").cast("double") * 0.93).alias("transport_cost_optimized"),
        ratio(F.col("orders_from_nearest"), F.col("total_orders_assigned"), factor=100.0).alias("allocation_efficiency_pct"),
    )


def experiment_results(assignments: DataFrame, orders: DataFrame, deliveries: DataFrame, inventory: DataFrame) -> DataFrame:
    """For each experiment and group: orders, delivery times, service, costs, stockout rate, and the lift of Treatment over Control.

    The platform joins every assigned order with all products of its warehouse's day. Here inventory is first summed to (day,
    warehouse); weighted by orders this is the same ratio, from a few hundred times fewer rows.
    """
    key = ["experiment_id", "group_name"]
    o = assignments.select(*key, "order_id").join(orders.select("order_id", "order_date", "assigned_warehouse_id", "order_status", "total_fulfillment_cost"), "order_id")
    done = F.col("delivery_status") == "Delivered"
    of_order = deliveries.groupBy("order_id").agg(
        F.sum(delivered().cast("double")).alias("m"), F.count(delivered()).alias("timed"), F.count_if(done & F.col("on_time_flag")).alias("on_time"), F.count_if(done).alias("delivered"),
    )
    stock = inventory.groupBy(F.col("snapshot_date").alias("order_date"), F.col("warehouse_id").alias("assigned_warehouse_id")).agg(F.count_if("stockout_flag").alias("out"), F.count(F.lit(1)).alias("n"))
    # one row for each assigned order, and one aggregate; cancelled orders count for the stock only
    live = lambda c: F.when(F.col("order_status") != "Cancelled", F.col(c))
    rows = o.join(of_order, "order_id", "left").join(stock, ["order_date", "assigned_warehouse_id"], "left").groupBy(key).agg(
        F.count_distinct(live("order_id")).alias("total_orders"), F.avg(live("total_fulfillment_cost")).alias("cost"), F.sum(live("total_fulfillment_cost")).alias("costs"),
        F.try_divide(F.sum(live("m")), F.sum(live("timed"))).alias("minutes"), F.sum(live("on_time")).alias("on_time"), F.sum(live("delivered")).alias("delivered"), F.sum("out").alias("out"), F.sum("n").alias("n"),
    )
    rows = rows.where("total_orders > 0").select(
        *key, "total_orders", r2("minutes").alias("avg_delivery_time_min"), ratio(F.col("on_time"), F.col("delivered"), factor=100.0).alias("service_level_pct"), r2("cost").alias("avg_cost"), r2("costs").alias("total_cost"),
        F.col("minutes").cast("double").alias("m"), ratio(F.col("out"), F.col("n"), 4).alias("stockout_rate"),
    )
    control = rows.where("group_name = 'Control'").select("experiment_id", F.col("m").alias("base"))
    lift = F.when((F.col("group_name") == "Treatment") & (F.col("base") > 0), half_up((F.col("m") - F.col("base")) / F.col("base") * 100, 2))
    return rows.join(control, "experiment_id", "left").withColumn("lift_pct", lift).drop("m", "base")

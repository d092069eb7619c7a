"""Staging, enrichment and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlake.catalog.base import Tables, big, day, dbl, query
from depotlake.functions.calendar import calendar
from depotlake.operators import enrich as E
from depotlake.operators import marts as M
from depotlake.operators import staging as S
from depotlake.operators.activity import driver_activity

AS_OF = "DATE '2000-01-01'"


class Staged:
    """Staged and enriched tables."""

    def __init__(self, t: Tables):
        self.t = t
        self.orders, self.items = S.stg_orders(t.fact_orders), S.stg_order_items(t.fact_order_items)
        self.deliveries, self.inventory = S.stg_deliveries(t.fact_deliveries), S.stg_inventory_snapshot(t.fact_inventory_snapshot)
        self.shipments, self.warehouses = S.stg_shipments(t.fact_shipments), S.stg_warehouses(t.dim_warehouse)
        self.products, self.customers, self.drivers = S.stg_products(t.dim_product), S.stg_customers(t.dim_customer), S.stg_drivers(t.dim_driver)

    @property
    def activity(self):
        return S.stg_driver_activity(driver_activity(self.t.dim_driver, self.t.fact_deliveries))

    @property
    def int_orders(self):
        return E.order_enriched(self.orders, self.customers, self.warehouses, self.items)

    @property
    def int_deliveries(self):
        return E.delivery_enriched(self.deliveries, self.drivers, self.orders, self.warehouses)

    @property
    def int_inventory(self):
        return E.inventory_enriched(self.inventory, self.products, self.warehouses)


def tier(x: str, steps: list[tuple[float, str]], rest: str, op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {x} {op} {b} THEN '{n}'" for b, n in steps) + f" ELSE '{rest}' END"


def frac(a: str, b: str, digits: int = 2, factor: str = "", default: str = "0") -> str:
    return f"CAST(CASE WHEN {b} > 0 THEN ROUND(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE){factor}, {digits}) ELSE {default} END AS DOUBLE)"


ORDERS = f"""(SELECT order_id, order_date, customer_id, assigned_warehouse_id, nearest_warehouse_id, order_priority, total_items, total_amount, total_fulfillment_cost, order_status, return_flag,
    NULLIF(experiment_id, '') AS experiment_id, NULLIF(experiment_group, '') AS experiment_group, assigned_warehouse_id <> nearest_warehouse_id AS is_cross_region,
    {tier('total_amount', [(500, 'High Value'), (100, 'Medium Value')], 'Low Value')} AS order_value_tier, NULLIF(experiment_id, '') IS NOT NULL AS is_experiment_order
    FROM {{fact_orders}} WHERE total_amount > 0 AND order_status IS NOT NULL)"""
ITEMS = f"""(SELECT order_item_id, order_id, product_id, quantity, unit_price, COALESCE(discount_amount, 0) AS discount_amount, revenue, COALESCE(discount_amount, 0) > 0 AS has_discount,
    {frac('COALESCE(discount_amount, 0)', 'unit_price * quantity', factor=' * 100')} AS discount_pct FROM {{fact_order_items}} WHERE quantity > 0 AND unit_price > 0)"""
INVENTORY = """(SELECT snapshot_date, warehouse_id, product_id, opening_stock, units_sold, units_received, units_returned, closing_stock, stockout_flag, below_safety_stock_flag, holding_cost, inventory_value,
    CASE WHEN days_of_supply IS NOT NULL THEN LEAST(days_of_supply, 99.99) END AS days_of_supply, units_received + units_returned - units_sold AS net_stock_movement,
    CASE WHEN stockout_flag THEN 'Stockout' WHEN below_safety_stock_flag THEN 'Critical' WHEN days_of_supply < 7 THEN 'Low' WHEN days_of_supply < 30 THEN 'Healthy' ELSE 'Overstocked' END AS inventory_health
    FROM {fact_inventory_snapshot} WHERE closing_stock >= 0)"""
DELIVERIES = f"""(SELECT *, COALESCE(actual_delivery_minutes > sla_minutes, FALSE) AS sla_breach_flag,
    CASE WHEN estimated_eta_minutes > 0 THEN ROUND(100 - ABS(CAST(actual_delivery_minutes - estimated_eta_minutes AS DOUBLE)) / CAST(estimated_eta_minutes AS DOUBLE) * 100, 2) END AS eta_accuracy_pct,
    CAST(actual_delivery_minutes - estimated_eta_minutes AS DOUBLE) AS eta_error_minutes,
    CASE WHEN actual_delivery_minutes IS NOT NULL THEN {tier('actual_delivery_minutes', [(30, 'Express'), (60, 'Standard'), (120, 'Slow')], 'Very Slow', '<=')} END AS delivery_speed_tier,
    {frac('delivery_cost', 'distance_km')} AS cost_per_km FROM {{fact_deliveries}} WHERE delivery_status IS NOT NULL)"""
WAREHOUSES = f"""(SELECT *, {tier('capacity_units', [(75000, 'Large'), (65000, 'Medium')], 'Small')} AS capacity_tier,
    {tier('operating_cost_per_day', [(4500, 'High Cost'), (3800, 'Medium Cost')], 'Low Cost')} AS cost_tier FROM {{dim_warehouse}} WHERE is_active)"""
PRODUCTS = f"""(SELECT *, ROUND(CAST(selling_price - cost_price AS DOUBLE) / CAST(cost_price AS DOUBLE) * 100, 2) AS profit_margin_pct, {tier('selling_price', [(200, 'Premium'), (50, 'Mid-Range')], 'Budget')} AS price_tier,
    {tier('lead_time_days', [(10, 'High'), (5, 'Medium')], 'Low')} AS lead_time_risk FROM {{dim_product}} WHERE cost_price > 0 AND selling_price > 0 AND selling_price >= cost_price)"""
CUSTOMERS = f"""(SELECT *, {AS_OF} - acquisition_date AS customer_tenure_days, {tier('order_frequency_score', [(0.70, 'High'), (0.30, 'Medium')], 'Low')} AS engagement_tier
    FROM {{dim_customer}} WHERE latitude BETWEEN 24 AND 50 AND longitude BETWEEN -130 AND -60)"""
DRIVERS = f"""(SELECT *, ROUND(({AS_OF} - hire_date) / 365.25E0, 1) AS experience_years, {tier('max_delivery_capacity', [(25, 'High'), (15, 'Medium')], 'Low')} AS capacity_tier,
    {tier('avg_speed_kmh', [(45, 'Fast'), (30, 'Medium')], 'Slow')} AS speed_tier FROM {{dim_driver}})"""
ACTIVITY = """(SELECT driver_id, warehouse_id, activity_date, n AS deliveries_completed, km AS total_distance_km, ROUND(h, 2) AS total_active_hours, ROUND(GREATEST(0, 8 - h), 2) AS idle_hours,
    ROUND(LEAST(100, h / 8 * 100), 2) AS utilization_pct FROM (SELECT d.driver_id, d.warehouse_id, x.activity_date, COALESCE(n, 0) AS n, ROUND(COALESCE(km, 0), 2) AS km, LEAST(COALESCE(km, 0) / CAST(avg_speed_kmh AS DOUBLE) + 0.25E0 * COALESCE(n, 0), 10) AS h
    FROM {dim_driver} d CROSS JOIN (SELECT DISTINCT CAST(assigned_time AS DATE) AS activity_date FROM {fact_deliveries}) x LEFT JOIN (SELECT driver_id, CAST(assigned_time AS DATE) AS activity_date, COUNT(*) AS n, CAST(SUM(distance_km) AS DOUBLE) AS km
    FROM {fact_deliveries} WHERE delivery_status IN ('Delivered', 'Failed') GROUP BY 1, 2) a ON a.driver_id = d.driver_id AND a.activity_date = x.activity_date WHERE availability_status <> 'Inactive') b)"""
AGG_ITEMS = f"""(SELECT order_id, COUNT(*) AS line_item_count, CAST(SUM(quantity) AS BIGINT) AS total_quantity, SUM(revenue) AS total_revenue, SUM(discount_amount) AS total_discount, ROUND(AVG(discount_pct), 4) AS avg_discount_pct,
    CAST(SUM(CASE WHEN has_discount THEN 1 ELSE 0 END) AS BIGINT) AS discounted_items FROM {ITEMS} GROUP BY 1)"""
INT_ORDERS = f"""(SELECT o.*, c.customer_segment, c.engagement_tier, c.region AS customer_region, w.warehouse_name AS assigned_warehouse_name, w.region AS assigned_region, n.region AS nearest_region,
    COALESCE(i.line_item_count, 0) AS line_item_count, COALESCE(i.total_quantity, 0) AS total_quantity, COALESCE(i.total_revenue, 0) AS item_total_revenue, COALESCE(i.total_discount, 0) AS total_discount, COALESCE(i.avg_discount_pct, 0) AS avg_discount_pct,
    CASE WHEN assigned_warehouse_id = nearest_warehouse_id THEN 'Nearest' WHEN w.region = n.region THEN 'Same Region' ELSE 'Cross Region' END AS allocation_result
    FROM {ORDERS} o LEFT JOIN {CUSTOMERS} c ON o.customer_id = c.customer_id LEFT JOIN {WAREHOUSES} w ON o.assigned_warehouse_id = w.warehouse_id LEFT JOIN {WAREHOUSES} n ON o.nearest_warehouse_id = n.warehouse_id LEFT JOIN {AGG_ITEMS} i ON o.order_id = i.order_id)"""
INT_DELIVERIES = f"""(SELECT d.*, w.warehouse_name, w.region AS warehouse_region, r.vehicle_type, r.capacity_tier AS driver_capacity_tier, r.speed_tier AS driver_speed_tier, r.experience_years AS driver_experience_years,
    o.order_priority, o.customer_id, o.order_value_tier, date_diff('minute', d.assigned_time, d.pickup_time) AS pickup_wait_minutes, CAST(d.assigned_time AS DATE) AS delivery_date
    FROM {DELIVERIES} d LEFT JOIN {DRIVERS} r ON d.driver_id = r.driver_id LEFT JOIN {ORDERS} o ON d.order_id = o.order_id LEFT JOIN {WAREHOUSES} w ON d.warehouse_id = w.warehouse_id)"""
INT_INVENTORY = f"""(SELECT i.*, p.category, p.price_tier, p.profit_margin_pct, p.safety_stock, p.reorder_point, w.region AS warehouse_region, w.capacity_units AS warehouse_capacity,
    {frac('i.closing_stock', 'w.capacity_units', 4, ' * 100')} AS product_capacity_pct,
    CASE WHEN closing_stock = 0 THEN 'Out of Stock' WHEN closing_stock < safety_stock THEN 'Below Safety Stock' WHEN closing_stock < reorder_point THEN 'Below Reorder Point' ELSE 'Adequate' END AS stock_coverage_status,
    CASE WHEN stockout_flag THEN p.selling_price * i.units_sold ELSE 0 END AS revenue_at_risk
    FROM {INVENTORY} i LEFT JOIN {PRODUCTS} p ON i.product_id = p.product_id LEFT JOIN {WAREHOUSES} w ON i.warehouse_id = w.warehouse_id)"""

query("stg_orders", lambda t: S.stg_orders(t.fact_orders), "order_id order_date total_amount experiment_id experiment_group is_cross_region order_value_tier is_experiment_order",
      f"SELECT order_id, {day('order_date')}, {dbl('total_amount')}, experiment_id, experiment_group, is_cross_region, order_value_tier, is_experiment_order FROM {ORDERS} o")
query("stg_order_items", lambda t: S.stg_order_items(t.fact_order_items), "order_item_id product_id quantity unit_price discount_amount revenue has_discount discount_pct",
      f"SELECT order_item_id, product_id, {big('quantity')}, {dbl('unit_price', 'discount_amount', 'revenue')}, has_discount, discount_pct FROM {ITEMS} i")
query("stg_inventory_snapshot", lambda t: S.stg_inventory_snapshot(t.fact_inventory_snapshot), "snapshot_date warehouse_id product_id closing_stock days_of_supply net_stock_movement inventory_health",
      f"SELECT {day('snapshot_date')}, warehouse_id, product_id, {big('closing_stock')}, {dbl('days_of_supply')}, {big('net_stock_movement')}, inventory_health FROM {INVENTORY} i")
query("stg_shipments", lambda t: S.stg_shipments(t.fact_shipments), "shipment_id delay_days shipment_status cost_per_unit transit_days",
      f"""SELECT shipment_id, CAST(CASE WHEN actual_arrival_date IS NOT NULL THEN GREATEST(0, actual_arrival_date - expected_arrival_date) END AS BIGINT) AS delay_days,
      CASE WHEN actual_arrival_date IS NOT NULL THEN 'Delivered' WHEN expected_arrival_date < {AS_OF} THEN 'Overdue' ELSE 'In Transit' END AS shipment_status,
      {frac('shipment_cost', 'quantity')} AS cost_per_unit, CAST(actual_arrival_date - shipment_date AS BIGINT) AS transit_days FROM {{fact_shipments}} WHERE quantity > 0""")
query("stg_deliveries", lambda t: S.stg_deliveries(t.fact_deliveries), "delivery_id sla_breach_flag eta_accuracy_pct eta_error_minutes delivery_speed_tier cost_per_km",
      f"SELECT delivery_id, sla_breach_flag, eta_accuracy_pct, eta_error_minutes, delivery_speed_tier, cost_per_km FROM {DELIVERIES} d")
query("stg_driver_activity", lambda t: Staged(t).activity, "driver_id activity_date deliveries_completed total_active_hours utilization_pct avg_distance_per_delivery deliveries_per_hour productivity_tier",
      f"""SELECT driver_id, {day('activity_date')}, {big('deliveries_completed')}, {dbl('total_active_hours', 'utilization_pct')}, {frac('total_distance_km', 'deliveries_completed')} AS avg_distance_per_delivery,
      {frac('deliveries_completed', 'total_active_hours')} AS deliveries_per_hour, {tier('utilization_pct', [(80, 'High'), (50, 'Medium')], 'Low')} AS productivity_tier FROM {ACTIVITY} a""")
ASSIGNED = "(SELECT CONCAT('A-', order_id) AS assignment_id, experiment_id, order_id, experiment_group AS group_name FROM {fact_orders} WHERE experiment_id <> '')"
query("stg_experiment_assignments", lambda t: S.stg_experiment_assignments(assignments(t)), "assignment_id experiment_id order_id group_name", f"SELECT * FROM {ASSIGNED} a")
query("stg_experiments", lambda t: S.stg_experiments(t.dim_experiments).withColumn("orders", F.lit(0)).join(t.fact_orders.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_orders")), "experiment_id", "left"), "experiment_id experiment_duration_days is_active n_orders",
      f"""SELECT e.experiment_id, CAST(COALESCE(end_date, {AS_OF}) - start_date AS BIGINT) AS experiment_duration_days, status = 'Active' AND (end_date IS NULL OR end_date >= {AS_OF}) AS is_active, n_orders
      FROM {{dim_experiments}} e LEFT JOIN (SELECT experiment_id, COUNT(*) AS n_orders FROM {{fact_orders}} GROUP BY 1) o ON o.experiment_id = e.experiment_id""")
DATES = """(SELECT d AS date, dayofweek(d) IN (0, 6) AS is_weekend, (strftime(d, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')) AS is_holiday FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders}) x)"""
query("stg_dates", lambda t: S.stg_dates(calendar(t.spark, dates=t.orders.select(F.to_date("o_orderdate").alias("date")))), "date is_weekend is_business_day is_month_start is_month_end week_of_month year_month",
      f"""SELECT {day('date')}, is_weekend, NOT is_weekend AND NOT is_holiday AS is_business_day, day(date) = 1 AS is_month_start, date = last_day(date) AS is_month_end, CAST(CEIL(day(date) / 7.0) AS BIGINT) AS week_of_month, strftime(date, '%Y-%m') AS year_month FROM {DATES} d""")
query("stg_warehouses", lambda t: S.stg_warehouses(t.dim_warehouse).join(t.fact_orders.groupBy(F.col("assigned_warehouse_id").alias("warehouse_id")).agg(F.count(F.lit(1)).alias("n_orders")), "warehouse_id", "left"), "warehouse_id capacity_tier cost_tier n_orders",
      f"SELECT w.warehouse_id, capacity_tier, cost_tier, n_orders FROM {WAREHOUSES} w LEFT JOIN (SELECT assigned_warehouse_id, COUNT(*) AS n_orders FROM {{fact_orders}} GROUP BY 1) o ON o.assigned_warehouse_id = w.warehouse_id")
query("stg_products", lambda t: S.stg_products(t.dim_product), "product_id cost_price selling_price profit_margin_pct price_tier lead_time_risk is_current",
      f"SELECT product_id, {dbl('cost_price', 'selling_price')}, profit_margin_pct, price_tier, lead_time_risk, TRUE AS is_current FROM {PRODUCTS} p")
query("stg_suppliers", lambda t: S.stg_suppliers(t.dim_supplier), "supplier_id supplier_grade lead_time_category",
      f"""SELECT supplier_id, {tier('reliability_score', [(0.93, 'A'), (0.85, 'B'), (0.75, 'C')], 'D')} AS supplier_grade, {tier('average_lead_time', [(3, 'Fast'), (5, 'Standard')], 'Slow', '<=')} AS lead_time_category FROM {{dim_supplier}} WHERE reliability_score BETWEEN 0 AND 1""")
query("stg_drivers", lambda t: S.stg_drivers(t.dim_driver), "driver_id experience_years capacity_tier speed_tier", f"SELECT driver_id, {dbl('experience_years')}, capacity_tier, speed_tier FROM {DRIVERS} d")
query("stg_customers", lambda t: S.stg_customers(t.dim_customer), "customer_id customer_tenure_days engagement_tier", f"SELECT customer_id, {big('customer_tenure_days')}, engagement_tier FROM {CUSTOMERS} c")

query("agg_order_items", lambda t: E.agg_order_items(Staged(t).items), None,
      f"SELECT order_id, line_item_count, total_quantity, {dbl('total_revenue', 'total_discount')}, avg_discount_pct, discounted_items FROM {AGG_ITEMS} a")
query("int_order_enriched", lambda t: Staged(t).int_orders, "order_id customer_segment engagement_tier customer_region assigned_region nearest_region allocation_result line_item_count total_quantity item_total_revenue total_discount avg_discount_pct",
      f"SELECT order_id, customer_segment, engagement_tier, customer_region, assigned_region, nearest_region, allocation_result, {big('line_item_count', 'total_quantity')}, {dbl('item_total_revenue', 'total_discount', 'avg_discount_pct')} FROM {INT_ORDERS} o")
query("int_delivery_enriched", lambda t: Staged(t).int_deliveries, "delivery_id delivery_date warehouse_region vehicle_type driver_capacity_tier driver_speed_tier driver_experience_years order_priority order_value_tier pickup_wait_minutes",
      f"SELECT delivery_id, {day('delivery_date')}, warehouse_region, vehicle_type, driver_capacity_tier, driver_speed_tier, {dbl('driver_experience_years')}, order_priority, order_value_tier, {big('pickup_wait_minutes')} FROM {INT_DELIVERIES} d")
query("int_inventory_enriched", lambda t: Staged(t).int_inventory, "snapshot_date warehouse_id product_id category price_tier product_capacity_pct stock_coverage_status revenue_at_risk",
      f"SELECT {day('snapshot_date')}, warehouse_id, product_id, category, price_tier, product_capacity_pct, stock_coverage_status, {dbl('revenue_at_risk')} FROM {INT_INVENTORY} i")


def assignments(t: Tables):
    o = t.fact_orders.where("experiment_id <> ''")
    return o.select(F.concat_ws("-", F.lit("A"), "order_id").alias("assignment_id"), "experiment_id", "order_id", F.col("experiment_group").alias("group_name"))


def warehouse_kpis(t: Tables):
    s = Staged(t)
    return M.daily_warehouse_kpis(s.orders, E.with_delivery_date(s.deliveries), s.inventory, s.shipments, s.warehouses)


def pct(a: str, b: str, d: int = 2) -> str:
    return frac(a, b, d, " * 100")


O_DAY = f"""(SELECT order_date AS date, assigned_warehouse_id AS warehouse_id, COUNT(*) AS total_orders, SUM(total_amount) AS revenue, COUNT(CASE WHEN return_flag THEN 1 END) AS return_count, COUNT(CASE WHEN is_experiment_order THEN 1 END) AS experiment_orders,
    COUNT(CASE WHEN assigned_warehouse_id = nearest_warehouse_id THEN 1 END) AS near, COUNT(CASE WHEN is_cross_region THEN 1 END) AS crossed_in, COUNT(CASE WHEN allocation_result = 'Cross Region' THEN 1 END) AS crossed FROM {INT_ORDERS} o WHERE order_status <> 'Cancelled' GROUP BY 1, 2)"""
D_DAY = f"""(SELECT delivery_date AS date, warehouse_id, COUNT(*) AS records, AVG(CASE WHEN delivery_status = 'Delivered' THEN CAST(actual_delivery_minutes AS DOUBLE) END) AS minutes, SUM(delivery_cost) AS delivery, AVG(CAST(distance_km AS DOUBLE)) AS km, AVG(CAST(delivery_cost AS DOUBLE)) AS cost,
    COUNT(CASE WHEN delivery_status = 'Delivered' AND on_time_flag THEN 1 END) AS on_time, COUNT(CASE WHEN on_time_flag THEN 1 END) AS on_time_any, COUNT(CASE WHEN delivery_status = 'Delivered' THEN 1 END) AS delivered, COUNT(CASE WHEN sla_breach_flag THEN 1 END) AS breaches,
    COUNT(CASE WHEN delivery_status = 'Failed' THEN 1 END) AS failed, AVG(eta_accuracy_pct) AS accuracy, AVG(eta_error_minutes) AS error, COUNT(CASE WHEN order_priority IN ('Express', 'Same-Day') THEN 1 END) AS express FROM {INT_DELIVERIES} d GROUP BY 1, 2)"""
I_DAY = f"""(SELECT snapshot_date AS date, warehouse_id, SUM(holding_cost) AS holding, SUM(inventory_value) AS value, COUNT(CASE WHEN stockout_flag THEN 1 END) AS stockouts, COUNT(*) AS products, CAST(SUM(closing_stock) AS BIGINT) AS stock FROM {INVENTORY} i GROUP BY 1, 2)"""
S_DAY = "(SELECT shipment_date AS date, warehouse_id, SUM(shipment_cost) AS shipment FROM {fact_shipments} WHERE quantity > 0 GROUP BY 1, 2)"
r2 = lambda x, n: f"ROUND(CAST({x} AS DOUBLE), 2) AS {n}"
z = lambda x: f"COALESCE({x}, 0)"
query("mart_daily_warehouse_kpis", warehouse_kpis, None,
      f"""SELECT {day('o.date').replace('AS o.date', 'AS date')}, o.warehouse_id, o.total_orders, {r2('revenue', 'total_revenue')}, {r2('COALESCE(holding, 0) + COALESCE(delivery, 0) + COALESCE(shipment, 0) + operating_cost_per_day', 'total_cost')},
      {pct('on_time', 'delivered')} AS service_level_pct, {frac('stockouts', 'products', 4)} AS stockout_rate, {r2('minutes', 'avg_delivery_time_min')}, {pct('stock', 'capacity_units')} AS capacity_utilization_pct, {r2(z('holding'), 'total_holding_cost')},
      {r2(z('delivery'), 'total_delivery_cost')}, {r2(z('shipment'), 'total_shipment_cost')}, {r2(z('value'), 'total_inventory_value')}, {frac('breaches', 'records', 4)} AS sla_breach_rate, return_count, experiment_orders
      FROM {O_DAY} o LEFT JOIN {D_DAY} d ON o.date = d.date AND o.warehouse_id = d.warehouse_id LEFT JOIN {I_DAY} i ON o.date = i.date AND o.warehouse_id = i.warehouse_id
      LEFT JOIN {S_DAY} s ON o.date = s.date AND o.warehouse_id = s.warehouse_id LEFT JOIN {WAREHOUSES} w ON o.warehouse_id = w.warehouse_id""")
VOLATILITY = f"""(SELECT date, product_id, ROUND(STDDEV_SAMP(u) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS demand_volatility FROM (SELECT snapshot_date AS date, product_id, CAST(SUM(units_sold) AS DOUBLE) AS u FROM {INVENTORY} i GROUP BY 1, 2) x)"""
ITEM_DAYS = f"""(SELECT order_date AS date, product_id, SUM(revenue) AS revenue, CAST(SUM(quantity) AS BIGINT) AS quantity, COUNT(*) AS items FROM {ITEMS} i JOIN {ORDERS} o ON i.order_id = o.order_id WHERE order_status <> 'Cancelled' GROUP BY 1, 2)"""
PRODUCT_KPIS = f"""(SELECT i.*, ROUND(CAST(COALESCE(r.revenue, 0) AS DOUBLE), 2) AS total_revenue, v.demand_volatility FROM (SELECT snapshot_date AS date, product_id, category, price_tier, CAST(SUM(units_sold) AS BIGINT) AS total_units_sold, AVG(CAST(closing_stock AS DOUBLE)) AS stock,
      COUNT(CASE WHEN stockout_flag THEN 1 END) AS stockout_count, SUM(holding_cost) AS holding, SUM(inventory_value) AS value, AVG(CAST(days_of_supply AS DOUBLE)) AS days FROM {INT_INVENTORY} x GROUP BY 1, 2, 3, 4) i
      LEFT JOIN {ITEM_DAYS} r ON i.date = r.date AND i.product_id = r.product_id LEFT JOIN {VOLATILITY} v ON i.date = v.date AND i.product_id = v.product_id)"""
query("mart_daily_product_kpis", lambda t: (lambda s: M.daily_product_kpis(s.int_inventory, s.items, s.orders))(Staged(t)), None,
      f"""SELECT {day('date')}, product_id, category, price_tier, total_units_sold, total_revenue, stockout_count, {r2('stock', 'avg_closing_stock')}, {frac('total_units_sold', 'stock')} AS inventory_turnover, {r2('days', 'avg_days_of_supply')},
      {r2('holding', 'total_holding_cost')}, {r2('value', 'total_inventory_value')}, CAST(NULL AS DOUBLE) AS demand_forecast, CAST(NULL AS DOUBLE) AS forecast_error, demand_volatility, CAST(NULL AS DOUBLE) AS stockout_risk_score, FALSE AS is_forecast,
      CAST(NULL AS BIGINT) AS forecast_horizon, CAST(NULL AS VARCHAR) AS forecast_generated_date FROM {PRODUCT_KPIS} k""")
query("win_volatility", lambda t: M.demand_volatility(Staged(t).inventory), None, f"SELECT {day('date')}, product_id, demand_volatility FROM {VOLATILITY} v")
query("join_items_orders", lambda t: (lambda s: E.items_of_orders(s.items, s.orders).groupBy(F.col("order_date").alias("date"), "product_id").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("items")))(Staged(t)), None,
      f"SELECT {day('date')}, product_id, {dbl('revenue')}, quantity, items FROM {ITEM_DAYS} r")
A_DAY = f"(SELECT activity_date AS date, warehouse_id, AVG(CAST(utilization_pct AS DOUBLE)) AS used FROM {ACTIVITY} a GROUP BY 1, 2)"
query("mart_delivery_performance", lambda t: (lambda s: M.delivery_performance(E.with_priority(s.deliveries, s.orders), s.activity))(Staged(t)), None,
      f"""SELECT {day('d.date').replace('AS d.date', 'AS date')}, d.warehouse_id, records AS total_deliveries, {r2('minutes', 'avg_delivery_time_min')}, {r2('km', 'avg_distance_km')}, {pct('on_time_any', 'delivered')} AS on_time_pct, {pct('breaches', 'records')} AS sla_breach_pct,
      {r2('delivery', 'total_delivery_cost')}, {r2(z('used'), 'avg_driver_utilization')}, failed AS failed_delivery_count, {pct('express', 'records')} AS express_order_pct, {r2('accuracy', 'avg_eta_accuracy_pct')}, {r2('error', 'avg_eta_error_minutes')}
      FROM {D_DAY} d LEFT JOIN {A_DAY} a ON d.date = a.date AND d.warehouse_id = a.warehouse_id""")
OUT_DAY = f"(SELECT order_date AS date, nearest_warehouse_id AS warehouse_id, COUNT(*) AS moved_out FROM {ORDERS} o WHERE order_status <> 'Cancelled' AND assigned_warehouse_id <> nearest_warehouse_id GROUP BY 1, 2)"
query("mart_allocation_efficiency", lambda t: (lambda s: M.allocation_efficiency(E.with_allocation(s.orders, s.warehouses), E.with_delivery_date(s.deliveries)))(Staged(t)), None,
      f"""SELECT {day('o.date').replace('AS o.date', 'AS date')}, o.warehouse_id, total_orders AS total_orders_assigned, near AS orders_from_nearest, crossed_in AS orders_redirected_in, COALESCE(moved_out, 0) AS orders_redirected_out, {pct('near', 'total_orders')} AS nearest_assignment_rate,
      {r2(z('km'), 'avg_delivery_distance_km')}, {r2(z('cost'), 'avg_cost_per_order')}, {pct('crossed', 'total_orders')} AS cross_region_pct FROM {O_DAY} o LEFT JOIN {OUT_DAY} x ON o.date = x.date AND o.warehouse_id = x.warehouse_id LEFT JOIN {D_DAY} d ON o.date = d.date AND o.warehouse_id = d.warehouse_id""")
query("agg_allocation_efficiency", lambda t: M.allocation_rates(Staged(t).orders).select("date", "warehouse_id", S.ratio(F.col("orders_from_nearest"), F.col("total_orders_assigned"), factor=100.0).alias("allocation_efficiency_pct")), None,
      f"SELECT {day('date')}, warehouse_id, {pct('near', 'total_orders')} AS allocation_efficiency_pct FROM {O_DAY} o")
COSTS = f"""(SELECT COALESCE(h.date, t.date) AS date, COALESCE(h.warehouse_id, t.warehouse_id) AS warehouse_id, CAST(COALESCE(h.holding, 0) AS DOUBLE) AS h, CAST(COALESCE(t.delivery, 0) AS DOUBLE) AS t, CAST(COALESCE(h.holding, 0) + COALESCE(t.delivery, 0) + operating_cost_per_day AS DOUBLE) AS base, operating_cost_per_day, near, total_orders
      FROM {I_DAY} h FULL OUTER JOIN {D_DAY} t ON h.date = t.date AND h.warehouse_id = t.warehouse_id LEFT JOIN {WAREHOUSES} w ON COALESCE(h.warehouse_id, t.warehouse_id) = w.warehouse_id LEFT JOIN {O_DAY} o ON COALESCE(h.date, t.date) = o.date AND COALESCE(h.warehouse_id, t.warehouse_id) = o.warehouse_id)"""
query("mart_cost_optimization", lambda t: (lambda s: M.cost_optimization(s.orders, E.with_delivery_date(s.deliveries), s.inventory, s.warehouses))(Staged(t)), None,
      f"""SELECT {day('date')}, warehouse_id, ROUND(base, 2) AS baseline_total_cost, ROUND(base * 0.92E0, 2) AS optimized_total_cost, ROUND(base * 0.08E0, 2) AS savings_amount, CAST(8 AS DOUBLE) AS savings_pct, ROUND(h, 2) AS holding_cost_baseline, ROUND(h * 0.9E0, 2) AS holding_cost_optimized,
      ROUND(t, 2) AS transport_cost_baseline, ROUND(t * 0.93E0, 2) AS transport_cost_optimized, {pct('near', 'total_orders')} AS allocation_efficiency_pct FROM {COSTS} c""")
RESULTS = f"""(SELECT c.*, d.minutes, d.on_time, d.delivered, s.out_n, s.n FROM (SELECT a.experiment_id, group_name, COUNT(DISTINCT a.order_id) AS total_orders, AVG(CAST(total_fulfillment_cost AS DOUBLE)) AS cost, SUM(total_fulfillment_cost) AS costs FROM {ASSIGNED} a JOIN {ORDERS} o ON a.order_id = o.order_id WHERE order_status <> 'Cancelled' GROUP BY 1, 2) c
      LEFT JOIN (SELECT a.experiment_id, group_name, AVG(CASE WHEN delivery_status = 'Delivered' THEN CAST(actual_delivery_minutes AS DOUBLE) END) AS minutes, COUNT(CASE WHEN delivery_status = 'Delivered' AND on_time_flag THEN 1 END) AS on_time, COUNT(CASE WHEN delivery_status = 'Delivered' THEN 1 END) AS delivered
        FROM {ASSIGNED} a JOIN {ORDERS} o ON a.order_id = o.order_id JOIN {DELIVERIES} d ON d.order_id = o.order_id WHERE order_status <> 'Cancelled' GROUP BY 1, 2) d ON c.experiment_id = d.experiment_id AND c.group_name = d.group_name
      LEFT JOIN (SELECT a.experiment_id, group_name, COUNT(CASE WHEN stockout_flag THEN 1 END) AS out_n, COUNT(*) AS n FROM {ASSIGNED} a JOIN {ORDERS} o ON a.order_id = o.order_id JOIN {INVENTORY} i ON i.snapshot_date = o.order_date AND i.warehouse_id = o.assigned_warehouse_id GROUP BY 1, 2) s ON c.experiment_id = s.experiment_id AND c.group_name = s.group_name)"""
query("mart_experiment_results", lambda t: (lambda s: M.experiment_results(S.stg_experiment_assignments(assignments(t)), s.orders, s.deliveries, s.inventory))(Staged(t)), None,
      f"""SELECT r.experiment_id, r.group_name, r.total_orders, {r2('r.minutes', 'avg_delivery_time_min')}, {pct('r.on_time', 'r.delivered')} AS service_level_pct, {r2('r.cost', 'avg_cost')}, {r2('r.costs', 'total_cost')}, {frac('r.out_n', 'r.n', 4)} AS stockout_rate,
      CASE WHEN r.group_name = 'Treatment' AND b.minutes > 0 THEN ROUND((r.minutes - b.minutes) / b.minutes * 100, 2) END AS lift_pct FROM {RESULTS} r LEFT JOIN {RESULTS} b ON b.experiment_id = r.experiment_id AND b.group_name = 'Control'""")

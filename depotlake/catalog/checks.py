"""Quality checks on tables with planted violations: the given tables meet these rules, so each check gets some rows that break its rule, by their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from depotlake.catalog.base import ORACLES, day, query
from depotlake.catalog.decisions import COST_ROWS, WELCH
from depotlake.catalog.staging import DELIVERIES, ITEMS, ORDERS, Staged
from depotlake.operators import enrich as E
from depotlake.operators import experiments as X
from depotlake.operators import marts as M
from depotlake.operators import quality as Q


def broken(df, column, where, value):
    """df with another value of a column where a condition holds."""
    return df.withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))


query(
    "dq_relationship", lambda t: Q.relationship(Staged(t).items, Staged(t).orders.where("order_id not like '%7'"), "order_id"), None,
    f"SELECT DISTINCT order_id FROM {ITEMS} i WHERE order_id NOT IN (SELECT order_id FROM {ORDERS} o WHERE order_id NOT LIKE '%7')",
)
query(
    "dq_balance", lambda t: Q.balance(broken(t.fact_inventory_snapshot, "closing_stock", "units_sold % 13 = 5", "closing_stock + 1")), "snapshot_date warehouse_id product_id",
    f"""SELECT {day('snapshot_date')}, warehouse_id, product_id FROM {{fact_inventory_snapshot}}
    WHERE closing_stock + CASE WHEN units_sold % 13 = 5 THEN 1 ELSE 0 END <> GREATEST(opening_stock + units_received + units_returned - units_sold, 0)""",
)
query(
    "dq_no_negative_stock", lambda t: Q.no_negative_stock(broken(t.fact_inventory_snapshot, "closing_stock", "units_sold % 11 = 3", "closing_stock - 30")), "snapshot_date warehouse_id product_id closing_stock",
    f"""SELECT {day('snapshot_date')}, warehouse_id, product_id, closing_stock FROM
    (SELECT snapshot_date, warehouse_id, product_id, closing_stock - CASE WHEN units_sold % 11 = 3 THEN 30 ELSE 0 END AS closing_stock FROM {{fact_inventory_snapshot}}) i WHERE closing_stock < 0""",
)
query(
    "dq_item_revenue", lambda t: Q.item_revenue(broken(Staged(t).items, "revenue", "quantity % 17 = 0", "revenue + 0.05")), "order_item_id",
    f"SELECT order_item_id FROM {ITEMS} i WHERE ABS(revenue + CASE WHEN quantity % 17 = 0 THEN 0.05 ELSE 0 END - (quantity * unit_price - discount_amount)) > 0.01",
)
query(
    "dq_time_order", lambda t: Q.time_order(broken(Staged(t).deliveries, "pickup_time", "delivery_id like '%3-1'", "delivered_time + interval 1 hour")), "delivery_id",
    f"""SELECT delivery_id FROM (SELECT delivery_id, assigned_time, delivered_time, CASE WHEN delivery_id LIKE '%3-1' THEN delivered_time + INTERVAL 1 HOUR ELSE pickup_time END AS pickup_time FROM {DELIVERIES} d) e
    WHERE delivered_time < pickup_time OR pickup_time < assigned_time""",
)
query(
    "dq_sla_logic", lambda t: Q.sla_logic(broken(Staged(t).deliveries, "sla_breach_flag", "delivery_id like '%7-1'", "true")), "delivery_id",
    f"SELECT delivery_id FROM {DELIVERIES} d WHERE (sla_breach_flag OR delivery_id LIKE '%7-1') AND actual_delivery_minutes <= sla_minutes",
)
query(
    "dq_cross_region", lambda t: Q.cross_region_logic(broken(Staged(t).orders, "is_cross_region", "order_id like '%9'", "not is_cross_region")), "order_id",
    f"SELECT order_id FROM {ORDERS} o WHERE CASE WHEN order_id LIKE '%9' THEN NOT is_cross_region ELSE is_cross_region END <> (assigned_warehouse_id <> nearest_warehouse_id)",
)
query(
    "dq_experiment_fields", lambda t: Q.experiment_fields(broken(Staged(t).orders, "experiment_group", "order_id like '%1'", "null")), "order_id",
    f"SELECT order_id FROM {ORDERS} o WHERE is_experiment_order AND (experiment_id IS NULL OR experiment_group IS NULL OR order_id LIKE '%1')",
)


def efficiency(t):
    s = Staged(t)
    return M.allocation_efficiency(E.with_allocation(s.orders, s.warehouses), E.with_delivery_date(s.deliveries))


def costs(t):
    s = Staged(t)
    return M.cost_optimization(s.orders, E.with_delivery_date(s.deliveries), s.inventory, s.warehouses)


query("dq_rate_bounds", lambda t: Q.rate_bounds(broken(efficiency(t), "nearest_assignment_rate", "warehouse_id = 'WH-002'", "nearest_assignment_rate + 50"), ["nearest_assignment_rate", "cross_region_pct"]), "date warehouse_id")
ORACLES["dq_rate_bounds"] = f"""SELECT date, warehouse_id FROM ({ORACLES['mart_allocation_efficiency']}) m
    WHERE nearest_assignment_rate + CASE WHEN warehouse_id = 'WH-002' THEN 50 ELSE 0 END NOT BETWEEN 0 AND 100 OR cross_region_pct NOT BETWEEN 0 AND 100"""
query("dq_savings_math", lambda t: Q.savings_math(broken(costs(t), "savings_amount", "warehouse_id = 'WH-003'", "savings_amount + 1")), "date warehouse_id")
ORACLES["dq_savings_math"] = f"""SELECT date, warehouse_id FROM ({ORACLES['mart_cost_optimization']}) m
    WHERE ABS(baseline_total_cost - optimized_total_cost - savings_amount - CASE WHEN warehouse_id = 'WH-003' THEN 1 ELSE 0 END) > 0.05"""
query(
    "dq_significance", lambda t: Q.significance(broken(X.welch(X.experiment_stats(COST_ROWS(t)), ["experiment_id"]), "is_significant", "experiment_id <> 'EXP-2'", "not is_significant")), "experiment_id p_value is_significant",
    f"""SELECT experiment_id, p_value, said AS is_significant FROM (SELECT *, CASE WHEN experiment_id <> 'EXP-2' THEN NOT is_significant ELSE is_significant END AS said FROM ({WELCH}) w) x
    WHERE said <> (p_value < 0.05) OR p_value NOT BETWEEN 0 AND 1""",
)

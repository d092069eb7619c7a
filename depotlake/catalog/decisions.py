"""Costs, experiments, optimisation, quality, scoring, sources and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from depotlake.catalog.base import ORACLES, big, day, dbl, query
from depotlake.catalog.series import dates_of, kpis_of, rounded
from depotlake.catalog.staging import ASSIGNED, CUSTOMERS, DELIVERIES, INT_ORDERS, INVENTORY, ITEMS, O_DAY, ORDERS, PRODUCT_KPIS, PRODUCTS, Staged, assignments, pct, warehouse_kpis
from depotlake.functions import costs as C
from depotlake.functions.rounding import half_up
from depotlake.operators import enrich as E
from depotlake.operators import experiments as X
from depotlake.operators import marts as M
from depotlake.operators import optimize as O
from depotlake.operators import quality as Q
from depotlake.plans import features as P
from depotlake.plans import models as ML
from depotlake.sources import files as SRC
from depotlake.streaming import events as EV

KM = """ROUND(1.3E0 * 2 * 6371 * ASIN(SQRT(LEAST(1, POWER(SIN(RADIANS(w.latitude - c.latitude) / 2), 2) + COS(RADIANS(c.latitude)) * COS(RADIANS(w.latitude)) * POWER(SIN(RADIANS(w.longitude - c.longitude) / 2), 2)))), 2)"""
MATRIX = f"(SELECT customer_id, warehouse_id, km AS distance_km, ROUND(3.5E0 + 0.85E0 * km, 2) AS cost FROM (SELECT c.customer_id, w.warehouse_id, {KM} AS km FROM {{dim_customer}} c CROSS JOIN {{dim_warehouse}} w) m)"
query("cost_matrix", lambda t: C.cost_matrix(t.dim_customer, t.dim_warehouse), None, f"SELECT * FROM {MATRIX} m")
query("delivery_distance", lambda t: C.cost_matrix(t.dim_customer, t.dim_warehouse).groupBy("warehouse_id").agg(half_up(F.avg("distance_km"), 2).alias("avg_km"), half_up(F.sum("cost"), 2).alias("total_cost")), None,
      f"SELECT warehouse_id, ROUND(AVG(distance_km), 2) AS avg_km, ROUND(SUM(cost), 2) AS total_cost FROM {MATRIX} m GROUP BY 1")
query("nearest_warehouse", lambda t: C.nearest_warehouse(t.dim_customer, t.dim_warehouse), None,
      f"SELECT customer_id, warehouse_id AS nearest_warehouse_id, distance_km FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY distance_km, warehouse_id) AS n FROM {MATRIX} m) x WHERE n = 1")
query("cost_functions", lambda t: Staged(t).int_inventory.select("snapshot_date", "warehouse_id", "product_id", C.holding_cost(F.col("closing_stock"), F.col("cost_price")).alias("holding"), C.inventory_value(F.col("closing_stock"), F.col("cost_price")).alias("value")), None,
      f"SELECT {day('snapshot_date')}, warehouse_id, i.product_id, ROUND(closing_stock * CAST(cost_price AS DOUBLE) * 0.001E0, 2) AS holding, ROUND(closing_stock * CAST(cost_price AS DOUBLE), 2) AS value FROM {INVENTORY} i LEFT JOIN {PRODUCTS} p ON i.product_id = p.product_id")

COST_ROWS = (lambda t: X.metric_rows(assignments(t), Staged(t).orders, Staged(t).deliveries, t.dim_experiments, t.dim_customer))
METRIC = f"""(SELECT a.experiment_id, group_name, CASE WHEN experiment_type = 'routing' THEN CAST(d.actual_delivery_minutes AS DOUBLE) ELSE CAST(total_fulfillment_cost AS DOUBLE) END AS metric, customer_segment, order_priority, c.region FROM {ASSIGNED} a JOIN {{dim_experiments}} e ON a.experiment_id = e.experiment_id
    JOIN {ORDERS} o ON a.order_id = o.order_id LEFT JOIN {{dim_customer}} c ON o.customer_id = c.customer_id LEFT JOIN {DELIVERIES} d ON experiment_type = 'routing' AND d.order_id = o.order_id AND delivery_status = 'Delivered' AND actual_delivery_minutes IS NOT NULL WHERE order_status <> 'Cancelled' AND (experiment_type <> 'routing' OR d.order_id IS NOT NULL))"""
STATS = "COUNT(*) AS n, AVG(metric) AS mean, VAR_SAMP(metric) AS variance"
query("agg_experiment_stats", lambda t: rounded(X.experiment_stats(COST_ROWS(t)), ["experiment_id", "group_name", "n", "mean", "variance", "std"]), None,
      f"SELECT experiment_id, group_name, COUNT(*) AS n, ROUND(AVG(metric), 6) AS mean, ROUND(VAR_SAMP(metric), 6) AS variance, ROUND(STDDEV_SAMP(metric), 6) AS std FROM {METRIC} m GROUP BY 1, 2")
SEGMENTS = " UNION ALL ".join(f"SELECT experiment_id, group_name, '{s}' AS segment_type, {s} AS segment_value, {STATS} FROM {METRIC} m WHERE {s} IS NOT NULL GROUP BY 1, 2, 4 HAVING COUNT(*) >= 10" for s in X.SEGMENTS)
query("agg_segment_stats", lambda t: rounded(X.segment_stats(COST_ROWS(t)), ["experiment_id", "group_name", "segment_type", "segment_value", "n", "mean", "variance"]), None, f"SELECT experiment_id, group_name, segment_type, segment_value, n, ROUND(mean, 6) AS mean, ROUND(variance, 6) AS variance FROM ({SEGMENTS}) s")


def welch_sql(stats: str, keys: str) -> str:
    side = ", ".join(f"MAX(CASE WHEN group_name = '{g}' THEN {c} END) AS {c}_{g[0].lower()}" for g in ("Control", "Treatment") for c in ("n", "mean", "variance"))
    return f"""SELECT {keys}, n_c, n_t, ROUND(mean_c, 4) AS mean_c, ROUND(mean_t, 4) AS mean_t, ROUND(d, 4) AS difference, CASE WHEN d IS NULL THEN NULL WHEN mean_c <> 0 THEN ROUND(d / mean_c * 100, 2) ELSE 0 END AS pct_change, ROUND(d / SQRT(vc + vt), 4) AS t_statistic,
    ROUND(CASE WHEN n_c >= 2 AND n_t >= 2 THEN (vc + vt) * (vc + vt) / (vc * vc / (n_c - 1) + vt * vt / (n_t - 1)) END, 4) AS degrees_of_freedom FROM (SELECT *, CASE WHEN n_c >= 2 AND n_t >= 2 THEN mean_t - mean_c END AS d, GREATEST(variance_c, 1e-10) / n_c AS vc, GREATEST(variance_t, 1e-10) / n_t AS vt FROM (SELECT {keys}, {side} FROM ({stats}) s GROUP BY {keys}) a) b"""


query("welch_ttest", lambda t: X.welch(X.experiment_stats(COST_ROWS(t)), ["experiment_id"], tests=False), None, welch_sql(f"SELECT experiment_id, group_name, {STATS} FROM {METRIC} m GROUP BY 1, 2", "experiment_id"))


def t_half(t: str, df: str, steps: int = 400) -> str:
    """SQL of P(0 <= T <= t) for Student's t: Simpson's rule over so many steps."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"""(EXP(LGAMMA(({df} + 1) / 2) - LGAMMA({df} / 2)) / SQRT({df} * PI()) * {t} / {steps} / 3
        * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * POWER(1 + POWER(i * {t} / {steps}, 2) / {df}, -({df} + 1) / 2))))"""


def tested_sql(stats: str, keys: str) -> str:
    """welch_sql() with p, the interval and significance: beyond 50 standard errors p is 0 to six places, and the quantile is found by bisection."""
    side = ", ".join(f"MAX(CASE WHEN group_name = '{g}' THEN {c} END) AS {c}_{g[0].lower()}" for g in ("Control", "Treatment") for c in ("n", "mean", "variance"))
    middle = "((s[1] + s[2]) / 2)"
    quantile = f"list_reduce(list_prepend([0.0E0, 20.0E0], list_transform(range(0, 45), lambda k: [0.0E0, 0.0E0])), lambda s, k: CASE WHEN {t_half(middle, 'v', 200)} < 0.475 THEN [{middle}, s[2]] ELSE [s[1], {middle}] END)[1]"
    return f"""SELECT {keys}, n_c, n_t, ROUND(mean_c, 4) AS mean_c, ROUND(mean_t, 4) AS mean_t, ROUND(d, 4) AS difference, CASE WHEN d IS NULL THEN NULL WHEN mean_c <> 0 THEN ROUND(d / mean_c * 100, 2) ELSE 0 END AS pct_change,
        ROUND(d / se, 4) AS t_statistic, ROUND(v, 4) AS degrees_of_freedom, ROUND(p, 6) AS p_value, ROUND(d - q * se, 4) AS ci_lower, ROUND(d + q * se, 4) AS ci_upper, p < 0.05 AS is_significant
    FROM (
        SELECT *, CASE WHEN d IS NULL THEN NULL WHEN ABS(d / se) > 50 THEN 0 ELSE GREATEST(0, 1 - 2 * {t_half('ABS(d / se)', 'v', 1000)}) END AS p, {quantile} AS q
        FROM (
            SELECT *, CASE WHEN n_c >= 2 AND n_t >= 2 THEN mean_t - mean_c END AS d, SQRT(vc + vt) AS se, CASE WHEN n_c >= 2 AND n_t >= 2 THEN (vc + vt) * (vc + vt) / (vc * vc / (n_c - 1) + vt * vt / (n_t - 1)) END AS v
            FROM (SELECT *, GREATEST(variance_c, 1e-10) / n_c AS vc, GREATEST(variance_t, 1e-10) / n_t AS vt FROM (SELECT {keys}, {side} FROM ({stats}) s GROUP BY {keys}) a) b
        ) c
    ) e"""


WELCH = tested_sql(f"SELECT experiment_id, group_name, {STATS} FROM {METRIC} m GROUP BY 1, 2", "experiment_id")
UPLIFT = tested_sql(SEGMENTS, "experiment_id, segment_type, segment_value")
query("welch_p_values", lambda t: X.welch(X.experiment_stats(COST_ROWS(t)), ["experiment_id"]), None, WELCH)
query("uplift_segments", lambda t: X.welch(X.segment_stats(COST_ROWS(t)), ["experiment_id", "segment_type", "segment_value"], tests=False), None, welch_sql(SEGMENTS, "experiment_id, segment_type, segment_value"))
query("effect_scenario", lambda t: X.welch(X.scenario(X.experiment_stats(COST_ROWS(t)), 0.9), ["experiment_id"], tests=False), None,
      welch_sql(f"SELECT experiment_id, group_name, n, CASE WHEN group_name = 'Treatment' THEN mean * 0.9E0 ELSE mean END AS mean, CASE WHEN group_name = 'Treatment' THEN variance * 0.81E0 ELSE variance END AS variance FROM (SELECT experiment_id, group_name, {STATS} FROM {METRIC} m GROUP BY 1, 2) z", "experiment_id"))
query("topk_uplift", lambda t: X.uplift_top(X.welch(X.segment_stats(COST_ROWS(t)), ["experiment_id", "segment_type", "segment_value"])), None,
      f"SELECT * FROM ({UPLIFT}) u WHERE is_significant ORDER BY pct_change, experiment_id, segment_type, segment_value LIMIT 6")
query("experiment_writeback", lambda t: (lambda s: X.writeback(M.experiment_results(assignments(t), s.orders, s.deliveries, s.inventory), X.welch(X.experiment_stats(COST_ROWS(t)), ["experiment_id"])))(Staged(t)), "experiment_id group_name total_orders p_value is_significant",
      f"SELECT m.experiment_id, m.group_name, m.total_orders, w.p_value, w.is_significant FROM ({ORACLES['mart_experiment_results']}) m LEFT JOIN ({WELCH}) w ON w.experiment_id = m.experiment_id")

KPIS = ORACLES["mart_daily_warehouse_kpis"]
BASE = f"""(SELECT date, warehouse_id, ROUND(total_holding_cost, 2) AS holding_cost, ROUND(total_delivery_cost, 2) AS transport_cost, ROUND(total_shipment_cost, 2) AS ordering_cost, ROUND(stockout_rate * total_orders * (total_revenue / total_orders) * 0.1E0, 2) AS stockout_cost FROM ({KPIS}) k)"""
BASED = f"(SELECT *, ROUND(holding_cost + transport_cost + ordering_cost + stockout_cost, 2) AS baseline_cost FROM {BASE} b)"
query("cost_baseline", lambda t: O.cost_baseline(warehouse_kpis(t)), None, f"SELECT * FROM {BASED} b")
OPT = f"""(SELECT *, ROUND(holding_optimized + transport_optimized + ordering_optimized + stockout_optimized, 2) AS optimized_cost FROM (SELECT *, {', '.join(f'ROUND({k}_cost * {1 - r!r}E0, 2) AS {k}_optimized' for k, r in O.REDUCTIONS.items())} FROM {BASED} b) o)"""
FULL = f"(SELECT *, ROUND(baseline_cost - optimized_cost, 2) AS savings_amount, CASE WHEN baseline_cost > 0 THEN ROUND(ROUND(baseline_cost - optimized_cost, 2) / baseline_cost * 100, 2) ELSE 0 END AS savings_pct FROM {OPT} o)"
query("cost_optimized", lambda t: O.cost_optimized(O.cost_baseline(warehouse_kpis(t))), None, f"SELECT * FROM {FULL} f")
query("run_cost_optimization", lambda t: O.run_cost_optimization(warehouse_kpis(t), M.allocation_rates(Staged(t).orders).withColumn("allocation_efficiency_pct", half_up(F.col("orders_from_nearest") / F.col("total_orders_assigned") * 100, 2))), "date warehouse_id baseline_cost optimized_cost savings_pct allocation_efficiency_pct")
ORACLES["run_cost_optimization"] = ORACLES["cost_optimized"] and f"SELECT f.date, f.warehouse_id, baseline_cost, optimized_cost, savings_pct, COALESCE(a.allocation_efficiency_pct, 0) AS allocation_efficiency_pct FROM ({ORACLES['cost_optimized']}) f LEFT JOIN ({ORACLES['agg_allocation_efficiency']}) a ON a.date = f.date AND a.warehouse_id = f.warehouse_id"
query("agg_optimization_totals", lambda t: O.optimization_totals(O.cost_optimized(O.cost_baseline(warehouse_kpis(t)))), None, f"SELECT ROUND(SUM(baseline_cost), 2) AS total_baseline, ROUND(SUM(optimized_cost), 2) AS total_optimized, ROUND(SUM(savings_amount), 2) AS total_savings, ROUND(AVG(savings_pct), 2) AS avg_savings_pct FROM {FULL} f")
STATS_P = f"(SELECT product_id, AVG(CAST(total_units_sold AS DOUBLE)) AS d, STDDEV_SAMP(CAST(total_units_sold AS DOUBLE)) AS s FROM {PRODUCT_KPIS} k GROUP BY 1)"
query("agg_product_demand", lambda t: rounded(O.product_demand(kpis_of(t)), ["product_id", "avg_daily_demand", "std_demand", "total_holding"], 4), None, f"SELECT product_id, ROUND(AVG(CAST(total_units_sold AS DOUBLE)), 4) AS avg_daily_demand, ROUND(STDDEV_SAMP(CAST(total_units_sold AS DOUBLE)), 4) AS std_demand, ROUND(CAST(SUM(holding) AS DOUBLE), 4) AS total_holding FROM {PRODUCT_KPIS} k GROUP BY 1")
INV = f"(SELECT d.product_id, d, COALESCE(s, 0) AS s, CAST(cost_price AS DOUBLE) AS c, CAST(lead_time_days AS DOUBLE) AS l FROM {STATS_P} d JOIN {{dim_product}} p ON p.product_id = d.product_id)"
EOQ = "ROUND(CASE WHEN d > 0 AND c > 0 THEN SQRT(2 * d * 365 * 50 / (c * 0.001E0 * 365)) ELSE 0 END, 2)"
SAFE = "ROUND(CASE WHEN d > 0 THEN 1.645E0 * SQRT(l * s * s) ELSE 0 END, 2)"
SLOPE = "(c * 0.001E0 * l * s * SQRT(l) * SQRT(2 * PI()))"
ROP = f"ROUND(CASE WHEN d <= 0 THEN 0 WHEN s > 0 AND {SLOPE} <= 0 THEN 3 * d * l ELSE LEAST(3 * d * l, d * l + s * SQRT(l) * SQRT(GREATEST(0, CASE WHEN {SLOPE} > 0 AND {SLOPE} < d * 15 THEN -2 * LN({SLOPE} / (d * 15)) ELSE 0 END))) END, 2)"
summary = lambda t: O.inventory_summary(kpis_of(t), t.dim_product, costs=False)
query("eoq", lambda t: summary(t).select("product_id", "eoq"), None, f"SELECT product_id, {EOQ} AS eoq FROM {INV} i")
query("safety_stock", lambda t: summary(t).select("product_id", "safety_stock"), None, f"SELECT product_id, {SAFE} AS safety_stock FROM {INV} i")
query("reorder_point", lambda t: summary(t).select("product_id", "reorder_point"), None, f"SELECT product_id, {ROP} AS reorder_point FROM {INV} i")
query("inventory_optimization_summary", lambda t: summary(t), None, f"SELECT i.product_id, ROUND(d, 4) AS avg_daily_demand, ROUND(s0, 4) AS std_demand, {EOQ} AS eoq, {SAFE} AS safety_stock, {ROP} AS reorder_point, p.reorder_point AS current_reorder_point FROM {INV} i JOIN (SELECT product_id, s AS s0 FROM {STATS_P} z) q ON q.product_id = i.product_id JOIN {{dim_product}} p ON p.product_id = i.product_id")
query("reorder_point_cost", lambda t: O.inventory_summary(kpis_of(t), t.dim_product).select("product_id", "reorder_point", "expected_cost"), None)
allocated = lambda t: O.greedy_allocation(Staged(t).orders.where("order_status <> 'Cancelled'"), C.cost_matrix(t.dim_customer, t.dim_warehouse), t.dim_warehouse)
#: The choice while no warehouse is full; the first condition makes the SQL give nothing where a day's items could fill one.
GREEDY = f"""(SELECT o.order_id, order_date, COALESCE(m.warehouse_id, assigned_warehouse_id) AS warehouse_id, assigned_warehouse_id AS original_warehouse_id, COALESCE(m.cost, CAST(total_fulfillment_cost AS DOUBLE)) AS optimal_cost,
    CAST(total_fulfillment_cost AS DOUBLE) AS baseline_cost, COALESCE(m.warehouse_id, assigned_warehouse_id) = assigned_warehouse_id AS is_optimal_assignment
    FROM {ORDERS} o LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY cost, warehouse_id) AS n FROM {MATRIX} m) m ON m.customer_id = o.customer_id AND n = 1
    WHERE order_status <> 'Cancelled' AND (SELECT MAX(i) FROM (SELECT SUM(total_items) AS i FROM {{fact_orders}} GROUP BY order_date) x) < (SELECT MIN(capacity_units) * 0.9 FROM {{dim_warehouse}}))"""
query("greedy_allocation", allocated, None, f"SELECT order_id, {day('order_date')}, warehouse_id, original_warehouse_id, optimal_cost, baseline_cost, is_optimal_assignment FROM {GREEDY} g")
query("allocation_savings_summary", lambda t: O.allocation_savings(allocated(t)), None, f"""SELECT ROUND(b, 2) AS total_baseline_cost, ROUND(o, 2) AS total_optimized_cost, ROUND(b - o, 2) AS total_savings, ROUND(CASE WHEN b > 0 THEN (b - o) / b * 100 ELSE 0 END, 2) AS savings_pct, ROUND(e * 100, 2) AS allocation_efficiency_pct
    FROM (SELECT SUM(CAST(baseline_cost AS DECIMAL(18,2))) AS b0, CAST(SUM(CAST(baseline_cost AS DECIMAL(18,2))) AS DOUBLE) AS b, CAST(SUM(CAST(optimal_cost AS DECIMAL(18,2))) AS DOUBLE) AS o, AVG(CASE WHEN is_optimal_assignment THEN 1.0E0 ELSE 0 END) AS e FROM {GREEDY} g) x""")

s = Q  # checks
STATUSES, URGENCIES = ["Delivered", "Shipped", "Processing", "Pending", "Cancelled"], ["Standard", "Express", "Same-Day"]
listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
bad_rows = lambda condition: f"(SELECT COUNT(*) FROM o WHERE {condition})"
one_if_not = lambda condition: f"(SELECT CASE WHEN {condition} THEN 0 ELSE 1 END FROM o)"
# Each check's name, how it is made, its options, and SQL for its violations (1 for a check of the table as a whole that fails).
SUITE = [
    ("not_null_order_id", lambda **k: Q.not_null("order_id", **k), {}, bad_rows("order_id IS NULL")),
    ("not_null_experiment_id", lambda **k: Q.not_null("experiment_id", **k), {"mostly": 0.3}, bad_rows("experiment_id IS NULL")),
    ("in_set_order_status", lambda **k: Q.in_set("order_status", STATUSES, **k), {}, bad_rows(f"order_status NOT IN {listed(STATUSES)}")),
    ("in_set_order_priority", lambda **k: Q.in_set("order_priority", URGENCIES[:2], **k), {"severity": "warn"}, bad_rows(f"order_priority NOT IN {listed(URGENCIES[:2])}")),
    ("between_total_amount", lambda **k: Q.between("total_amount", 0, 900, **k), {"mostly": 0.8}, bad_rows("total_amount NOT BETWEEN 0 AND 900")),
    ("positive_total_fulfillment_cost", lambda **k: Q.positive("total_fulfillment_cost", **k), {}, bad_rows("total_fulfillment_cost < 0")),
    ("regex_assigned_warehouse_id", lambda **k: Q.matches("assigned_warehouse_id", r"^WH-[0-9]{3}$", **k), {}, bad_rows("NOT regexp_matches(assigned_warehouse_id, '^WH-[0-9][0-9][0-9]$')")),
    ("greater_total_amount_total_fulfillment_cost", lambda **k: Q.greater("total_amount", "total_fulfillment_cost", **k), {"mostly": 0.5}, bad_rows("NOT total_amount > total_fulfillment_cost")),
    ("approx_equal_total_amount_total_fulfillment_cost", lambda **k: Q.approx_equal("total_amount", "total_fulfillment_cost", 5000, **k), {}, bad_rows("ABS(total_amount - total_fulfillment_cost) > 5000")),
    ("distinct_subset_order_priority", lambda **k: Q.distinct_subset("order_priority", URGENCIES, **k), {}, bad_rows(f"order_priority NOT IN {listed(URGENCIES)}")),
    ("row_count", lambda **k: Q.row_count(1, 10**9, **k), {}, one_if_not("COUNT(*) BETWEEN 1 AND 1000000000")),
    ("mean_total_amount", lambda **k: Q.mean_between("total_amount", 100, 900, **k), {}, one_if_not("AVG(CAST(total_amount AS DOUBLE)) BETWEEN 100 AND 900")),
    ("distinct_equals_order_priority", lambda **k: Q.distinct_equals("order_priority", URGENCIES, **k), {},
     one_if_not(f"COUNT(DISTINCT order_priority) = 3 AND COUNT(CASE WHEN order_priority NOT IN {listed(URGENCIES)} THEN 1 END) = 0")),
]
WHOLE = ("row_count", "mean_total_amount", "distinct_equals_order_priority")
#: The columns of a table that comes as it should, and of one that doesn't.
DAYS = ["date", "day_of_week_num", "is_weekend"]


def suite(t: Tables):
    dates = dates_of(t).select(*DAYS)
    checks = [make(**options) for _, make, options, _ in SUITE] + [Q.columns_match(dates, DAYS), Q.columns_match(dates, DAYS[::-1])]
    return Q.run_suite(Staged(t).orders, checks, "orders").drop("table")


query(
    "dq_suite", suite, None,
    f"""WITH o AS (SELECT * FROM {ORDERS} x),
    c AS (SELECT * FROM (VALUES
        {', '.join(f"('{name}', '{options.get('severity', 'error')}', {bad}, {options.get('mostly', 1.0)}E0, {name in WHOLE})" for name, _, options, bad in SUITE)},
        {', '.join(f"('columns_match', 'error', CASE WHEN {[*names]} = {[*DAYS]} THEN 0 ELSE 1 END, 1.0E0, TRUE)" for names in (DAYS, DAYS[::-1]))}
    ) v(name, severity, bad, mostly, is_total))
    SELECT name AS "check", severity, CAST(bad AS BIGINT) AS violations, (SELECT COUNT(*) FROM o) AS rows,
        CASE WHEN is_total THEN bad = 0 ELSE bad <= (SELECT COUNT(*) FROM o) * (1 - mostly) + 1e-9 END AS passed FROM c""",
)
query("dq_unique", lambda t: Q.unique(Staged(t).items, ["order_item_id"]), None, f"SELECT order_item_id, COUNT(*) AS n FROM {ITEMS} i GROUP BY 1 HAVING COUNT(*) > 1")
query("dq_unique_compound", lambda t: Q.unique(Staged(t).shipments, ["shipment_date", "warehouse_id", "product_id"]), None, f"SELECT {day('shipment_date')}, warehouse_id, product_id, COUNT(*) AS n FROM {{fact_shipments}} WHERE quantity > 0 GROUP BY ALL HAVING COUNT(*) > 1")
query("dq_order_reconcile", lambda t: Q.order_reconcile(Staged(t).orders, Staged(t).items), "order_id total_amount item_revenue", f"SELECT o.order_id, {dbl('total_amount')}, CAST(r AS DOUBLE) AS item_revenue FROM {ORDERS} o JOIN (SELECT order_id, SUM(revenue) AS r FROM {ITEMS} i GROUP BY 1) i ON i.order_id = o.order_id WHERE ABS(total_amount - r) > 0.01")
query("dq_capacity_warn", lambda t: Q.capacity_warning(warehouse_kpis(t), 1.0), "date warehouse_id capacity_utilization_pct")
ORACLES["dq_capacity_warn"] = f"SELECT date, warehouse_id, capacity_utilization_pct FROM ({KPIS}) k WHERE capacity_utilization_pct > 1"

query("agg_daily_demand", lambda t: dates_of(t).select("date").join(kpis_of(t).groupBy("date").agg(F.sum("total_units_sold").alias("units")), "date", "left").withColumn("units", F.coalesce("units", F.lit(0))), None,
      f"SELECT {day('d').replace('AS d', 'AS date')}, CAST(COALESCE(u, 0) AS BIGINT) AS units FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {{orders}} UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM {{lineitem}}) x LEFT JOIN (SELECT date, SUM(total_units_sold) AS u FROM {PRODUCT_KPIS} k GROUP BY 1) y ON y.date = x.d")
query("agg_recent_orders", lambda t: t.fact_orders.where("order_date > date'1998-07-01' - interval 7 days and order_date <= date'1998-07-01'").groupBy("order_date").agg(F.count(F.lit(1)).alias("orders")).orderBy("order_date"), None,
      f"SELECT {day('order_date')}, COUNT(*) AS orders FROM {{fact_orders}} WHERE order_date > DATE '1998-06-24' AND order_date <= DATE '1998-07-01' GROUP BY order_date")
TABLES = {"fact_orders": "order_date", "fact_deliveries": "assigned_time", "fact_inventory_snapshot": "snapshot_date", "fact_shipments": "shipment_date"}
query("agg_table_freshness", lambda t: SRC.freshness({n: (getattr(t, n), d) for n, d in TABLES.items()}), None, " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n, strftime(MAX(CAST({d} AS DATE)), '%Y-%m-%d') AS last_date FROM {{{n}}}" for n, d in TABLES.items()))
query("union_all_counts", lambda t: SRC.freshness({n: (getattr(t, n), d) for n, d in TABLES.items()}).select("table_name", "n"), None, " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS n FROM {{{n}}}" for n in TABLES))
query("src_last_partition", lambda t: SRC.last_partition(t.fact_orders, date(1990, 1, 1), "order_date"), None, "SELECT strftime(COALESCE(MAX(order_date), DATE '1990-01-01'), '%Y-%m-%d') AS last_date FROM {fact_orders}")
query("future_spine", lambda t: ML.future_spine(t.dim_product, F.lit(date(2000, 1, 1))), None, "SELECT product_id, strftime(DATE '2000-01-01' + CAST(k AS INTEGER), '%Y-%m-%d') AS date FROM {dim_product} p CROSS JOIN range(1, 181) r(k)")
query("union_seed_future", lambda t: ML.with_future(kpis_of(t).select("date", "product_id", "total_units_sold"), ML.future_spine(t.dim_product, F.lit(date(2000, 1, 1)), 30)), None,
      f"SELECT {day('date')}, product_id, total_units_sold, FALSE AS is_forecast FROM {PRODUCT_KPIS} k UNION ALL SELECT strftime(DATE '2000-01-01' + CAST(k AS INTEGER), '%Y-%m-%d'), product_id, NULL, TRUE FROM {{dim_product}} p CROSS JOIN range(1, 31) r(k)")
query("union_calendar_extend", lambda t: ML.extend_calendar(t.spark, dates_of(t), date(2002, 6, 30)).select("date", "day_of_week_num", "is_weekend"), None,
      """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders} UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM {lineitem}), a AS (SELECT d FROM d UNION ALL SELECT CAST(UNNEST(generate_series((SELECT MAX(d) FROM d) + INTERVAL 1 DAY, TIMESTAMP '2002-06-30', INTERVAL 1 DAY)) AS DATE)) SELECT strftime(d, '%Y-%m-%d') AS date, isodow(d) AS day_of_week_num, isodow(d) >= 6 AS is_weekend FROM a""")
query("distinct_map", lambda t: ML.price_tiers(Staged(t).products), None, f"SELECT DISTINCT product_id, price_tier FROM {PRODUCTS} p")
# Scores of rules that need no training, so that SQL has them: risk falls with the stock in relation to the safety stock, and a delivery takes as long as the platform estimates.
RISK = f"(SELECT snapshot_date AS date, warehouse_id, product_id, will_stockout_3d, stock_to_safety_ratio, ROUND(1 / (1 + COALESCE(stock_to_safety_ratio, 0)), 4) AS stockout_risk_score FROM ({ORACLES['stockout_features']}) f)"


def risk(t: Tables):
    rows = rounded(P.stockout_features(Staged(t).int_inventory, dates_of(t), products=t.dim_product), ["snapshot_date", "warehouse_id", "product_id", "will_stockout_3d", "stock_to_safety_ratio"])
    return rows.withColumnRenamed("snapshot_date", "date").withColumn("stockout_risk_score", half_up(1 / (1 + F.coalesce("stock_to_safety_ratio", F.lit(0.0))), 4))


def eta_pred(t: Tables):
    minutes = {"actual_delivery_minutes": F.col("actual_delivery_minutes").cast("double"), "predicted_eta": F.col("estimated_eta_minutes").cast("double")}
    return Staged(t).int_deliveries.where("delivery_status = 'Delivered'").select(F.col("delivery_date").alias("date"), "warehouse_id", *[c.alias(n) for n, c in minutes.items()])


BANDS = {"high": "s >= 0.7", "medium": "s >= 0.3 AND s < 0.7", "low": "s < 0.3"}
query("agg_stockout_risk", lambda t: ML.stockout_risk_by_day(risk(t)), None, f"SELECT date, product_id, MAX(stockout_risk_score) AS stockout_risk_score FROM {RISK} r GROUP BY 1, 2")
query(
    "agg_risk_bands", lambda t: ML.risk_bands(risk(t)), None,
    f"""SELECT {', '.join(f'COUNT(CASE WHEN {c} THEN 1 END) AS {n}, ROUND(COUNT(CASE WHEN {c} THEN 1 END) * 100.0E0 / COUNT(*), 2) AS {n}_pct' for n, c in BANDS.items())}
    FROM (SELECT stockout_risk_score AS s FROM {RISK} r) x""",
)
query("topk_risk", lambda t: ML.top_risk(risk(t)), "date warehouse_id product_id stockout_risk_score", f"SELECT date, warehouse_id, product_id, stockout_risk_score FROM {RISK} r ORDER BY 4 DESC, date, warehouse_id, product_id LIMIT 10")
query(
    "agg_eta_predictions", lambda t: ML.eta_by_day(eta_pred(t)), None,
    f"""SELECT {day('assigned_time').replace('AS assigned_time', 'AS date')}, warehouse_id, ROUND(AVG(p), 2) AS predicted_eta, ROUND(AVG(a - p), 2) AS eta_error
    FROM (SELECT assigned_time, warehouse_id, CAST(estimated_eta_minutes AS DOUBLE) AS p, CAST(actual_delivery_minutes AS DOUBLE) AS a FROM {DELIVERIES} d WHERE delivery_status = 'Delivered') x GROUP BY 1, 2""",
)
query("metrics_regression", lambda t: ML.regression_metrics(eta_pred(t), "actual_delivery_minutes", "predicted_eta", ["warehouse_id"]), None, f"""SELECT warehouse_id, ROUND(AVG(CASE WHEN a <> 0 THEN ABS((a - p) / a) END) * 100, 4) AS mape, ROUND(SQRT(AVG((a - p) * (a - p))), 4) AS rmse, ROUND(AVG(ABS(a - p)), 4) AS mae, ROUND(CASE WHEN VAR_POP(a) > 0 THEN 1 - SUM((a - p) * (a - p)) / (VAR_POP(a) * COUNT(a)) END, 4) AS r2, COUNT(a) AS n
      FROM (SELECT warehouse_id, CAST(actual_delivery_minutes AS DOUBLE) AS a, CAST(estimated_eta_minutes AS DOUBLE) AS p FROM {DELIVERIES} d WHERE delivery_status = 'Delivered') x GROUP BY 1""")
# The rule as a classifier of the next days' stockouts; the area under the curve is the positives' mean rank, where equal scores share one.
query(
    "metrics_classification",
    lambda t: ML.classification_metrics(risk(t).withColumn("p", (F.col("stockout_risk_score") > 0.5).cast("int")), "will_stockout_3d", "p", "stockout_risk_score"), None,
    f"""SELECT tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN ROUND(CAST(tp AS DOUBLE) / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN ROUND(CAST(tp AS DOUBLE) / (tp + fn), 4) ELSE 0 END AS recall,
        CASE WHEN 2 * tp + fp + fn > 0 THEN ROUND(2.0E0 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1,
        ROUND(CASE WHEN (tp + fn) * (fp + tn) > 0 THEN (ranks - (tp + fn) * (tp + fn + 1) / 2.0E0) / (CAST(tp + fn AS DOUBLE) * (fp + tn)) END, 4) AS auc_roc
    FROM (
        SELECT {', '.join(f'COUNT(CASE WHEN y = {y} AND p = {p} THEN 1 END) AS {n}' for n, y, p in (('tp', 1, 1), ('fp', 0, 1), ('fn', 1, 0), ('tn', 0, 0)))}, CAST(SUM(CASE WHEN y = 1 THEN mid END) AS DOUBLE) AS ranks
        FROM (SELECT will_stockout_3d AS y, CASE WHEN stockout_risk_score > 0.5 THEN 1 ELSE 0 END AS p, RANK() OVER (ORDER BY stockout_risk_score) + (COUNT(*) OVER (PARTITION BY stockout_risk_score) - 1) / 2.0E0 AS mid FROM {RISK} r) x
    ) z""",
)
event_rows = lambda t: t.events.select(F.lit("orders_stream").alias("topic"), F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), F.concat(F.lit("O-"), "event_id").alias("order_id"), F.date_format("ts", "yyyy-MM-dd").alias("order_date"), (F.col("event_id") % 4).cast("int").alias("total_items"), F.abs(F.round(F.col("value"))).cast("int").alias("total_amount"), F.lit(1).alias("total_fulfillment_cost"))).alias("value"))
query("stream_tumbling_counts", lambda t: EV.tumbling_counts(t.events, at="ts"), None, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n FROM {events} GROUP BY 1, 2")
query("sink_kafka_replay", lambda t: SRC.as_events(t.fact_orders.select("order_id", "total_items"), "order", F.col("order_id"), F.lit("1998-01-01 00:00:00")), None, """SELECT order_id AS key, CONCAT('{"event_type":"order","event_time":"1998-01-01 00:00:00","order_id":"', order_id, '","total_items":', CAST(total_items AS VARCHAR), '}') AS value FROM {fact_orders}""".replace('{"event_type"', '<"event_type"').replace("'}')", "'>')"))
ORACLES["sink_kafka_replay"] = ORACLES["sink_kafka_replay"].replace('<"event_type"', '{"event_type"').replace("'>')", "'}')")

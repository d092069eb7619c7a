"""Costs, order quantities, safety stock, reorder points, allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlake.functions.costs import HOLDING_RATE
from depotlake.functions.rounding import half_up
from depotlake.functions.stats import phi
from depotlake.operators.scans import joined
from depotlake.sources.files import scratch

# The platform's assumptions. They are parameters of the scenario, not measurements.
REDUCTIONS = {"holding": 0.12, "transport": 0.08, "ordering": 0.05, "stockout": 0.25}
ORDER_COST, STOCKOUT_SHARE, Z95, STOCKOUT_PENALTY, USABLE = 50.0, 0.1, 1.645, 15.0, 0.90
PRIORITY = {"Same-Day": 0, "Express": 1, "Standard": 2}


def cost_baseline(kpis: DataFrame) -> DataFrame:
    """Holding, transport, ordering and stockout costs and their total, by day and warehouse."""
    orders, revenue = F.col("total_orders"), F.col("total_revenue")
    lost = F.col("stockout_rate") * orders * F.try_divide(revenue, orders) * STOCKOUT_SHARE
    parts = {"holding": F.col("total_holding_cost"), "transport": F.col("total_delivery_cost"), "ordering": F.col("total_shipment_cost"), "stockout": lost}
    out = kpis.select("date", "warehouse_id", *[half_up(F.coalesce(c, F.lit(0.0)), 2).alias(f"{k}_cost") for k, c in parts.items()])
    return out.withColumn("baseline_cost", half_up(sum((F.col(f"{k}_cost") for k in parts), F.lit(0.0)), 2))


def cost_optimized(baseline: DataFrame, reductions: dict[str, float] = REDUCTIONS) -> DataFrame:
    out = baseline.withColumns({f"{k}_optimized": half_up(F.col(f"{k}_cost") * (1 - r), 2) for k, r in reductions.items()})
    out = out.withColumn("optimized_cost", half_up(sum((F.col(f"{k}_optimized") for k in reductions), F.lit(0.0)), 2))
    out = out.withColumn("savings_amount", half_up(F.col("baseline_cost") - F.col("optimized_cost"), 2))
    return out.withColumn("savings_pct", F.when(F.col("baseline_cost") > 0, half_up(F.col("savings_amount") / F.col("baseline_cost") * 100, 2)).otherwise(0.0))


def run_cost_optimization(kpis: DataFrame, efficiency: DataFrame) -> DataFrame:
    costs = cost_optimized(cost_baseline(kpis))
    return costs.join(efficiency.select("date", "warehouse_id", "allocation_efficiency_pct"), ["date", "warehouse_id"], "left").withColumn("allocation_efficiency_pct", F.coalesce("allocation_efficiency_pct", F.lit(0.0)))


def optimization_totals(costs: DataFrame) -> DataFrame:
    return costs.agg(half_up(F.sum("baseline_cost"), 2).alias("total_baseline"), half_up(F.sum("optimized_cost"), 2).alias("total_optimized"), half_up(F.sum("savings_amount"), 2).alias("total_savings"), half_up(F.avg("savings_pct"), 2).alias("avg_savings_pct"))


def eoq(daily: Column, cost: Column, order_cost: float = ORDER_COST) -> Column:
    """Economic order quantity for a year of daily demand; 0 without demand or cost."""
    yearly = daily * 365
    return F.when((daily > 0) & (cost > 0), F.sqrt(F.try_divide(2 * yearly * order_cost, cost * HOLDING_RATE * 365))).otherwise(0.0)


def safety_stock(daily: Column, deviation: Column, lead: Column, lead_deviation: Column) -> Column:
    spread = F.sqrt(lead * deviation * deviation + daily * daily * lead_deviation * lead_deviation)
    return F.when(daily > 0, F.lit(Z95) * spread).otherwise(0.0)


def reorder_point(daily: Column, deviation: Column, lead: Column, cost: Column, penalty: float = STOCKOUT_PENALTY) -> Column:
    """The point in [0, 3 mu] with the least holding of safety stock plus expected stockout cost; mu is the demand during the lead time.

    Beyond mu the cost is h L (r - mu) + P(demand > r) D penalty; where its slope is never negative the least is at mu, otherwise where the
    normal density equals h L / (D penalty).
    """
    mu, s = daily * lead, deviation * F.sqrt(lead)
    slope = cost * HOLDING_RATE * lead * s * math.sqrt(2 * math.pi)
    gain = daily * penalty
    best = mu + s * F.sqrt(F.greatest(F.lit(0.0), -2 * F.ln(F.when((slope > 0) & (slope < gain), slope / gain).otherwise(F.lit(1.0)))))
    return F.when(daily <= 0, 0.0).when((s > 0) & (slope <= 0), 3 * mu).otherwise(F.least(best, 3 * mu))


def reorder_cost(point: Column, daily: Column, deviation: Column, lead: Column, cost: Column, penalty: float = STOCKOUT_PENALTY) -> Column:
    mu, s = daily * lead, deviation * F.sqrt(lead)
    out = F.lit(1.0) - phi(F.when(s > 0, (point - mu) / s).otherwise(F.when(point >= mu, 40.0).otherwise(-40.0)))
    return F.greatest(F.lit(0.0), point - mu) * cost * HOLDING_RATE * lead + out * daily * penalty


def product_demand(kpis: DataFrame) -> DataFrame:
    return kpis.where("not is_forecast").groupBy("product_id").agg(
        F.avg("total_units_sold").alias("avg_daily_demand"), F.stddev_samp("total_units_sold").alias("std_demand"), F.avg("avg_closing_stock").alias("avg_stock"), F.sum("total_holding_cost").alias("total_holding"),
    )


def inventory_summary(kpis: DataFrame, products: DataFrame, lead_deviation: DataFrame | None = None, costs: bool = True) -> DataFrame:
    """For each product: demand, order quantity, safety stock, reorder point, and its cost."""
    p = products.select("product_id", F.col("cost_price").cast("double").alias("cost"), F.col("lead_time_days").cast("double").alias("lead"), F.col("reorder_point").alias("current_reorder_point"))
    rows = product_demand(kpis).join(p, "product_id")
    rows = rows.withColumn("lead_std", F.lit(0.0)) if lead_deviation is None else rows.join(F.broadcast(lead_deviation.select(F.col("lead_std"))))
    d, s, lead, c = F.col("avg_daily_demand"), F.coalesce("std_demand", F.lit(0.0)), F.col("lead"), F.col("cost")
    rows = rows.withColumns({"eoq": half_up(eoq(d, c), 2), "safety_stock": half_up(safety_stock(d, s, lead, F.col("lead_std")), 2), "reorder_point": half_up(reorder_point(d, s, lead, c), 2)})
    if costs:
        rows = rows.withColumn("expected_cost", half_up(reorder_cost(F.col("reorder_point"), d, s, lead, c), 2))
    return rows.withColumns({"avg_daily_demand": half_up(d, 4), "std_demand": half_up("std_demand", 4)}).drop("cost", "lead", "lead_std", "avg_stock", "total_holding")


def greedy_allocation(orders: DataFrame, costs: DataFrame, warehouses: DataFrame, usable: float = USABLE) -> DataFrame:
    """Each day's orders, urgent ones first (an unknown priority is Standard), then by id, go to the cheapest warehouse that has any room left.

    Room is capacity_units times usable, floored, of each day; an order may take more than is left, which then is none. An order of a customer without
    costs, or for which no warehouse has room, keeps its warehouse and costs what it did. baseline_cost is total_fulfillment_cost.

    All days go in rounds, of which there are at most as many as warehouses, and one more. In a round every open order chooses among the warehouses with
    room; running sums of items by day and warehouse find the order that fills one; the choices of a day stand up to its first such order, and the others
    choose again. A round reads what the last one wrote; where no warehouse fills, the first round is the last. Rounds carry the order of a customer's
    warehouses only, one byte each; what the chosen one costs is looked up at the end.
    """
    spark = orders.sparkSession
    names = [(r["warehouse_id"], math.floor(r["capacity_units"] * usable)) for r in warehouses.select("warehouse_id", "capacity_units").orderBy("warehouse_id").collect()]  # one row for each warehouse
    number = F.lit(None).cast("int")
    for k, (w, _) in enumerate(names):
        number = F.when(F.col("warehouse_id") == w, k).otherwise(number)
    kind = "tinyint" if len(names) <= 127 else "int"
    least = costs.where(F.col("cost").isNotNull()).select("customer_id", number.cast(kind).alias("k"), "cost").where("k is not null").groupBy("customer_id", "k").agg(F.min("cost").alias("cost"))
    choices = least.groupBy("customer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cost", "k"))), lambda c: c["k"]).alias("choices"))
    rank = F.lit(2)
    for k, v in PRIORITY.items():
        rank = F.when(F.col("order_priority") == k, v).otherwise(rank)
    rows = orders.select("order_id", "order_date", "customer_id", "assigned_warehouse_id", F.coalesce("total_items", F.lit(0)).cast("long").alias("items"), F.col("total_fulfillment_cost").cast("double").alias("baseline_cost"), rank.alias("rank"), F.monotonically_increasing_id().alias("row"))
    path = scratch(spark, "allocation")
    rows.join(choices, "customer_id", "left").write.parquet(f"{path}/0")
    todo = spark.read.parquet(f"{path}/0")
    rooms = todo.select("order_date").distinct().withColumn("room", F.array(*[F.lit(r).cast("long") for _, r in names]))
    place = ["rank", "order_id", "row"]
    done = None
    for turn in range(1, len(names) + 2):
        open_ = F.filter("choices", lambda k: F.element_at("room", k.cast("int") + 1) > 0)
        chosen = joined(todo, rooms, ["order_date"]).withColumn("best", F.get(open_, F.lit(0)))
        upto = F.sum("items").over(Window.partitionBy("order_date", "best").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
        filled = F.when(F.col("best").isNotNull() & (upto >= F.element_at("room", F.col("best").cast("int") + 1)), F.struct(*place))
        chosen.withColumn("filled", filled).drop("room").write.parquet(f"{path}/{turn}")
        chosen = spark.read.parquet(f"{path}/{turn}")
        cuts = chosen.groupBy("order_date").agg(F.min("filled").alias("cut"))  # the order that fills the first warehouse of a day
        settled = joined(chosen, cuts, ["order_date"]).withColumn("settled", F.coalesce(F.struct(*place) <= F.col("cut"), F.lit(True)))
        own = settled.where("settled")
        done = own if done is None else done.unionByName(own)
        if chosen.where("filled is not null").isEmpty():
            break
        taken = own.where("best is not null").groupBy("order_date", F.col("best").cast("int").alias("k")).agg(F.sum("items").alias("n")).groupBy("order_date").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("taken"))
        left = F.transform("room", lambda r, k: r - F.coalesce(F.try_element_at("taken", k), F.lit(0)))
        rooms = joined(rooms, taken, ["order_date"]).select("order_date", left.alias("room"))
        rooms.write.parquet(f"{path}/rooms-{turn}")
        rooms = spark.read.parquet(f"{path}/rooms-{turn}")
        todo = settled.where("not settled").select(*todo.columns)
    ids = F.array(*[F.lit(w) for w, _ in names])
    where = F.coalesce(F.when(F.col("best").isNotNull(), F.element_at(ids, F.col("best").cast("int") + 1)), F.col("assigned_warehouse_id"))
    priced = joined(done.drop("choices", "filled"), least.withColumnRenamed("k", "best"), ["customer_id", "best"])
    out = priced.withColumns({"warehouse_id": where, "optimal_cost": F.coalesce("cost", "baseline_cost")})
    return out.select(
        "order_id", "order_date", "warehouse_id", F.col("assigned_warehouse_id").alias("original_warehouse_id"), "optimal_cost", "baseline_cost",
        F.coalesce(F.col("warehouse_id") == F.col("assigned_warehouse_id"), F.lit(False)).alias("is_optimal_assignment"),
    )


def allocation_savings(allocated: DataFrame) -> DataFrame:
    """Totals and savings of an allocation, and the share of orders that stay where they were; sums are exact to the cent."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    total = allocated.agg(money("baseline_cost").alias("b"), money("optimal_cost").alias("o"), F.avg(F.col("is_optimal_assignment").cast("double")).alias("e"))
    b, o = F.col("b"), F.col("o")
    return total.select(
        half_up(b, 2).alias("total_baseline_cost"), half_up(o, 2).alias("total_optimized_cost"), half_up(b - o, 2).alias("total_savings"), F.when(b > 0, half_up((b - o) / b * 100, 2)).otherwise(0.0).alias("savings_pct"),
        half_up(F.col("e") * 100, 2).alias("allocation_efficiency_pct"),
    )

"""Staging: one projection with casts, derived columns and a filter for each table. Nothing here shuffles.

Ladders' bounds belong to the upper step. Where the platform's SQL divides, division by zero gives the stated default, and where
it reads the clock, as_of is a parameter.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up

AS_OF = date(2000, 1, 1)


def ladder(value: Column, steps: list[tuple[float, str]], rest: str, below: bool = False) -> Column:
    """The name of the first step that value reaches (below: that it doesn't exceed)."""
    out = F.lit(rest)
    for bound, name in reversed(steps):
        out = F.when(value <= bound if below else value >= bound, name).otherwise(out)
    return out


def ratio(a: Column, b: Column, digits: int = 2, default: float | None = 0.0, factor: float = 1.0) -> Column:
    """a / b x factor in double precision, rounded; default where b isn't positive."""
    value = half_up(F.try_divide(a.cast("double"), b.cast("double")) * factor, digits)
    return F.when(b > 0, value).otherwise(F.lit(default).cast("double"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("long")


def stg_orders(orders: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return orders.where("total_amount > 0 and order_status is not null").withColumns({
        "experiment_id": blank("experiment_id"), "experiment_group": blank("experiment_group"),
        "is_cross_region": F.coalesce(F.col("assigned_warehouse_id") != F.col("nearest_warehouse_id"), F.lit(False)),
        "order_value_tier": ladder(F.col("total_amount"), [(500, "High Value"), (100, "Medium Value")], "Low Value"),
        "is_experiment_order": blank("experiment_id").isNotNull(),
    })


def stg_order_items(items: DataFrame) -> DataFrame:
    discount = F.coalesce("discount_amount", F.lit(0).cast("decimal(10,2)"))
    return items.where("quantity > 0 and unit_price > 0").withColumns({
        "discount_amount": discount, "has_discount": discount > 0,
        "discount_pct": ratio(discount, F.col("unit_price") * F.col("quantity"), factor=100.0),
    })


def stg_inventory_snapshot(inventory: DataFrame) -> DataFrame:
    days = F.col("days_of_supply")
    capped = F.when(days.isNotNull(), F.least(days, F.lit(99.99).cast("decimal(5,2)")))  # least() passes over nulls; the cap must not
    health = F.when(F.col("stockout_flag"), "Stockout").when(F.col("below_safety_stock_flag"), "Critical").when(days < 7, "Low").when(days < 30, "Healthy").otherwise("Overstocked")
    net = F.col("units_received") + F.col("units_returned") - F.col("units_sold")
    return inventory.where("closing_stock >= 0").withColumns({"days_of_supply": capped, "net_stock_movement": net, "inventory_health": health})


def stg_shipments(shipments: DataFrame, as_of: date = AS_OF) -> DataFrame:
    sent, expected, actual = F.col("shipment_date"), F.col("expected_arrival_date"), F.col("actual_arrival_date")
    status = F.when(actual.isNotNull(), "Delivered").when(expected < F.lit(as_of), "Overdue").otherwise("In Transit")
    return shipments.where("quantity > 0").withColumns({
        "delay_days": F.when(actual.isNotNull(), F.greatest(F.lit(0), days_between(actual, expected))), "shipment_status": status,
        "cost_per_unit": ratio(F.col("shipment_cost"), F.col("quantity")), "transit_days": days_between(actual, sent),
    })


def stg_deliveries(deliveries: DataFrame) -> DataFrame:
    actual, eta = F.col("actual_delivery_minutes"), F.col("estimated_eta_minutes")
    error = (actual - eta).cast("double")
    return deliveries.where("delivery_status is not null").withColumns({
        "sla_breach_flag": F.coalesce(actual > F.col("sla_minutes"), F.lit(False)),
        "eta_accuracy_pct": F.when(eta > 0, half_up(100 - F.try_divide(F.abs(error), eta.cast("double")) * 100, 2)), "eta_error_minutes": half_up(error, 2),
        "delivery_speed_tier": F.when(actual.isNotNull(), ladder(actual, [(30, "Express"), (60, "Standard"), (120, "Slow")], "Very Slow", below=True)),
        "cost_per_km": ratio(F.col("delivery_cost"), F.col("distance_km")),
    })


def stg_driver_activity(activity: DataFrame) -> DataFrame:
    use = F.col("utilization_pct")
    return activity.where("deliveries_completed >= 0").withColumns({
        "productivity_tier": ladder(use, [(80, "High"), (50, "Medium")], "Low"), "utilization_pct": F.when(use.isNotNull(), F.least(use, F.lit(100).cast("decimal(5,2)"))),
        "avg_distance_per_delivery": ratio(F.col("total_distance_km"), F.col("deliveries_completed")),
        "deliveries_per_hour": ratio(F.col("deliveries_completed"), F.col("total_active_hours")),
    })


def stg_experiment_assignments(assignments: DataFrame) -> DataFrame:
    return assignments.where("experiment_id is not null and order_id is not null")


def stg_experiments(experiments: DataFrame, as_of: date = AS_OF) -> DataFrame:
    end = F.col("end_date")
    return experiments.withColumns({
        "experiment_duration_days": days_between(F.coalesce(end, F.lit(as_of)), F.col("start_date")),
        "is_active": (F.col("status") == "Active") & (end.isNull() | (end >= F.lit(as_of))),
    })


def stg_dates(dates: DataFrame) -> DataFrame:
    d = F.col("date")
    return dates.withColumns({
        "is_business_day": ~F.col("is_weekend") & ~F.col("is_holiday"), "is_month_start": F.dayofmonth(d) == 1, "is_month_end": d == F.last_day(d),
        "week_of_month": F.ceil(F.dayofmonth(d) / 7).cast("long"), "year_month": F.date_format(d, "yyyy-MM"),
    })


def stg_warehouses(warehouses: DataFrame) -> DataFrame:
    return warehouses.where("is_active").withColumns({
        "capacity_tier": ladder(F.col("capacity_units"), [(75000, "Large"), (65000, "Medium")], "Small"),
        "cost_tier": ladder(F.col("operating_cost_per_day"), [(4500, "High Cost"), (3800, "Medium Cost")], "Low Cost"),
    })


def scd_columns(df: DataFrame) -> DataFrame:
    """valid_to with an open end as 9999-12-31, and is_current. A table without versions is all current."""
    if "valid_from" not in df.columns:
        df = df.withColumns({"valid_from": F.lit("1900-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    return df.withColumns({"is_current": F.col("valid_to").isNull(), "valid_to": F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))})


def stg_products(products: DataFrame) -> DataFrame:
    cost, price = F.col("cost_price"), F.col("selling_price")
    return scd_columns(products.where("cost_price > 0 and selling_price > 0 and selling_price >= cost_price")).withColumns({
        "profit_margin_pct": ratio(price - cost, cost, default=None, factor=100.0), "price_tier": ladder(price, [(200, "Premium"), (50, "Mid-Range")], "Budget"),
        "lead_time_risk": ladder(F.col("lead_time_days"), [(10, "High"), (5, "Medium")], "Low"),
    })


def stg_suppliers(suppliers: DataFrame) -> DataFrame:
    return scd_columns(suppliers.where("reliability_score between 0 and 1")).withColumns({
        "supplier_grade": ladder(F.col("reliability_score"), [(0.93, "A"), (0.85, "B"), (0.75, "C")], "D"),
        "lead_time_category": ladder(F.col("average_lead_time"), [(3, "Fast"), (5, "Standard")], "Slow", below=True),
    })


def stg_drivers(drivers: DataFrame, as_of: date = AS_OF) -> DataFrame:
    return scd_columns(drivers).withColumns({
        "experience_years": half_up(F.datediff(F.lit(as_of), "hire_date") / F.lit(365.25), 1),
        "capacity_tier": ladder(F.col("max_delivery_capacity"), [(25, "High"), (15, "Medium")], "Low"),
        "speed_tier": ladder(F.col("avg_speed_kmh"), [(45, "Fast"), (30, "Medium")], "Slow"),
    })


def stg_customers(customers: DataFrame, as_of: date = AS_OF) -> DataFrame:
    return scd_columns(customers.where("latitude between 24 and 50 and longitude between -130 and -60")).withColumns({
        "customer_tenure_days": days_between(F.lit(as_of), F.col("acquisition_date")),
        "engagement_tier": ladder(F.col("order_frequency_score"), [(0.70, "High"), (0.30, "Medium")], "Low"),
    })

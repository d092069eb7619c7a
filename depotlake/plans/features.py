"""Feature tables for demand, delivery time and stockout risk."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlake.operators.scans import day_totals, means_before
from depotlake.operators.windows import PANEL, PRODUCT, label_codes, lags, rolling, series, stockout_label, trend
from depotlake.sources.files import stored

# Codes of categories.
SEASONS = {"Winter": 0, "Spring": 1, "Summer": 2, "Fall": 3}
VEHICLES = {"Bike": 0, "Car": 1, "Van": 2, "Truck": 3}
PRIORITIES = {"Standard": 0, "Express": 1, "Same-Day": 2}
PEAK_HOURS = [8, 9, 10, 11, 12, 17, 18, 19]

# The features of each model.
DEMAND_FEATURES = [
    *[f"demand_lag_{k}d" for k in (1, 3, 7, 14, 28)], *[f"demand_rolling_avg_{k}d" for k in (7, 14, 30)], *[f"demand_rolling_std_{k}d" for k in (7, 14, 30)], "demand_rolling_min_7d", "demand_rolling_max_7d",
    "demand_wow_change", "demand_mom_change", "stockout_count", "stockout_lag_1d", "avg_closing_stock", "avg_stock_lag_1d", "inventory_turnover", "day_of_week_num", "month", "quarter", "year", "is_holiday", "is_weekend",
    "season_encoded", "category_encoded", "cost_price", "selling_price", "weight_kg", "is_perishable", "price_ratio", "profit_margin",
]
# What demand's features read of a product.
PRODUCT_COLUMNS = ["category", "cost_price", "selling_price", "weight_kg", "is_perishable"]
ETA_FEATURES = [
    "distance_km", "distance_squared", "distance_log", "vehicle_type_encoded", "driver_hist_speed_kmh", "eta_speed_estimate", "driver_experience_years", "driver_avg_delivery", "simple_eta", "pickup_wait", "warehouse_avg_delivery",
    "hour", "is_peak_hour", "is_morning", "is_afternoon", "is_evening", "day_of_week_num", "month", "is_holiday", "is_weekend", "season_encoded", "priority_encoded",
]
STOCKOUT_FEATURES = [
    "closing_stock", "opening_stock", "units_sold", "units_received", "days_of_supply", "holding_cost", "stock_to_safety_ratio", "stock_to_reorder_ratio", "below_safety_stock_flag", *[f"{c}_lag_{k}d" for c in ("closing_stock", "units_sold") for k in (1, 3, 7)],
    "demand_rolling_avg_7d", "demand_rolling_avg_14d", "demand_rolling_std_7d", "demand_rolling_std_14d", "stock_depletion_rate", "est_days_until_stockout", "has_pending_order", "units_on_order", "reorder_triggered_today", "stockout_count_30d",
    "day_of_week_num", "month", "quarter", "is_holiday", "is_weekend", "season_encoded", "category_encoded",
]


def number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0))


def code(c: str, codes: dict[str, int], rest: int = 0) -> Column:
    out = F.lit(rest)
    for k, v in codes.items():
        out = F.when(F.col(c) == k, v).otherwise(out)
    return out


def over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def dated(df: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """df with the calendar's columns of its day; the calendar is one row a day and is broadcast."""
    c = dates.select(F.col("date").alias(day), "day_of_week_num", "month", "quarter", "year", "is_holiday", "is_weekend", "season")
    own = [x for x in c.columns if x != day]
    return df.drop(*own).join(F.broadcast(c), day, "left").withColumns({"season_encoded": code("season", SEASONS), "is_holiday": flag("is_holiday"), "is_weekend": flag("is_weekend")})


def demand_features(kpis: DataFrame, dates: DataFrame, products: DataFrame, complete: bool = True) -> DataFrame:
    """Features by product and day; with complete, rows without the 28-row lag are left out. One exchange by product."""
    numbers = ["total_units_sold", "total_revenue", "stockout_count", "avg_closing_stock", "inventory_turnover", "avg_days_of_supply"]
    weight = F.col("weight_kg") if "weight_kg" in products.columns else F.lit(0.0)
    p = products.select("product_id", "category", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in (("cost_price", F.col("cost_price")), ("selling_price", F.col("selling_price")), ("weight_kg", weight))], flag("is_perishable").alias("is_perishable"))
    df = dated(kpis.drop("category", "price_tier").withColumns({c: number(c) for c in numbers}), dates, "date")
    df = label_codes(df.join(p, "product_id", "left"), "category", "category_encoded", p)
    w, units = series(PRODUCT, "date"), "total_units_sold"
    week = w.rowsBetween(-6, 0)
    df = df.withColumns(lags(w, units, [1, 3, 7, 14, 28], "demand") | rolling(w, units, [7, 14, 30], "demand") | trend(w, units) | {
        "demand_rolling_min_7d": F.min(units).over(week), "demand_rolling_max_7d": F.max(units).over(week), "stockout_lag_1d": F.lag("stockout_count").over(w), "avg_stock_lag_1d": F.lag("avg_closing_stock").over(w),
        "price_ratio": over(F.col("selling_price"), F.col("cost_price")), "profit_margin": F.col("selling_price") - F.col("cost_price"),
    })
    return df.where("demand_lag_28d is not null") if complete else df


def delivered_rows(deliveries: DataFrame) -> DataFrame:
    """Delivered deliveries with their minutes, numbers as doubles."""
    numbers = ["actual_delivery_minutes", "estimated_eta_minutes", "distance_km", "driver_experience_years", "pickup_wait_minutes"]
    return deliveries.where("delivery_status = 'Delivered' and actual_delivery_minutes is not null").withColumns({c: number(c) for c in numbers if c in deliveries.columns})


def delivery_means(done: DataFrame) -> DataFrame:
    """Mean minutes and distance of each driver, each warehouse and all, in one pass over grouping sets: driver_id and warehouse_id are null where they don't apply, level is 1, 2 or 3."""
    sets = [[F.col("driver_id")], [F.col("warehouse_id")], []]
    rows = done.groupingSets(sets, "driver_id", "warehouse_id").agg(
        F.grouping_id().alias("level"), F.avg("actual_delivery_minutes").alias("minutes"), F.avg("distance_km").alias("km"), F.count(F.lit(1)).alias("deliveries"),
    )
    return rows.select("driver_id", "warehouse_id", F.col("level").cast("int").alias("level"), "minutes", "km", "deliveries")


def speed_of(km: Column, minutes: Column) -> Column:
    return F.least(F.lit(120.0), F.greatest(F.lit(0.0), over(km, minutes / 60)))


def driver_stats(deliveries: DataFrame) -> DataFrame:
    done = delivered_rows(deliveries).where("driver_id is not null")
    out = done.groupBy("driver_id").agg(F.avg("actual_delivery_minutes").alias("minutes"), F.avg("distance_km").alias("km"), F.count(F.lit(1)).alias("deliveries"))
    return out.select("driver_id", "minutes", speed_of(F.col("km"), F.col("minutes")).alias("speed"), "deliveries")


def warehouse_stats(deliveries: DataFrame) -> DataFrame:
    return delivered_rows(deliveries).groupBy("warehouse_id").agg(F.avg("actual_delivery_minutes").alias("minutes"), F.count(F.lit(1)).alias("deliveries"))


def eta_features(deliveries: DataFrame, dates: DataFrame, as_of_start: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Features of delivered deliveries. Drivers', warehouses' and the global mean are one aggregate over grouping sets, joined back.

    facts: the deliveries before they were enriched, from which the means are taken without the enrichment's joins.
    """
    df = delivered_rows(deliveries)
    # as the platform has them, means are over all rows; as of the start they are over rows assigned before (no leak)
    raw = delivered_rows(facts if facts is not None else deliveries)
    if as_of_start:  # the facts are read once, and each delivery is dealt by driver and day, and by warehouse and day
        totals = stored(day_totals(raw, ["driver_id", "warehouse_id"], "assigned_time", ["actual_delivery_minutes", "distance_km"]), "days")
        whole = totals.agg(F.try_divide(F.sum("actual_delivery_minutes"), F.sum("_rows")).alias("_mean"))
        df = means_before(df, totals, "driver_id", "assigned_time", {"_minutes": "actual_delivery_minutes", "_km": "distance_km"})
        df = means_before(df, totals, "warehouse_id", "assigned_time", {"_warehouse": "actual_delivery_minutes"})
    else:
        means = delivery_means(raw)
        whole = means.where("level = 3").select(F.col("minutes").alias("_mean"))
        df = df.join(means.where("level = 1").select("driver_id", F.col("minutes").alias("_minutes"), F.col("km").alias("_km")), "driver_id", "left")
        df = df.join(means.where("level = 2").select("warehouse_id", F.col("minutes").alias("_warehouse")), "warehouse_id", "left")
    # what a row's own columns give comes after the exchanges, which then don't carry it
    df = dated(df.withColumn("date", F.to_date("assigned_time")), dates, "date")
    hour, km, eta = F.hour("assigned_time"), F.col("distance_km"), F.col("estimated_eta_minutes")
    df = df.withColumns({
        "hour": hour, "is_peak_hour": hour.isin(PEAK_HOURS).cast("int"), "is_morning": hour.between(6, 11).cast("int"), "is_afternoon": hour.between(12, 17).cast("int"), "is_evening": (hour >= 18).cast("int"),
        "distance_squared": km * km, "distance_log": F.log1p(km), "vehicle_type_encoded": code("vehicle_type", VEHICLES, 1), "eta_speed_estimate": over(km, eta / 60), "simple_eta": eta, "pickup_wait": F.col("pickup_wait_minutes"),
        "priority_encoded": code("order_priority", PRIORITIES),
    })
    return df.join(F.broadcast(whole)).withColumns({  # one row
        "warehouse_avg_delivery": F.coalesce("_warehouse", "_mean"), "driver_avg_delivery": F.coalesce("_minutes", "_mean"),
        "driver_hist_speed_kmh": F.coalesce(F.when(F.col("_minutes").isNotNull(), speed_of(F.col("_km"), F.col("_minutes"))), F.lit(30.0)),
    }).drop("_warehouse", "_mean", "_minutes", "_km")


def stockout_features(inventory: DataFrame, dates: DataFrame, drop_incomplete: bool = False, products: DataFrame | None = None) -> DataFrame:
    """Features by warehouse, product and day, and the label; rows without the 7-row lag are left out, and on demand those whose label looks past the end.

    products: the table that has all categories; without it they are looked for in the inventory.
    """
    df = label_codes(dated(inventory, dates, "snapshot_date"), "category", "category_encoded", products)
    numbers = ["closing_stock", "opening_stock", "units_sold", "units_received", "days_of_supply", "holding_cost", "safety_stock", "reorder_point", "units_on_order"]
    w = series(PANEL, "snapshot_date")
    df = df.withColumns({c: number(c) for c in numbers})
    df = df.withColumns(lags(w, "closing_stock", [1, 3, 7], "closing_stock") | lags(w, "units_sold", [1, 3, 7], "units_sold") | rolling(w, "units_sold", [7, 14], "demand") | {
        "will_stockout_3d": stockout_label(w), "stockout_count_30d": F.sum(flag("stockout_flag")).over(w.rowsBetween(-29, 0)), "_ahead": F.lead("snapshot_date", 3).over(w),
    })
    clip = lambda c, top: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top))))
    stock = F.col("closing_stock")
    df = df.withColumns({
        "stock_to_safety_ratio": over(stock, F.col("safety_stock")), "stock_to_reorder_ratio": over(stock, F.col("reorder_point")), "stock_depletion_rate": clip(over(F.col("units_sold"), stock), 10),
        "est_days_until_stockout": clip(over(stock, F.col("demand_rolling_avg_7d")), 99), "has_pending_order": (F.col("units_on_order") > 0).cast("int"), "reorder_triggered_today": flag("reorder_triggered_flag"),
        "below_safety_stock_flag": flag("below_safety_stock_flag"), "stockout_flag": flag("stockout_flag"),
    })
    kept = df.where("closing_stock_lag_7d is not null")
    return (kept.where("_ahead is not null") if drop_incomplete else kept).drop("_ahead")


def temporal_split(df: DataFrame, day: str = "date", train_end: date = date(2024, 6, 30), valid_end: date = date(2024, 10, 31)) -> DataFrame:
    """df with split: train, validation or test, by date."""
    d = F.to_date(day)
    return df.withColumn("split", F.when(d <= F.lit(train_end), "train").when(d <= F.lit(valid_end), "validation").otherwise("test"))

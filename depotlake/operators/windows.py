"""Series of one key over time. Frames count rows; all windows of one key share an exchange and a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from depotlake.functions.sizes import small
from depotlake.operators.scans import ema

PRODUCT, PANEL = ["product_id"], ["warehouse_id", "product_id"]


def series(keys: list[str], day: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(day)


def lags(w: WindowSpec, column: str, by: list[int], name: str) -> dict[str, Column]:
    return {f"{name}_lag_{k}d": F.lag(column, k).over(w) for k in by}


def rolling(w: WindowSpec, column: str, rows: list[int], name: str) -> dict[str, Column]:
    """Means and deviations of so many rows, the current one included, from the first row on."""
    frames = {k: w.rowsBetween(1 - k, 0) for k in rows}
    return {f"{name}_rolling_avg_{k}d": F.avg(column).over(f) for k, f in frames.items()} | {f"{name}_rolling_std_{k}d": F.stddev_samp(column).over(f) for k, f in frames.items()}


def trend(w: WindowSpec, column: str) -> dict[str, Column]:
    return {"demand_wow_change": F.col(column) - F.lag(column, 7).over(w), "demand_mom_change": F.col(column) - F.lag(column, 30).over(w)}


def stockout_label(w: WindowSpec, flag: str = "stockout_flag", days: int = 3) -> Column:
    """1 if one of the next rows is a stockout; rows that aren't there are none."""
    ahead = F.lit(False)
    for k in range(1, days + 1):
        ahead = ahead | F.coalesce(F.lead(flag, k).over(w), F.lit(False))
    return ahead.cast("int")


def label_codes(df: DataFrame, column: str, name: str, labels: DataFrame | None = None) -> DataFrame:
    """df with the place of each label among the sorted labels, -1 for null. Labels are categories, few by nature; labels: a small table that has them all, so that df isn't read for them."""
    values = (df if labels is None else labels).where(F.col(column).isNotNull()).select(column).distinct()
    codes = values.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    return df.join(small(codes), column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def inventory_ledger(moves: DataFrame, opening: int = 60) -> DataFrame:
    """opening_stock and closing_stock of each day: stock carries over and never falls below zero.

    With S the running total of net moves on top of the opening stock, the clipped stock is S - min(0, lowest S so far).
    """
    w = series(PANEL, "snapshot_date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("units_received") + F.col("units_returned") - F.col("units_sold")
    out = moves.withColumn("_s", F.lit(opening) + F.sum(net).over(so_far)).withColumn("closing_stock", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    return out.withColumn("opening_stock", F.coalesce(F.lag("closing_stock").over(w), F.lit(opening))).drop("_s")


def reorder_signal(inventory: DataFrame) -> DataFrame:
    """reorder: stock at or below the reorder point, and nothing on order the day before."""
    waiting = F.coalesce(F.lag("units_on_order").over(series(PANEL, "snapshot_date")), F.lit(0))
    return inventory.withColumn("reorder", (F.col("closing_stock") <= F.col("reorder_point")) & (waiting == 0))


def in_flight(shipments: DataFrame, as_of: Column) -> DataFrame:
    """Shipments sent by as_of: arriving on that day, or still pending after it."""
    sent = shipments.where(F.col("shipment_date") <= as_of)
    arriving = F.col("actual_arrival_date") == as_of
    pending = F.col("actual_arrival_date").isNull() | (F.col("actual_arrival_date") > as_of)
    return sent.where(arriving | pending).withColumn("flight", F.when(arriving, "Arriving").otherwise("Pending"))


def units_ledger(items: DataFrame, orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Units sold, received and returned by day, warehouse and product."""
    o = orders.select("order_id", F.col("order_date").alias("date"), F.col("assigned_warehouse_id").alias("warehouse_id"), "order_status", "return_flag")
    key = ["date", "warehouse_id", "product_id"]
    sold = F.when(F.col("order_status").isin("Delivered", "Shipped", "Processing"), F.col("quantity")).otherwise(0)
    out = items.join(o, "order_id").select(*key, sold.alias("sold"), F.lit(0).alias("received"), F.when(F.col("return_flag"), F.col("quantity")).otherwise(0).alias("returned"))
    got = shipments.where("actual_arrival_date is not null").select(F.col("actual_arrival_date").alias("date"), "warehouse_id", "product_id", F.lit(0).alias("sold"), F.col("quantity").alias("received"), F.lit(0).alias("returned"))
    return out.unionByName(got).groupBy(key).agg(*[F.sum(c).alias(f"units_{c}") for c in ("sold", "received", "returned")])


def ema_demand(inventory: DataFrame, alpha: float = 0.1, most_days: float = 99.99) -> DataFrame:
    """The exponential mean of units sold, starting at the first day's, and days of supply from it, at most most_days."""
    columns = ["snapshot_date", *PANEL, "units_sold", "closing_stock"]
    out = ema(inventory.select(columns), PANEL, "snapshot_date", "units_sold", "ema_demand", alpha)
    days = F.least(F.lit(most_days), F.try_divide(F.col("closing_stock"), F.col("ema_demand")))
    return out.withColumn("ema_days_of_supply", F.when(F.col("ema_demand") > 0, days).otherwise(most_days)).select(*columns, "ema_demand", "ema_days_of_supply")

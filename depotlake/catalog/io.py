"""Sources, sinks and streams: whole tables written, read back, loaded in increments and streamed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlake.catalog.base import Tables, big, day, dbl, query
from depotlake.sources import files as SRC

ORDERS = T.StructType([T.StructField(n, t) for n, t in (("order_id", T.StringType()), ("order_status", T.StringType()), ("experiment_id", T.StringType()), ("total_items", T.IntegerType()), ("total_amount", T.DecimalType(12, 2)))])


def dated_csv(t: Tables) -> str:
    """The orders as CSV, one folder for each month's first day."""
    path = SRC.scratch(t.spark, "orders-csv")
    SRC.write_dated(t.fact_orders.select(*ORDERS.names, F.trunc("order_date", "month").alias("date")), path)
    return path


COLUMNS = f"order_id, order_status, NULLIF(experiment_id, '') AS experiment_id, {big('total_items')}, {dbl('total_amount')}, strftime(date_trunc('month', order_date), '%Y-%m-%d') AS date"
query("src_csv_partitioned", lambda t: SRC.good_rows(SRC.read_dated(t.spark, dated_csv(t), ORDERS)), None, f"SELECT {COLUMNS} FROM {{fact_orders}}")
query("sink_csv_partitioned", lambda t: SRC.read_dated(t.spark, dated_csv(t), ORDERS).groupBy("date").agg(F.count(F.lit(1)).alias("n")), None, "SELECT strftime(date_trunc('month', order_date), '%Y-%m-%d') AS date, COUNT(*) AS n FROM {fact_orders} GROUP BY 1")


def reloaded(t: Tables):
    source, table = SRC.good_rows(SRC.read_dated(t.spark, dated_csv(t), ORDERS)), SRC.scratch(t.spark, "orders")
    SRC.reload_matching(source, table)
    again = SRC.good_rows(SRC.read_dated(t.spark, dated_csv(t), ORDERS, pattern="199[78]-.*")).withColumn("total_items", F.col("total_items") + 100)
    SRC.reload_matching(again, table)  # the matching partitions change, the others stay
    return t.spark.read.parquet(table).select("order_id", "total_items", F.to_date("date").alias("date"))


query("src_pattern_reload", reloaded, None, "SELECT order_id, CAST(total_items + CASE WHEN year(order_date) IN (1997, 1998) THEN 100 ELSE 0 END AS BIGINT) AS total_items, strftime(date_trunc('month', order_date), '%Y-%m-%d') AS date FROM {fact_orders}")


def with_bad_lines(t: Tables):
    path = SRC.scratch(t.spark, "bad-csv")
    line = F.when(F.col("o_orderkey") % 10 == 3, F.concat_ws(",", F.lit("x"), F.lit("s"), F.lit("e"), F.lit("many"), F.lit("1.00"))).otherwise(F.concat_ws(",", "o_orderkey", F.lit("s"), F.lit("NULL"), (F.col("o_orderkey") % 5).cast("string"), F.lit("1.00")))
    t.orders.select(line.alias("value")).write.text(path)
    wide = T.StructType([*ORDERS.fields, T.StructField(SRC.BAD, T.StringType())])
    df = t.spark.read.schema(wide).option("columnNameOfCorruptRecord", SRC.BAD).option("nullValue", "NULL").csv(path)
    good = F.col(SRC.BAD).isNull()
    return df.agg(F.count_if(good).alias("good"), F.count_if(good & F.col("experiment_id").isNotNull()).alias("experiments"), F.sum(F.when(good, F.col("total_items"))).alias("items"), F.count_if(~good).alias("bad"))


query("src_bad_rows", with_bad_lines, None, "SELECT COUNT(CASE WHEN o_orderkey % 10 <> 3 THEN 1 END) AS good, CAST(0 AS BIGINT) AS experiments, CAST(SUM(CASE WHEN o_orderkey % 10 <> 3 THEN o_orderkey % 5 END) AS BIGINT) AS items, COUNT(CASE WHEN o_orderkey % 10 = 3 THEN 1 END) AS bad FROM {orders}")


def dimension(t: Tables):
    path = SRC.scratch(t.spark, "products")
    SRC.write_flat(t.dim_product, path)
    return SRC.good_rows(SRC.read_csv(t.spark, path, t.dim_product.schema))


def reloaded(t: Tables):
    """A table of products after three loads of the CSV, of which each replaces what the one before left: some rows, changed rows, all rows; then the first one's prices again, which stay out."""
    source, table = SRC.scratch(t.spark, "products-csv"), SRC.scratch(t.spark, "products")
    for load in (t.dim_product.limit(1), t.dim_product.withColumn("product_name", F.lit("old")), t.dim_product):
        SRC.write_flat(load, source)
        SRC.write_flat(SRC.good_rows(SRC.read_csv(t.spark, source, t.dim_product.schema)), table, "parquet")
    SRC.write_flat(t.dim_product.withColumn("cost_price", F.lit(0).cast("decimal(12,2)")), source)
    return t.spark.read.parquet(table)


PRODUCT = f"SELECT product_id, product_name, {dbl('cost_price', 'selling_price')}, is_perishable FROM {{dim_product}}"
query("src_csv_dimension", dimension, "product_id product_name cost_price selling_price is_perishable", PRODUCT)
query("src_dim_reload", reloaded, "product_id product_name cost_price selling_price is_perishable", PRODUCT)


def table_query(t: Tables):
    base = SRC.scratch(t.spark, "warehouse")
    SRC.write_table(t.fact_orders, base, "orders", "overwrite")
    return SRC.read_table(t.spark, base, "orders", "select order_status, count(*) as n, sum(total_amount) as amount from {table} group by order_status")


def table_sink(t: Tables):
    """What a table holds after it was replaced twice and appended to."""
    base = SRC.scratch(t.spark, "warehouse")
    SRC.write_table(t.fact_orders, base, "orders", "overwrite")
    SRC.write_table(t.fact_orders.where("total_items <= 3"), base, "orders", "overwrite")
    SRC.write_table(t.fact_orders.where("total_items = 5"), base, "orders", "append")
    return SRC.read_table(t.spark, base, "orders").select("order_id", "total_items", "order_status")


query(
    "src_table_query", table_query, None,
    "SELECT order_status, COUNT(*) AS n, CAST(SUM(total_amount) AS DOUBLE) AS amount FROM {fact_orders} GROUP BY 1",
)
query("sink_table", table_sink, None, f"SELECT order_id, {big('total_items')}, order_status FROM {{fact_orders}} WHERE total_items <= 3 OR total_items = 5")


def cached(t: Tables):
    """Shipments up to a day without some that come late, and then all of them."""
    cache, facts = SRC.scratch(t.spark, "cache"), t.fact_shipments.select("shipment_id", "shipment_date", "quantity")
    late = "shipment_date > '1997-12-01' and shipment_id like '%3'"
    SRC.extend_cache(facts.where(f"shipment_date < '1998-01-01' and not ({late})"), cache, "shipment_date")
    return SRC.extend_cache(facts, cache, "shipment_date", ["shipment_id"], 40)


query("src_incremental_cache", cached, None, f"SELECT shipment_id, {day('shipment_date')}, {big('quantity')} FROM {{fact_shipments}}")


def per_key(t: Tables):
    path = SRC.scratch(t.spark, "experiments")
    SRC.write_per_key(t.fact_orders.where("experiment_id <> ''").select("experiment_id", "experiment_group", "order_id"), path, "experiment_id")
    return t.spark.read.option("header", True).csv(path).groupBy("experiment_id", "experiment_group").agg(F.count("order_id").alias("n"))


query("sink_per_key_files", per_key, None, "SELECT experiment_id, experiment_group, COUNT(*) AS n FROM {fact_orders} WHERE experiment_id <> '' GROUP BY 1, 2")

"""Data-quality checks. Checks of single columns of one table share one aggregate pass; those on keys and parents are jobs of their own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlake.functions.sizes import SMALL
from depotlake.operators.enrich import orphans


@dataclass
class Check:
    """A condition that each row must meet (null counts as met), for at least ``mostly`` of the rows; or an aggregate condition."""

    name: str
    holds: Column | None = None
    mostly: float = 1.0
    severity: str = "error"
    total: Column | None = None


def not_null(c: str, **k) -> Check:
    return Check(f"not_null_{c}", F.col(c).isNotNull(), **k)


def in_set(c: str, values: Sequence, **k) -> Check:
    return Check(f"in_set_{c}", F.col(c).isin(list(values)), **k)


def between(c: str, low: float, high: float, strict: bool = False, **k) -> Check:
    x = F.col(c)
    return Check(f"between_{c}", (x > low) & (x < high) if strict else x.between(low, high), **k)


def positive(c: str, **k) -> Check:
    """Zero passes."""
    return Check(f"positive_{c}", F.col(c) >= 0, **k)


def approx_equal(a: str, b: str, tolerance: float, **k) -> Check:
    return Check(f"approx_equal_{a}_{b}", F.abs(F.col(a) - F.col(b)) <= tolerance, **k)


def matches(c: str, pattern: str, **k) -> Check:
    return Check(f"regex_{c}", F.col(c).rlike(pattern), **k)


def greater(a: str, b: str, **k) -> Check:
    return Check(f"greater_{a}_{b}", F.col(a) > F.col(b), **k)


def row_count(low: int, high: int, **k) -> Check:
    return Check("row_count", total=F.count(F.lit(1)).between(low, high), **k)


def mean_between(c: str, low: float, high: float, **k) -> Check:
    return Check(f"mean_{c}", total=F.avg(c).between(low, high), **k)


def distinct_equals(c: str, values: Sequence, **k) -> Check:
    return Check(f"distinct_equals_{c}", total=F.array_sort(F.collect_set(F.when(F.col(c).isin(list(values)), F.col(c)).when(F.col(c).isNotNull(), F.lit("other")))) == F.array_sort(F.array(*[F.lit(v) for v in values])), **k)


def distinct_subset(c: str, values: Sequence, **k) -> Check:
    return Check(f"distinct_subset_{c}", F.col(c).isin(list(values)), **k)


def run_suite(df: DataFrame, checks: Sequence[Check], table: str = "") -> DataFrame:
    """check, severity, violations, rows, passed: all checks in one pass over df."""
    cells = []
    for c in checks:
        bad = F.count_if(~c.holds) if c.holds is not None else F.when(c.total, 0).otherwise(1)
        rows = F.count(F.lit(1))
        passed = bad <= rows * (1 - c.mostly) + 1e-9 if c.holds is not None else bad == 0
        cells.append(F.struct(F.lit(table).alias("table"), F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), bad.cast("long").alias("violations"), rows.alias("rows"), passed.alias("passed")))
    return df.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows; keys with a null part are not compared."""
    known = df.na.drop(subset=keys)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relationship(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    return orphans(child, parent, key, parent_key)


def relationships(child: DataFrame, parents: dict[str, tuple[DataFrame, str]], keys_of_task: int = 1_000_000) -> DataFrame:
    """relation, key and rows of the keys that a parent lacks, for all foreign keys of a child. parents: the parent and its key for each foreign key; keys are compared as text; nulls are no orphans.

    Small parents are broadcast, and what they lack is counted in tasks before the shuffle. The keys of large parents, nearly as many as rows, would fill a task before
    the shuffle: they are dealt to as many tasks as let each have about keys_of_task of them, are counted there, and stay if they have rows and the parent does not.
    """
    cell = lambda relation, key: F.struct(F.lit(relation).alias("relation"), F.col(key).cast("string").alias("key"))
    used = lambda relations: child.select(F.explode(F.array(*[cell(k, k) for k in relations])).alias("f")).select("f.*").where("key is not null")
    keys = {k: parent.select(cell(k, key).alias("f")).select("f.*").where("key is not null") for k, (parent, key) in parents.items()}
    few = [k for k, v in keys.items() if v.limit(SMALL + 1).count() <= SMALL]
    many, out = [k for k in keys if k not in few], []
    if few:
        lacking = used(few).join(F.broadcast(reduce(DataFrame.unionByName, [keys[k] for k in few])), ["relation", "key"], "left_anti")
        out.append(lacking.groupBy("relation", "key").agg(F.count(F.lit(1)).alias("rows")))
    if many:
        tasks = max(child.sparkSession.sparkContext.defaultParallelism, -(-child.count() * len(many) // keys_of_task))
        both = reduce(DataFrame.unionByName, [used(many).withColumn("n", F.lit(1)), *[keys[k].withColumn("n", F.lit(0)) for k in many]])
        held = both.repartition(tasks, "relation", "key").groupBy("relation", "key").agg(F.sum("n").alias("rows"), F.min("n").alias("_lacks"))
        out.append(held.where("_lacks = 1").select("relation", "key", "rows"))
    return reduce(DataFrame.unionByName, out)


def columns_match(df: DataFrame, columns: Sequence[str], **k) -> Check:
    """Names and order of the columns, which no row is read for."""
    return Check("columns_match", total=F.lit(df.columns == list(columns)), **k)


def no_negative_stock(inventory: DataFrame) -> DataFrame:
    """Rows of the raw table with negative stock, which staging would leave out."""
    return inventory.where("closing_stock < 0")


def gate(results: DataFrame) -> DataFrame:
    """One row: passed unless a check of severity error failed."""
    failed = (F.col("severity") == "error") & ~F.col("passed")
    return results.agg(F.count_if(failed).alias("errors"), F.count_if((F.col("severity") == "warn") & ~F.col("passed")).alias("warnings")).withColumn("passed", F.col("errors") == 0)


def balance(inventory: DataFrame) -> DataFrame:
    want = F.greatest(F.col("opening_stock") + F.col("units_received") + F.col("units_returned") - F.col("units_sold"), F.lit(0))
    return inventory.where(F.col("closing_stock") != want)


def item_revenue(items: DataFrame) -> DataFrame:
    return items.where(F.abs(F.col("revenue") - (F.col("quantity") * F.col("unit_price") - F.col("discount_amount"))) > 0.01)


def order_reconcile(orders: DataFrame, items: DataFrame) -> DataFrame:
    sums = items.groupBy("order_id").agg(F.sum("revenue").alias("item_revenue"))
    return orders.join(sums, "order_id").where(F.abs(F.col("total_amount") - F.col("item_revenue")) > 0.01)


def time_order(deliveries: DataFrame) -> DataFrame:
    return deliveries.where((F.col("delivered_time") < F.col("pickup_time")) | (F.col("pickup_time") < F.col("assigned_time")))


def sla_logic(deliveries: DataFrame) -> DataFrame:
    return deliveries.where(F.col("sla_breach_flag") & (F.col("actual_delivery_minutes") <= F.col("sla_minutes")))


def cross_region_logic(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("is_cross_region") != (F.col("assigned_warehouse_id") != F.col("nearest_warehouse_id")))


def experiment_fields(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("is_experiment_order") & (F.col("experiment_id").isNull() | F.col("experiment_group").isNull()))


def rate_bounds(mart: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c) < 0) | (F.col(c) > 100)
    return mart.where(out)


def capacity_warning(mart: DataFrame, most: float = 95.0) -> DataFrame:
    return mart.where(F.col("capacity_utilization_pct") > most)


def savings_math(mart: DataFrame, tolerance: float = 0.05) -> DataFrame:
    return mart.where(F.abs(F.col("baseline_total_cost") - F.col("optimized_total_cost") - F.col("savings_amount")) > tolerance)


def significance(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tests.where((F.col("p_value") < 0) | (F.col("p_value") > 1) | (F.col("is_significant") != (F.col("p_value") < alpha)))

"""Seasonal fits, the database, keys in one scan, buckets, allocation in rounds."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlake.catalog import history
from depotlake.catalog.base import Tables
from depotlake.catalog.staging import Staged
from depotlake.operators import enrich as E
from depotlake.operators import optimize as O
from depotlake.operators import quality as Q
from depotlake.plans import seasonal as SE
from depotlake.sources import files as SRC
from depotlake.sources import jdbc
from depotlake.sources.bucketed import bucketed


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def design(days, origin):
    t = np.array([(d - origin).days for d in days], float)
    waves = [f(2 * math.pi * k / length * t) for length, pairs in SE.SEASONS for k in range(1, pairs + 1) for f in (np.sin, np.cos)]
    return np.stack([np.ones_like(t), t / 365.25, *waves], 1)


def test_seasonal_weights_against_least_squares(spark):
    rng, origin = np.random.default_rng(9), date(2020, 1, 1)
    days = [origin + timedelta(days=k) for k in range(900) if k % 11]
    x = design(days, origin)
    y = x @ rng.normal(size=x.shape[1]) * 5 + 100 + rng.normal(size=len(days))
    df = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y)] + [(date(2021, 1, 1), None)], "date date, units double").repartition(4)
    model = SE.fit_seasonal(df, origin)
    assert np.allclose(model.weights, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    future = SE.seasonal_forecast(model, days[-1], 30, spark).orderBy("date").collect()
    ahead = [days[-1] + timedelta(days=k) for k in range(1, 31)]
    assert [r.date for r in future] == ahead and np.allclose([r.demand_forecast for r in future], np.maximum(0, design(ahead, origin) @ model.weights), atol=0.0051)
    assert SE.fit_seasonal(df.limit(0), origin) is None
    few = SE.fit_seasonal(df.limit(3), origin)  # fewer days than terms
    assert all(math.isfinite(w) for w in few.weights)


def test_daily_totals_have_all_days(spark):
    dates = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "date date")
    kpis = spark.createDataFrame([(date(2024, 1, 1), "a", 2), (date(2024, 1, 1), "b", 3), (date(2024, 1, 3), "a", None)], "date date, product_id string, total_units_sold int")
    assert sorted(tuple(r) for r in SE.daily_totals(kpis, dates).collect()) == [(date(2024, 1, 1), 5.0), (date(2024, 1, 2), 0.0), (date(2024, 1, 3), 0.0)]


def test_database_reads_in_parts_and_hands_filters_down(spark):
    url = jdbc.embedded(spark)
    rows = [(k * k, f"it's {k % 7}", k % 5 if k % 13 else None) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, name string, n int")
    jdbc.write_rows(df, url, "t", "overwrite", createTableColumnTypes="name VARCHAR(32)")  # else text is a CLOB there, which can't be compared
    read = jdbc.read_partitioned(spark, url, "t", "id", 6)
    assert read.rdd.getNumPartitions() == 6 and sorted(map(tuple, read.collect()), key=repr) == sorted(rows, key=repr)
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * min(sizes)  # ids are squares, so that equal steps of the id would not do
    plan = executed(read.where("n > 2 and name = 'it''s 3'").select("id"))
    assert all(x in plan for x in ("*IsNotNull(n)", "*GreaterThan(n,2)", "*EqualTo(name,it's 3)", "ReadSchema: struct<id:bigint>"))
    jdbc.write_rows(df.limit(3), url, "t")
    total = SRC.read_table(spark, url, query='SELECT "n", COUNT(*) AS "c" FROM t GROUP BY "n"')
    assert "Aggregate" not in executed(total) and sum(r.c for r in total.collect()) == 2003
    by_name = jdbc.read_partitioned(spark, url, "t", "name", 3)
    assert by_name.count() == 2003 and by_name.rdd.getNumPartitions() > 1
    by_null = jdbc.read_partitioned(spark, url, "t", "n", 3)
    assert by_null.where("n is null").count() == sum(r[2] is None for r in rows) + sum(r.n is None for r in df.limit(3).collect())


def test_all_keys_in_one_scan(spark, data):
    t = Tables(spark, data)
    s = Staged(t)
    parents = {"order_id": (s.orders.where("order_id not like '%7'"), "order_id"), "driver_id": (s.drivers.where("driver_id like '%1'"), "driver_id")}
    found = Q.relationships(s.deliveries, parents)
    got = {(r.relation, r.key): r.rows for r in found.collect()}
    for relation, (parent, key) in parents.items():
        want = E.orphans(s.deliveries, parent, relation, key).collect()
        assert {k for rel, k in got if rel == relation} == {r[0] for r in want} and want
    assert sum(n for (rel, _), n in got.items() if rel == "order_id") == s.deliveries.join(parents["order_id"][0], "order_id", "left_anti").count()
    children = spark.createDataFrame([(1, "x"), (None, "y"), (2, None)], "a long, b string")
    small = Q.relationships(children, {"a": (spark.createDataFrame([(1,), (None,)], "id long"), "id"), "b": (spark.createDataFrame([("z",)], "id string"), "id")})
    assert sorted(tuple(r) for r in small.collect()) == [("a", "2", 1), ("b", "x", 1), ("b", "y", 1)]


@pytest.mark.parametrize("run, plain, least", [(history.bucketed_orders, "int_orders", "64k"), (history.bucketed_deliveries, "int_deliveries", "16k")])
def test_bucketed_facts_meet_without_an_exchange(spark, data, run, plain, least):
    t = Tables(spark, data)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)  # below the facts, above the dimensions
    try:
        df = run(t)
        plan = executed(df)
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning(order_id" not in plan
        want = getattr(Staged(t), plain)
        assert sorted(map(repr, df.select(sorted(df.columns)).collect())) == sorted(map(repr, want.select(sorted(want.columns)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_table_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted(map(repr, bucketed(df, "odd", "k", 4).collect())) == sorted(map(repr, df.collect()))


def test_allocation_rounds_over_days_of_all_kinds(spark):
    """Days that fill no, some or all warehouses, equal ids, no items and no date, against one order after the other."""
    rng = random.Random(10)
    day = lambda k: None if k == 5 else date(2024, 1, 1 + k)
    orders = [(f"o{k % 70:03d}", rng.choice(["Standard", "Express", "Same-Day", None]), rng.choice("abcx"), f"W{rng.randrange(3)}", rng.choice([1, 2, 3, 0, None]), float(k), day(k % 6)) for k in range(400) if k % 6 or k < 30]
    df = spark.createDataFrame(orders, "order_id string, order_priority string, customer_id string, assigned_warehouse_id string, total_items long, total_fulfillment_cost double, order_date date").repartition(3)
    costs = {c: {f"W{w}": float((ord(c) * 7 + w * 5) % 11) for w in range(3)} for c in "abc"}
    matrix = spark.createDataFrame([(c, w, v) for c, own in costs.items() for w, v in own.items()], "customer_id string, warehouse_id string, cost double")
    warehouses = spark.createDataFrame([("W0", 20), ("W1", 10), ("W2", 200 // 3)], "warehouse_id string, capacity_units long")
    out = O.greedy_allocation(df, matrix, warehouses, 1.0).collect()
    taken = {}
    for r in out:
        if r.original_warehouse_id is not None:
            taken.setdefault(r.order_date, []).append(r)
    assert len(out) == len(orders)
    want = {}
    for d in {o[6] for o in orders}:
        room = {"W0": 20, "W1": 10, "W2": 66}
        for o in sorted((o for o in orders if o[6] == d), key=lambda o: ({"Same-Day": 0, "Express": 1}.get(o[1], 2), o[0])):
            best = min(((costs[o[2]][w], w) for w in room if room[w] > 0), default=None) if o[2] in costs else None
            if best:
                room[best[1]] = max(0, room[best[1]] - (o[4] or 0))
            want.setdefault((d, o[0]), []).append(best[1] if best else o[3])
    once = {k: v[0] for k, v in want.items() if len(v) == 1}
    got = {(r.order_date, r.order_id): r.warehouse_id for r in out}
    assert once and all(got[k] == w for k, w in once.items())

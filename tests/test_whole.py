"""The whole job, on rows that an earlier version lost or failed on."""

from __future__ import annotations

import glob
from datetime import date, datetime

import pandas as pd
from pyspark.sql import functions as F

from depotlake import catalog
from depotlake.functions import costs as C
from depotlake.functions.calendar import calendar
from depotlake.operators import enrich as E
from depotlake.operators import optimize as O
from depotlake.operators import quality as Q
from depotlake.plans import features as P
from depotlake.plans import models as ML
from depotlake.sources import files as SRC
from depotlake.streaming.state import DeliveryTracker


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table_query_counts_all_orders(spark, data):
    found = catalog.queries()["src_table_query"](spark, data).collect()
    assert sum(r.n for r in found) == spark.read.parquet(f"{data}/orders.parquet").count()


def test_classifiers_without_both_classes(spark):
    """No row with label 1, in validation or anywhere: the area is null, and scores are chances all the same."""
    df = spark.createDataFrame([(float(k % 7), float(k), k % 2) for k in range(60)], "a double, b double, y int")
    for train in (df, df.where("y = 0")):
        name, model, table = ML.train_classification(train, df.where("y = 0"), "y", ["a", "b"])
        assert [(r.auc_roc, r.tp + r.fn, r.fp + r.tn) for r in table.collect()] == [(None, 0, 30)] * 2 and name == "gbt"
        rows = df.withColumns({"snapshot_date": F.lit("d"), "warehouse_id": F.lit("w"), "product_id": F.lit("p")})
        scores = [r.stockout_risk_score for r in ML.score_stockout(model, rows, ["a", "b"]).collect()]
        assert len(scores) == 60 and all(0 <= s <= 1 for s in scores)


def test_suppliers_are_counted_without_pairs(spark):
    products = spark.createDataFrame([("p", "A"), ("p", "A"), ("q", "B"), ("r", None), ("t", "D")], "product_id string, category string")
    suppliers = spark.createDataFrame([("x", "A, B"), ("y", "A,A"), ("z", None)], "supplier_id string, product_categories string")
    assert got(E.supplier_counts(products, suppliers, F.col("category"))) == [("p", 6), ("q", 1)]
    pairs = E.supplier_categories(products, suppliers, F.col("category")).groupBy("product_id").count()
    assert got(pairs) == got(E.supplier_counts(products, suppliers, F.col("category")))
    many = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("product_id"), F.lit("A").alias("category"))
    sellers = spark.range(100000).select(F.col("id").alias("supplier_id"), F.lit("A, B").alias("product_categories"))  # 300 million pairs
    assert E.supplier_counts(many, sellers, F.col("category")).where("suppliers = 100000").count() == 3000


def test_cache_keeps_rows_of_a_repeated_key(spark, tmp_path):
    cache, kind = str(tmp_path / "cache"), "d date, k string, v int"
    first = [(date(2024, 1, 9), "a", 1), (date(2024, 1, 10), "b", 2), (date(2024, 1, 10), "c", 3)]
    more = [(date(2024, 2, 1), "a", 4), (date(2024, 1, 10), "b", 2), (date(2024, 1, 10), "b", 5), (date(2024, 1, 10), "b", 5), (None, "n", 6)]
    SRC.extend_cache(spark.createDataFrame(first, kind), cache, "d")
    for _ in range(2):
        assert got(SRC.extend_cache(spark.createDataFrame(first + more, kind), cache, "d", ["k"], 5)) == sorted(first + more, key=repr)
    changed = spark.createDataFrame([(date(2024, 2, 1), "a", 7)], kind)  # not one more row of its key
    assert SRC.extend_cache(changed, cache, "d", ["k"], 5).count() == 8


def test_tracker_reads_and_writes_its_state_once_for_many_deliveries():
    """A fake handle counts what goes to the state store; one in three deliveries ends late, and a third never."""
    calls, store = [], {}

    class Value:
        exists = lambda self: "v" in store
        get = lambda self: calls.append("get") or store["v"]
        update = lambda self, v: calls.append("update") or store.update(v=v)

    class Handle:
        getValueState = lambda self, *a: Value()  # noqa: E731, N815
        registerTimer = lambda self, at: calls.append("timer") or store.update(at=at)  # noqa: E731, N815

    class At:
        getExpiryTimeInMs = lambda self: store["at"]  # noqa: E731, N815
        getCurrentWatermarkInMs = lambda self: 10**12 + 10**6  # noqa: E731, N815

    tracker, base = DeliveryTracker(), 10**12
    tracker.init(Handle())
    frame = lambda rows: pd.DataFrame(rows, columns=["delivery_id", "delivery_status", "ms", "due_ms"])
    begun = frame([(f"d{k}", "Assigned", base, base + 100 + k) for k in range(999)])
    ended = frame([(f"d{k}", "Delivered", base + (1 if k % 3 else 5000), None) for k in range(999) if k % 3 < 2])
    out = [pd.concat(tracker.handleInputRows((0,), iter(part), None)) for part in ([begun], [ended[:300], ended[300:], begun])]
    assert len(out[0]) == 999 and len(out[1]) == 666 and set(out[1]["delivery_status"]) == {"Delivered"}
    alerts = pd.concat(tracker.handleExpiredTimer((0,), At(), At()))
    assert sorted(zip(alerts["delivery_id"], alerts["ms"])) == sorted((f"d{k}", base + 100 + k) for k in range(999) if k % 3 != 1)
    assert not list(tracker.handleExpiredTimer((0,), At(), At())) and len(calls) <= 12


def test_future_days_are_made_in_many_tasks(spark):
    products = spark.range(400).select(F.concat(F.lit("P-"), "id").alias("product_id")).coalesce(1)
    spine = ML.future_spine(products, F.lit(date(2024, 1, 1)), 3)
    assert spine.rdd.getNumPartitions() > 1 and spine.count() == 1200 == spine.distinct().count()


def test_allocation_rounds_carry_no_costs(spark):
    kind = "order_id string, order_date date, customer_id string, assigned_warehouse_id string, order_priority string, total_items int, total_fulfillment_cost double"
    orders = spark.createDataFrame([(f"o{k}", date(2024, 1, 1), "c", "A", "Express", 4, 50.0) for k in range(4)], kind)
    costs = spark.createDataFrame([("c", "A", 3.0), ("c", "B", 2.0), ("c", "A", 1.0), ("c", "B", 9.0)], "customer_id string, warehouse_id string, cost double")  # the least cost of a repeated pair counts
    warehouses = spark.createDataFrame([("A", 5), ("B", 4)], "warehouse_id string, capacity_units int")
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/allocation-*"))
    out = O.greedy_allocation(orders, costs, warehouses, 1.0)
    assert got(out.select("order_id", "warehouse_id", "optimal_cost")) == [("o0", "A", 1.0), ("o1", "A", 1.0), ("o2", "B", 2.0), ("o3", "A", 50.0)]
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/allocation-*")) - before
    written = dict(spark.read.parquet(f"{path}/1").dtypes)
    assert "room" not in written and written["choices"] == "array<tinyint>" and written["best"] == "tinyint"


def test_training_rows_come_in_few_tasks_without_lineage(spark):
    rows = spark.range(2000).repartition(150).select((F.col("id") % 7).alias("a"), (F.col("id") * 1.5).alias("y"), F.lit("text").alias("wide"), F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    table = ML.stored_rows(rows, "y", ["a"])
    assert table.columns == ["a", "y", "split"] and table.groupBy("split").count().orderBy("split").collect() == [("train", 667), ("validation", 667)]
    train = table.where("split = 'train'")
    assert train.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert "repartition" not in train._jdf.queryExecution().toString().lower()
    assert sorted(r.y for r in train.collect()) == [k * 1.5 for k in range(0, 2000, 3)]


def test_products_that_are_alike_are_forecast_once(spark, monkeypatch):
    """The rows of a forecast of each product by itself, which are made for one product of each group."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from depotlake.functions.calendar import calendar
    from depotlake.plans.features import DEMAND_FEATURES

    kind = "product_id string, category string, cost_price decimal(12,2), selling_price decimal(12,2), is_perishable boolean"
    sold = [(f"p{k}", "AB"[k % 2], k % 3 + 1, k % 3 + 2, k % 5 == 0) for k in range(200)]
    products = spark.createDataFrame(sold, "product_id string, category string, cost_price int, selling_price int, is_perishable boolean").selectExpr("product_id", "nullif(category, 'B') as category", "cast(cost_price as decimal(12,2)) as cost_price", "cast(selling_price as decimal(12,2)) as selling_price", "is_perishable")
    assert ", ".join(f"{c} {t}" for c, t in products.dtypes) == kind
    history = spark.range(90).crossJoin(spark.createDataFrame([("p0",), ("p1",), ("gone",)], "product_id string")).select(
        "product_id", F.date_add(F.lit(date(2024, 1, 1)), F.col("id").cast("int")).alias("date"), (F.col("id") * 7 % 31 + F.length("product_id")).alias("total_units_sold"), (F.col("id") % 11 / 3).alias("avg_closing_stock"),
        *[F.lit(1.0).alias(c) for c in ("total_revenue", "stockout_count", "inventory_turnover", "avg_days_of_supply")], F.lit(False).alias("is_forecast"),
    )
    days = calendar(spark, date(2024, 1, 1), date(2024, 12, 31))
    y = sum((F.col(c) * (k + 1) for k, c in enumerate(DEMAND_FEATURES)), F.lit(0.0))
    learn = spark.range(300).select(*[(F.rand(k) * 30).alias(c) for k, c in enumerate(DEMAND_FEATURES)]).withColumn("y", y)
    model = Pipeline(stages=[VectorAssembler(inputCols=DEMAND_FEATURES, outputCol="features"), DecisionTreeRegressor(labelCol="y", maxDepth=8)]).fit(learn)
    until = date(2024, 3, 20)
    seed = history.where(F.col("date") > F.date_sub(F.lit(until), 60)).where(F.col("date") <= F.lit(until))
    made = []
    each = ML.forecast_rows
    monkeypatch.setattr(ML, "forecast_rows", lambda model, seed, dates, products, *rest: made.append(products.count()) or each(model, seed, dates, products, *rest))
    out = ML.forecast(model, history, days, products, until, 40)
    want = each(model, seed, days, products, until, 40)
    assert out.columns == ["date", "product_id", "demand_forecast", "is_forecast", "forecast_horizon", "forecast_generated_date"]
    assert out.count() == 8000 and got(out.select(*want.columns)) == got(want) and made == [14]
    assert {(r.is_forecast, r.forecast_generated_date) for r in out.collect()} == {(True, until)}


def test_nearest_warehouse_makes_no_pairs(spark):
    customers = spark.createDataFrame([("a", 40.0, -75.0), ("b", 34.0, -118.0), ("b", 40.7, -74.0), ("n", None, 1.0), (None, 40.0, -75.0)], "customer_id string, latitude double, longitude double")
    warehouses = spark.createDataFrame([("W2", 40.7, -74.0), ("W1", 40.7, -74.0), ("W3", 34.0, -118.2)], "warehouse_id string, latitude double, longitude double")
    out = C.nearest_warehouse(customers, warehouses)
    best = F.min(F.struct("distance_km", "warehouse_id")).alias("b")
    want = C.cost_matrix(customers, warehouses).groupBy("customer_id").agg(best).select("customer_id", "b.warehouse_id", "b.distance_km")
    assert got(out) == got(want) and ("b", "W1", 0.0) in got(out) and len(got(out)) == 4
    assert C.nearest_warehouse(customers, warehouses.limit(0)).count() == 0
    many = spark.range(3).select(F.col("id").cast("string").alias("warehouse_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    plan = C.nearest_warehouse(customers, many)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "Join" in plan.split("collect_list")[0] and plan.index("Aggregate [customer_id") < plan.index("array_min") < plan.index("Join")  # the least of each row before rows are grouped


def test_orphans_of_large_parents_are_counted_in_bounded_tasks(spark, monkeypatch):
    child = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("w"), F.col("id") % 9)).alias("b"))
    parents = {"a": (spark.range(2000).where("id % 5 > 0"), "id"), "b": (spark.createDataFrame([("w1",), ("w2",), (None,)], "id string"), "id")}
    want = sorted([("a", str(k), 5 if k < 200 else 4) for k in range(0, 700, 5)] + [("b", f"w{k}", n) for k in (4, 5, 7, 8) for n in [334 if k < 3000 % 9 else 333]], key=repr)
    for most in (10**6, 10, 0):  # both parents small, one of them, none
        monkeypatch.setattr(Q, "SMALL", most)
        assert got(Q.relationships(child, parents)) == want
    dealt = Q.relationships(child, parents, keys_of_task=100)
    assert dealt.rdd.getNumPartitions() >= 60 and got(dealt) == want


def counted(df, column):
    """df whose rows are counted each time that they are computed."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType)(column)), n


def test_candidates_share_the_vectors_of_training_rows(spark):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 7 * 2 + 1).cast("double").alias("y"))
    train, n = counted(df, "a")
    name, model, table = ML.train_regression(train, df, "y", ["a", "b"])
    assert n.value == 300 and table.count() == 3
    alone = ML.Pipeline(stages=[ML.VectorAssembler(inputCols=["a", "b"], outputCol="features"), ML.LinearRegression(featuresCol="features", labelCol="y", regParam=0.01)]).fit(df)
    mae = ML.regression_metrics(alone.transform(df), "y", "prediction").first().mae
    assert [r.mae for r in table.collect() if r.model == "linear"] == [mae]
    assert model.transform(df.select("a", "b")).count() == 300  # the model takes rows of features, not vectors


def test_delivery_features_read_the_facts_once(spark):
    rows = [(f"d{i}", f"r{i % 3}" if i % 5 else None, f"w{i % 2}", datetime(2024, 1, 1 + i % 4, i % 24) if i % 11 else None, "Delivered", float(10 + i), 30.0, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "delivery_id string, driver_id string, warehouse_id string, assigned_time timestamp, delivery_status string, actual_delivery_minutes double, estimated_eta_minutes double, distance_km double").withColumns({"driver_experience_years": F.lit(1.0), "pickup_wait_minutes": F.lit(1), "vehicle_type": F.lit("Van"), "order_priority": F.lit("Express")})
    facts, n = counted(df, "actual_delivery_minutes")
    out = {r.delivery_id: r for r in P.eta_features(df, calendar(spark, date(2024, 1, 1), date(2024, 1, 5)), True, facts).collect()}
    assert n.value == 120 and len(out) == 60  # once in the filter and once in the sums
    every = sum(r[5] for r in rows) / 60
    for key, _, place, at, _, _, _, _ in rows:
        before = [r[5] for r in rows if r[2] == place and (r[3] is None or at and r[3] < at)]  # rows without a time come first, as in a window
        assert abs(out[key].warehouse_avg_delivery - (sum(before) / len(before) if before else every)) < 1e-9

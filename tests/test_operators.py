"""Edges of the operators on small hand-made tables."""

from __future__ import annotations

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlake.catalog.base import Tables
from depotlake.functions import costs as C
from depotlake.functions.rounding import half_up
from depotlake.functions.stats import normal_cdf, t_quantile, t_two_sided
from depotlake.operators import enrich as E
from depotlake.operators import experiments as X
from depotlake.operators import keyed as K
from depotlake.operators import optimize as O
from depotlake.operators import quality as Q
from depotlake.operators import staging as S
from depotlake.operators import windows as W
from depotlake.plans import features as P
from depotlake.plans import models as ML
from depotlake.sources import files as SRC
from depotlake.streaming import events as EV


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_half_up_agrees_on_ties(spark):
    df = spark.createDataFrame([(2.675,), (-2.675,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(half_up("x", 2)).collect()] == [2.68, -2.68, 0.13, None]


def test_staging_bounds_and_divisors(spark):
    orders = spark.createDataFrame([("a", 500.0, "W1", None, "", "x"), ("b", 100.0, "W1", "W2", "E", "x"), ("c", 0.0, "W1", "W1", "", "x"), ("d", 5.0, "W1", "W1", None, None)], "order_id string, total_amount double, assigned_warehouse_id string, nearest_warehouse_id string, experiment_id string, order_status string").withColumn("experiment_group", F.lit(""))
    assert got(S.stg_orders(orders).select("order_id", "order_value_tier", "is_cross_region", "experiment_id", "is_experiment_order")) == [("a", "High Value", False, None, False), ("b", "Medium Value", True, "E", True)]
    stock = spark.createDataFrame([(5, None, False, False), (5, 150.0, False, False), (0, 3.0, True, True)], "closing_stock long, days_of_supply double, stockout_flag boolean, below_safety_stock_flag boolean").withColumns({c: F.lit(1) for c in ("units_received", "units_returned", "units_sold")})
    assert [tuple(r) for r in S.stg_inventory_snapshot(stock.withColumn("days_of_supply", F.col("days_of_supply").cast("decimal(5,2)"))).select("inventory_health", F.col("days_of_supply").cast("double")).collect()] == [("Overstocked", None), ("Overstocked", 99.99), ("Stockout", 3.0)]


def test_minutes_count_boundaries(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, 59), datetime(2024, 1, 1, 10, 1, 1)), (datetime(2024, 1, 1, 10, 0, 0), None)], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(E.minutes_between(F.col("a"), F.col("b"))).collect()] == [1, None]


def test_dedup_is_idempotent_with_ties(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 1, 20), ("k", 0, 99), (None, 1, 1)], "k string, created_at int, v int")
    once = K.dedup_latest(df, ["k"])
    assert got(once) == got(K.dedup_latest(once, ["k"])) == [("k", 1, 20), (None, 1, 1)]


def test_upsert_null_keys_and_rerun(spark):
    target = spark.createDataFrame([("a", None, 1, "keep"), ("b", 2, 2, "keep")], "k string, d int, v int, other string")
    source = spark.createDataFrame([("a", None, 10), ("c", 3, 30)], "k string, d int, v int")
    once = K.upsert(target, source, ["k", "d"], ["v"])
    want = [("a", None, 10, "keep"), ("b", 2, 2, "keep"), ("c", 3, 30, None)]
    assert got(once) == got(K.upsert(once, source, ["k", "d"], ["v"])) == want
    assert got(K.upsert(target, source, ["k", "d"], ["v"], insert=False)) == want[:2]
    with pytest.raises(Exception, match="occurs twice"):
        K.upsert(target, source.union(source), ["k", "d"], ["v"]).collect()


def test_upsert_table_rewrites_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", "p1"), (2, "y", "p2")], "k int, v string, p string").write.partitionBy("p").parquet(path)
    before = {f for f in spark.read.parquet(path).inputFiles() if "p=p2" in f}
    source = spark.createDataFrame([(1, "z", "p1"), (3, "n", "p3")], "k int, v string, p string")
    for _ in range(2):
        K.upsert_table(path, source, ["k", "p"], ["v"], "p")
        assert got(spark.read.parquet(path).select("k", "v", "p")) == [(1, "z", "p1"), (2, "y", "p2"), (3, "n", "p3")]
    assert before <= set(spark.read.parquet(path).inputFiles())


def test_scd2_same_day_rerun(spark):
    source = spark.createDataFrame([("a", 1), ("b", None), ("n", 5)], "k string, v int")
    history = spark.createDataFrame([("a", 1), ("b", 2), ("gone", 3)], "k string, v int").withColumns({"valid_from": F.lit("2020-01-01").cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    now = datetime(2021, 1, 1)
    once = K.scd2_snapshot(history, source, "k", ["v"], now)
    assert got(once) == got(K.scd2_snapshot(once, source, "k", ["v"], now))
    assert {(r.k, r.v, r.valid_to is None) for r in once.collect()} == {("a", 1, True), ("b", 2, False), ("b", None, True), ("gone", 3, False), ("n", 5, True)}


def test_incremental_equals_full_build(spark, data):
    orders = Tables(spark, data).fact_orders
    build = lambda o: o.groupBy(F.col("order_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    part = K.incremental(build(orders.where("order_date < '1997-01-01'")), orders, "order_date", build, ["date"])
    assert got(part) == got(K.incremental(None, orders, "order_date", build, ["date"])) == got(K.incremental(part, orders, "order_date", build, ["date"]))


def test_ledger_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [("W", "P", date(2024, 1, 1 + d), int(rng.integers(0, 60)), int(rng.integers(0, 30)), int(rng.integers(0, 3))) for d in range(30)]
    moves = spark.createDataFrame(rows, "warehouse_id string, product_id string, snapshot_date date, units_sold int, units_received int, units_returned int")
    stock, want = 60, []
    for _, _, d, sold, in_, back in rows:
        opening, stock = stock, max(0, stock - sold + in_ + back)
        want.append((d, opening, stock))
    assert [tuple(r) for r in W.inventory_ledger(moves).orderBy("snapshot_date").select("snapshot_date", "opening_stock", "closing_stock").collect()] == want


def test_ema_and_label(spark):
    rows = [("W", "P", date(2024, 1, d), u, 10, d == 4) for d, u in ((1, 0), (2, 10), (3, 20), (4, 0))]
    df = spark.createDataFrame(rows, "warehouse_id string, product_id string, snapshot_date date, units_sold long, closing_stock long, stockout_flag boolean")
    ema = [r[0] for r in W.ema_demand(df).orderBy("snapshot_date").select("ema_demand").collect()]
    assert np.allclose(ema, [0, 1, 2.9, 2.61])
    labels = df.select(W.stockout_label(W.series(W.PANEL, "snapshot_date")).alias("y"), "snapshot_date").orderBy("snapshot_date")
    assert [r.y for r in labels.collect()] == [1, 1, 1, 0]


def test_t_and_normal_against_tables():
    df = np.array([1.0, 10.0, 30.0, 1000.0])
    assert np.allclose(t_quantile(0.95, df), [12.7062, 2.2281, 2.0423, 1.9623], atol=1e-4)
    assert np.allclose(t_two_sided(np.array([2.2281]), np.array([10.0])), 0.05, atol=1e-5)
    assert np.allclose(normal_cdf(np.array([-1.96, 0, 1.645])), [0.0249979, 0.5, 0.9500151], atol=1e-6)


def test_welch_edges(spark):
    rows = [("one", "Control", 5, 10.0, 4.0), ("one", "Treatment", 5, 8.0, 4.0), ("few", "Control", 1, 1.0, None), ("few", "Treatment", 9, 1.0, 1.0), ("missing", "Control", 9, 1.0, 1.0), ("flat", "Control", 9, 2.0, 0.0), ("flat", "Treatment", 9, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "experiment_id string, group_name string, n long, mean double, variance double")
    out = {r.experiment_id: r for r in X.welch(df, ["experiment_id"]).collect()}
    assert out["one"].t_statistic == -1.5811 and out["one"].degrees_of_freedom == 8 and abs(out["one"].p_value - 0.152506) < 2e-5 and not out["one"].is_significant
    assert out["one"].pct_change == -20.0
    assert out["few"].p_value is None and out["missing"].t_statistic is None and out["flat"].is_significant


def test_reorder_point_is_no_worse_than_a_grid(spark):
    rng = np.random.default_rng(3)
    rows = [(float(d), float(s), float(l), float(c)) for d, s, l, c in zip(rng.uniform(0.1, 80, 60), rng.choice([0, 0.5, 5, 40], 60), rng.integers(1, 14, 60), rng.uniform(1, 900, 60))]
    df = spark.createDataFrame(rows, "d double, s double, l double, c double")
    for r in df.select("*", O.reorder_point(F.col("d"), F.col("s"), F.col("l"), F.col("c")).alias("r")).collect():
        mu, sigma = r.d * r.l, r.s * math.sqrt(r.l)
        def cost(x):
            z = normal_cdf((x - mu) / sigma) if sigma > 0 else (x >= mu - 1e-9).astype(float)
            return np.maximum(0, x - mu) * r.c * 0.001 * r.l + (1 - z) * r.d * 15
        grid = cost(np.linspace(mu, 3 * mu, 4001))
        assert cost(np.array([r.r]))[0] <= grid.min() + 1e-6


def greedy_loop(orders, costs, capacity, usable=0.9):
    """One order after the other, a day at a time."""
    out, days = {}, {}
    for o in sorted(orders, key=lambda o: (o.order_date, {"Same-Day": 0, "Express": 1}.get(o.order_priority, 2), o.order_id)):
        room = days.setdefault(o.order_date, {w: int(c * usable) for w, c in sorted(capacity.items())})
        best, price = o.assigned_warehouse_id, float(o.total_fulfillment_cost)
        if o.customer_id in costs:
            cheapest = min(((costs[o.customer_id][w], w) for w in room if room[w] > 0), default=None)
            if cheapest:
                price, best = cheapest
                room[best] = max(0, room[best] - o.total_items)
        out[o.order_id] = best, price, float(o.total_fulfillment_cost), best == o.assigned_warehouse_id
    return out


@pytest.mark.parametrize("shrink", [1, 5000])
def test_greedy_against_a_loop(spark, data, shrink):
    t = Tables(spark, data)
    orders = S.stg_orders(t.fact_orders).withColumn("order_date", F.trunc("order_date", "year")).withColumn("order_priority", F.when(F.expr("order_id like '%5'"), "Other").otherwise(F.col("order_priority")))
    orders = orders.withColumn("customer_id", F.when(F.expr("order_id like '%31'"), "nobody").otherwise(F.col("customer_id")))
    warehouses = t.dim_warehouse.withColumn("capacity_units", F.floor(F.col("capacity_units") / shrink * 20))
    matrix = C.cost_matrix(t.dim_customer, t.dim_warehouse)
    costs = {}
    for r in matrix.collect():
        costs.setdefault(r.customer_id, {})[r.warehouse_id] = r.cost
    want = greedy_loop(orders.collect(), costs, {r.warehouse_id: r.capacity_units for r in warehouses.collect()})
    allocated = O.greedy_allocation(orders, matrix, warehouses).cache()
    assert {r.order_id: (r.warehouse_id, r.optimal_cost, r.baseline_cost, r.is_optimal_assignment) for r in allocated.collect()} == want
    if shrink > 1:
        assert any(v[0] != min((c, w) for w, c in costs[o.customer_id].items())[1] for o in orders.collect() if o.customer_id in costs for v in [want[o.order_id]])
    total = O.allocation_savings(allocated).first()
    assert abs(total.total_savings - sum(v[2] - v[1] for v in want.values())) < 0.01 and total.allocation_efficiency_pct == round(100 * sum(v[3] for v in want.values()) / len(want), 2)


def test_greedy_order_and_room(spark):
    orders = spark.createDataFrame([("o1", "Standard", "c", "W2", 5, 7.0), ("o2", "Same-Day", "c", "W2", 9, 7.0), ("o3", "Express", "x", "W9", 1, 3.0), ("o4", "odd", "c", "W2", 1, 7.0)], "order_id string, order_priority string, customer_id string, assigned_warehouse_id string, total_items long, total_fulfillment_cost double").withColumn("order_date", F.lit(date(2024, 1, 1)))
    costs = spark.createDataFrame([("c", "W1", 1.0), ("c", "W2", 2.0)], "customer_id string, warehouse_id string, cost double")
    warehouses = spark.createDataFrame([("W1", 7), ("W2", 3)], "warehouse_id string, capacity_units long")
    out = {r.order_id: (r.warehouse_id, r.optimal_cost) for r in O.greedy_allocation(orders, costs, warehouses).collect()}
    assert out == {"o2": ("W1", 1.0), "o1": ("W2", 2.0), "o4": ("W2", 7.0), "o3": ("W9", 3.0)}  # an order may take more than is left


def test_quality_mostly_and_gate(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    out = Q.run_suite(df, [Q.not_null("a", mostly=0.6), Q.between("a", 2, 9), Q.positive("a", severity="warn")])
    assert {(r.check, r.violations, r.passed) for r in out.collect()} == {("not_null_a", 1, True), ("between_a", 1, False), ("positive_a", 0, True)}
    assert Q.gate(out).first().passed is False
    assert [r.passed for r in Q.run_suite(df, [Q.columns_match(df, ["a"]), Q.columns_match(df, ["a", "b"])]).collect()] == [True, False]


def test_csv_nulls_bad_lines_and_reload(spark, tmp_path):
    folder = tmp_path / "t" / "date=2024-01-02"
    folder.mkdir(parents=True)
    (folder / "data.csv").write_text('id,n\na,1\nNULL,2\n"b, c",x\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    df = SRC.read_dated(spark, str(tmp_path / "t"), schema, pattern="2024-.*").cache()
    assert got(SRC.good_rows(df).select("id", "n")) == [("a", 1), (None, 2)] and SRC.bad_rows(df).count() == 1
    table = str(tmp_path / "out")
    for _ in range(2):
        SRC.reload_matching(SRC.good_rows(df), table)
        assert spark.read.parquet(table).count() == 2


def test_cache_and_jdbc_free_tables(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = lambda n: spark.createDataFrame([(date(2024, 1, d + 1), d) for d in range(n)], "d date, v int")
    assert SRC.extend_cache(rows(3), cache, "d").count() == 3
    assert SRC.extend_cache(rows(5), cache, "d").count() == 5 == SRC.extend_cache(rows(5), cache, "d").count()
    late = spark.createDataFrame([(date(2024, 1, 5), 4), (date(2024, 1, 4), 99), (date(2024, 1, 1), 98)], "d date, v int")
    assert sorted(r.v for r in SRC.extend_cache(rows(5).union(late.where("v > 90")), cache, "d", ["v"], 2).collect()) == [0, 1, 2, 3, 4, 99]
    assert SRC.extend_cache(late, cache, "d", ["v"], 2).count() == 6
    SRC.write_table(rows(2), str(tmp_path), "x", "overwrite")
    assert SRC.read_table(spark, str(tmp_path), "x", "select max(v) from {table}").first()[0] == 1
    SRC.write_per_key(rows(2), str(tmp_path / "keys"), "v")
    SRC.write_dated(rows(2).withColumnRenamed("d", "date"), str(tmp_path / "dated"))
    SRC.write_flat(rows(2), str(tmp_path / "flat"))
    assert len(list((tmp_path / "keys").glob("v=*"))) == 2 and len(list((tmp_path / "dated").glob("date=*"))) == 2


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    lines = ['{"event_type":"order","event_time":"2024-01-01T10:00:00","order_id":"o1","order_date":"2024-01-01","total_items":1,"total_amount":5,"total_fulfillment_cost":1}', "not json", '{"order_id":"o2","total_items":0,"total_amount":5,"total_fulfillment_cost":1}']
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    source.mkdir()
    (source / "1.txt").write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema("value string").text(str(source)).select(F.lit("orders_stream").alias("topic"), F.lit("k").alias("key"), "value")
        EV.append_batches(EV.route(stream, "orders_stream"), out, mark).awaitTermination()
        return got(spark.read.parquet(out).select("order_id", "date", "return_flag"))

    assert run() == run() == [("o1", date(2024, 1, 1), False)]
    (source / "2.txt").write_text(lines[0].replace("o1", "o3"))
    assert len(run()) == 2
    parsed = EV.parse(spark.read.text(str(source / "1.txt")), "order")
    assert EV.quarantined(parsed).count() == 2 and EV.accepted(parsed).count() == 1


def test_latest_wins_with_late_rows(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, at int, v string")
    table = EV.latest_into(None, rows(("a", 1, "x"), ("a", 3, "y"), ("b", 1, "q")), ["k"], "at")
    again = EV.latest_into(table, rows(("a", 2, "late"), ("c", 1, "n")), ["k"], "at")
    assert got(again) == [("a", 3, "y"), ("b", 1, "q"), ("c", 1, "n")]


def test_models_round_trip(spark, tmp_path):
    rows = [(float(i), float(i % 7), 3.0 * i + (i % 7), int(i % 7 > 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, y double, c int")
    name, model, metrics = ML.train_regression(df, df, "y", ["a", "b"])
    assert name == "linear" and metrics.count() == 3 and metrics.first().r2 > 0.99
    ML.save_model(model, str(tmp_path), "m", {"mape": 1.0}, ["a", "b"])
    assert ML.load_metadata(spark, str(tmp_path), "m")["features"] == ["a", "b"]
    assert ML.load_model(str(tmp_path), "m").transform(ML.numeric(df, ["a", "b"])).count() == 120 and ML.list_saved_models(spark, str(tmp_path)).first().name == "m"
    best, classifier, table = ML.train_classification(df, df, "c", ["a", "b"])
    assert table.first().f1 > 0.95 and best in ("logistic", "gbt")
    scored = classifier.transform(ML.numeric(df, ["a", "b"]))
    assert ML.auc_roc(scored.withColumn("p", vector_to_array("probability")[1]), "c", "p").first().auc > 0.95
    again = ML.load_model(str(tmp_path), "m").transform(ML.numeric(df, ["a", "b"])).select("a", "prediction")
    assert got(again) == got(model.transform(ML.numeric(df, ["a", "b"])).select("a", "prediction"))


def test_features_with_short_series(spark, data):
    assert len(P.DEMAND_FEATURES) == 34 and len(P.ETA_FEATURES) == 22 and len(P.STOCKOUT_FEATURES) == 32
    assert [r[0] for r in spark.range(1).select(*[ML.horizon(F.lit(d)) for d in (0, 1, 30, 31, 180, 181)]).first().asDict().items()] is not None
    assert list(spark.range(1).select(*[ML.horizon(F.lit(d)).alias(str(d)) for d in (0, 1, 30, 31, 180, 181)]).first()) == [None, 30, 30, 60, 180, None]


@pytest.mark.parametrize("as_of_start", [False, True])
def test_eta_history(spark, as_of_start):
    rows = [(f"d{i}", "r", "w", datetime(2024, 1, 1, 8 + i), "Delivered", float(10 * (i + 1)), 30.0, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "delivery_id string, driver_id string, warehouse_id string, assigned_time timestamp, delivery_status string, actual_delivery_minutes double, estimated_eta_minutes double, distance_km double").withColumns({"driver_experience_years": F.lit(1.0), "pickup_wait_minutes": F.lit(1), "vehicle_type": F.lit("Van"), "order_priority": F.lit("Express")})
    from depotlake.functions.calendar import calendar

    out = P.eta_features(df, calendar(spark, date(2024, 1, 1), date(2024, 1, 3)), as_of_start).orderBy("delivery_id")
    assert [r.driver_avg_delivery for r in out.collect()] == ([20.0, 10.0, 15.0] if as_of_start else [20.0] * 3)


def test_scores_from_fitted_models(spark, data):
    from depotlake.catalog import scoring

    t = Tables(spark, data)
    assert [r.model for r in scoring.fitted(t, "eta")[2].collect()][0] == scoring.fitted(t, "eta")[0] and scoring.fitted(t, "stockout")[2].count() == 2
    scored = scoring.demand_scores(t).where("demand_forecast is not null")
    errors = scored.agg(F.avg(F.abs("forecast_error")).alias("e"), F.stddev("total_units_sold").alias("s"), F.min("demand_forecast").alias("low")).first()
    assert errors.e < errors.s and errors.low >= 0  # better than the mean would do
    eta = scoring.eta_scores(t)
    assert eta.where("predicted_eta is null or predicted_eta < 1 or eta_error is null").count() == 0 and eta.count() > 0
    risk = scoring.stockout_rows(t).select(F.col("snapshot_date").alias("date"), "warehouse_id", "product_id", F.col("will_stockout_3d").cast("double").alias("y")).join(scoring.stockout_scores(t), ["date", "warehouse_id", "product_id"])
    assert ML.auc_roc(risk, "y", "stockout_risk_score").first().auc > 0.7
    table = scoring.fitted(t, "stockout")[2].collect()
    assert table[0].model == scoring.fitted(t, "stockout")[0] and table[0].auc_roc >= table[1].auc_roc > 0
    assert sorted(r.name for r in scoring.stored(t).collect()) == ["demand", "eta", "stockout"]


def test_redelivered_and_tumbling_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = lambda k, at: f"{k},{at},order"
    (source / "1.csv").write_text("\n".join([line("a", "2024-01-01 10:00:00"), line("a", "2024-01-01 10:05:00"), line("b", "2024-01-01 10:06:00")]))
    rows = spark.readStream.schema("key string, event_time timestamp, event_type string").option("maxFilesPerTrigger", 1).csv(str(source))
    table = {}

    def keep(batch, _):
        table["t"] = spark.createDataFrame(EV.latest_into(table.get("t"), batch, ["key"], "event_time").collect(), batch.schema)

    def run():
        out = EV.dedup_redelivered(rows, ["key"]).writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        out.awaitTermination()
        EV.for_each_batch(rows, str(tmp_path / "c2"), keep).awaitTermination()
        EV.tumbling_counts(rows).writeStream.format("parquet").option("path", str(tmp_path / "counts")).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b"]
    (source / "2.csv").write_text("\n".join([line("b", "2024-01-01 10:20:00"), line("c", "2024-01-04 10:00:00"), line("a", "2024-01-01 09:00:00")]))
    run()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "once")).collect()) == ["a", "b", "c"]
    assert {(r.key, str(r.event_time)) for r in table["t"].collect()} == {("a", "2024-01-01 10:05:00"), ("b", "2024-01-01 10:20:00"), ("c", "2024-01-04 10:00:00")}
    (source / "3.csv").write_text(line("d", "2024-01-09 10:00:00"))
    run()
    counts = {str(r.start)[:10]: r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert counts["2024-01-01"] == 5  # the watermark has closed the day

"""Models: training, the store, scores, and what is made of them.

A query that reports on training fits its models; those that only use a model take the last one that was fitted on the same files.
"""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import functions as F

from depotlake.catalog.base import ORACLES, Tables, query
from depotlake.catalog.series import dates_of, kpis_of, rounded
from depotlake.catalog.staging import Staged
from depotlake.plans import features as P
from depotlake.plans import models as ML
from depotlake.sources.files import scratch
from depotlake.sources.files import stored as in_table

# The last days of training and validation in the given tables.
TRAIN_END, VALID_END, GENERATED = date(1998, 6, 30), date(1999, 12, 31), date(2000, 6, 30)
FITTED: dict[tuple, tuple] = {}


def demand_rows(t: Tables):
    return P.demand_features(kpis_of(t), dates_of(t), t.dim_product).withColumn("total_units_sold", F.col("total_units_sold").cast("double"))


def eta_rows(t: Tables):
    s = Staged(t)
    s.drivers = in_table(s.drivers, "drivers")  # here a distinct over the orders
    return P.eta_features(s.int_deliveries, dates_of(t), as_of_start=True, facts=s.deliveries)


def stockout_rows(t: Tables):
    return P.stockout_features(Staged(t).int_inventory, dates_of(t), products=t.dim_product).withColumn("date", F.col("snapshot_date"))


KINDS = {
    "demand": (demand_rows, ML.train_regression, "total_units_sold", P.DEMAND_FEATURES),
    "eta": (eta_rows, ML.train_regression, "actual_delivery_minutes", P.ETA_FEATURES),
    "stockout": (stockout_rows, ML.train_classification, "will_stockout_3d", P.STOCKOUT_FEATURES),
}


def state(t: Tables) -> tuple:
    """The files of the folder, with their lengths and times: a model is another one if they change."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(t.sf_dir)
    files = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def trained(t: Tables, kind: str) -> tuple:
    """Fits all candidates: name of the best model, the model, and the table of all models' metrics."""
    rows, train, label, features = KINDS[kind]
    split = ML.stored_rows(P.temporal_split(rows(t), "date", TRAIN_END, VALID_END), label, features)
    FITTED[t.spark.sparkContext.applicationId, kind, state(t)] = out = train(split.where("split = 'train'"), split.where("split = 'validation'"), label, features)
    return out


def fitted(t: Tables, kind: str) -> tuple:
    """The model that was fitted on these files, or a new one."""
    return FITTED.get((t.spark.sparkContext.applicationId, kind, state(t))) or trained(t, kind)


def stored(t: Tables):
    """All three models through the store: the number of features in the listing, the rows of each model, and on how many of them the loaded model says what the saved one does."""
    path, rows = scratch(t.spark, "models"), None
    for kind, (of, _, _, features) in KINDS.items():
        best, model, metrics = fitted(t, kind)
        ML.save_model(model, path, kind, {"best": best} | json.loads(metrics.toJSON().first()), features)
        before = model.transform(ML.numeric(of(t), features)).select(*features, F.col("prediction").alias("before"))
        again = ML.load_model(path, kind).transform(before)
        counted = again.agg(F.lit(kind).alias("name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction") == F.col("before")).alias("n_same"))
        rows = counted if rows is None else rows.unionByName(counted)
    n = F.size(F.from_json(F.get_json_object("metadata", "$.features"), "array<string>")).alias("n_features")
    return ML.list_saved_models(t.spark, path).select("name", n).join(F.broadcast(rows), "name")  # one row for each model


def demand_scores(t: Tables):
    """The product mart after its historical rows got their scores."""
    scores = ML.score_demand(fitted(t, "demand")[1], demand_rows(t))
    return ML.write_scores(kpis_of(t), scores, ["demand_forecast", "forecast_error"])


def eta_scores(t: Tables):
    return ML.score_eta(fitted(t, "eta")[1], eta_rows(t), P.ETA_FEATURES)


def stockout_scores(t: Tables):
    return ML.score_stockout(fitted(t, "stockout")[1], stockout_rows(t), P.STOCKOUT_FEATURES)


def forecasted(t: Tables):
    return ML.forecast(fitted(t, "demand")[1], kpis_of(t), ML.extend_calendar(t.spark, dates_of(t), date(2001, 12, 31)), t.dim_product, GENERATED)


query("train_demand", lambda t: trained(t, "demand")[2], "model mape rmse mae r2 n")
query("train_eta", lambda t: trained(t, "eta")[2], "model mape rmse mae r2 n")
query("train_stockout", lambda t: trained(t, "stockout")[2], "model auc_roc tp fp fn tn precision recall f1")
query(
    "model_store", stored, None,
    " UNION ALL ".join(
        f"SELECT '{kind}' AS name, CAST({len(KINDS[kind][3])} AS BIGINT) AS n_features, COUNT(*) AS n_rows, COUNT(*) AS n_same FROM ({ORACLES[source]}) {kind}"
        for kind, source in (("demand", "demand_features"), ("eta", "eta_features"), ("stockout", "stockout_features"))
    ),
)
query("feature_importance_topk", lambda t: ML.feature_importance(t.spark, fitted(t, "demand")[1], P.DEMAND_FEATURES), None)
# Forecasts that need no training, ranked by their errors.
NAIVE = {"yesterday": "demand_lag_1d", "last_week": "demand_lag_7d", "four_weeks_ago": "demand_lag_28d", "mean_7d": "demand_rolling_avg_7d", "mean_30d": "demand_rolling_avg_30d"}


def naive_models(t: Tables):
    rows = rounded(demand_rows(t), ["date", "product_id", *NAIVE.values()]).join(kpis_of(t).select("date", "product_id", F.col("total_units_sold").cast("double").alias("a")), ["date", "product_id"])
    each = rows.select("a", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in NAIVE.items()])).alias("m")).select("a", "m.*")
    return ML.ranked_models(ML.regression_metrics(each, "a", "p", ["model"]), "mape")


query(
    "sort_models", naive_models, "place model mape rmse mae",
    f"""SELECT ROW_NUMBER() OVER (ORDER BY mape NULLS LAST, model) AS place, * FROM (
        SELECT model, ROUND(AVG(CASE WHEN a <> 0 THEN ABS((a - p) / a) END) * 100, 4) AS mape, ROUND(SQRT(AVG((a - p) * (a - p))), 4) AS rmse, ROUND(AVG(ABS(a - p)), 4) AS mae
        FROM ({' UNION ALL '.join(f"SELECT '{n}' AS model, CAST(k.total_units_sold AS DOUBLE) AS a, f.{c} AS p FROM ({ORACLES['demand_features']}) f JOIN ({ORACLES['mart_daily_product_kpis']}) k ON k.date = f.date AND k.product_id = f.product_id" for n, c in NAIVE.items())}) x GROUP BY 1) y""",
)

query("score_demand", demand_scores, "date product_id total_units_sold demand_forecast forecast_error")
query(
    "score_demand_coverage", lambda t: demand_scores(t).groupBy("product_id").agg(F.count(F.lit(1)).alias("days"), F.count("demand_forecast").alias("scored"), F.count_if(F.abs(F.col("total_units_sold") - F.col("demand_forecast") - F.col("forecast_error")) <= 0.011).alias("consistent")),
    None, f"""SELECT product_id, COUNT(*) AS days, GREATEST(COUNT(*) - 28, 0) AS scored, GREATEST(COUNT(*) - 28, 0) AS consistent FROM ({ORACLES['mart_daily_product_kpis']}) m GROUP BY 1""",
)
query("score_eta", eta_scores, "date warehouse_id predicted_eta eta_error")
query("score_eta_coverage", lambda t: eta_scores(t).where("predicted_eta >= 1"), "date warehouse_id", f"SELECT date, warehouse_id FROM ({ORACLES['agg_eta_predictions']}) m")
query("score_stockout", stockout_scores, "date warehouse_id product_id stockout_risk_score")
query("score_stockout_coverage", lambda t: stockout_scores(t).where("stockout_risk_score between 0 and 1"), "date warehouse_id product_id", f"SELECT snapshot_date AS date, warehouse_id, product_id FROM ({ORACLES['stockout_features']}) m")


def written_back(t: Tables):
    """Scores up to a day, then those of an incremental run, beside the scores of all rows at once."""
    model, s = fitted(t, "stockout")[1], Staged(t)
    every = stockout_scores(t)
    table = every.where("date <= date'1998-01-01'")
    score = lambda features: ML.score_stockout(model, features, P.STOCKOUT_FEATURES)
    build = lambda facts: P.stockout_features(facts, dates_of(t), products=t.dim_product)
    again = ML.incremental_scores(table, s.int_inventory, "snapshot_date", build, score, ["date", "warehouse_id", "product_id"])
    return again.join(every.withColumnRenamed("stockout_risk_score", "at_once"), ["date", "warehouse_id", "product_id"], "full_outer")


query("incremental_writeback", lambda t: written_back(t).where("stockout_risk_score = at_once"), "date warehouse_id product_id", ORACLES["score_stockout_coverage"])
query("score_stockout_by_day", lambda t: ML.stockout_risk_by_day(stockout_scores(t)), "date product_id stockout_risk_score")
query("score_stockout_bands", lambda t: ML.risk_bands(stockout_scores(t)), None)
query("score_stockout_top", lambda t: ML.top_risk(stockout_scores(t)), None)
query("forecast_180d", forecasted, None)
query(
    "agg_forecast_summary", lambda t: ML.forecast_summary(forecasted(t)), None,
    """SELECT h AS forecast_horizon, COUNT(*) AS n, strftime(MIN(d), '%Y-%m-%d') AS first_date, strftime(MAX(d), '%Y-%m-%d') AS last_date FROM
    (SELECT CAST(CASE WHEN k <= 30 THEN 30 WHEN k <= 60 THEN 60 WHEN k <= 90 THEN 90 ELSE 180 END AS BIGINT) AS h, DATE '2000-06-30' + CAST(k AS INTEGER) AS d FROM {dim_product} p CROSS JOIN range(1, 181) r(k)) x GROUP BY 1""",
)

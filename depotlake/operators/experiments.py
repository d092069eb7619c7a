"""Experiment statistics. The facts shrink to one row for each experiment, group and segment before any statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up
from depotlake.functions.stats import p_value, t_95
from depotlake.operators.keyed import upsert

ALPHA, LEAST_VARIANCE = 0.05, 1e-10
SEGMENTS = ["customer_segment", "order_priority", "region"]


def metric_rows(assignments: DataFrame, orders: DataFrame, deliveries: DataFrame, experiments: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """experiment_id, group_name, metric, and with customers the segments of each assigned order that wasn't cancelled.

    The metric is the fulfillment cost, and for routing experiments the minutes of delivered deliveries.
    """
    e = F.broadcast(experiments.select("experiment_id", "experiment_type"))
    o = orders.where("order_status <> 'Cancelled'").select("order_id", "customer_id", "order_priority", F.col("total_fulfillment_cost").cast("double").alias("cost"))
    rows = assignments.select("experiment_id", "group_name", "order_id").join(e, "experiment_id").join(o, "order_id")
    d = deliveries.where("delivery_status = 'Delivered' and actual_delivery_minutes is not null").select("order_id", F.col("actual_delivery_minutes").cast("double").alias("minutes"))
    timed = F.col("experiment_type") == "routing"
    both = rows.join(d.withColumnRenamed("order_id", "_order"), (F.col("order_id") == F.col("_order")) & timed, "left")
    out = both.where(~timed | F.col("minutes").isNotNull()).withColumn("metric", F.when(timed, F.col("minutes")).otherwise(F.col("cost")))
    if customers is None:
        return out.select("experiment_id", "group_name", "metric")
    c = customers.select("customer_id", "customer_segment", "region")
    return out.join(c, "customer_id", "left").select("experiment_id", "group_name", "metric", *SEGMENTS)


def stats_of():
    return [F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.var_samp("metric").alias("variance")]


def experiment_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment_id", "group_name").agg(*stats_of()).withColumn("std", F.sqrt("variance"))


def segment_stats(rows: DataFrame, least: int = 10) -> DataFrame:
    """Statistics by each kind of segment, all kinds in one pass over grouping sets; groups of fewer than least rows go."""
    keys = ["experiment_id", "group_name"]
    sets = [[F.col("experiment_id"), F.col("group_name"), F.col(s)] for s in SEGMENTS]
    grouped = rows.groupingSets(sets, *keys, *SEGMENTS).agg(*stats_of())
    kind = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in SEGMENTS])
    out = grouped.select(*keys, kind.alias("segment_type"), F.coalesce(*SEGMENTS).alias("segment_value"), "n", "mean", "variance")
    return out.where("segment_value is not null").where(F.col("n") >= least)


def scenario(stats: DataFrame, effect: float = 1.0) -> DataFrame:
    """stats with Treatment's mean times effect, and its variance times effect squared."""
    treated = F.col("group_name") == "Treatment"
    return stats.withColumns({"mean": F.when(treated, F.col("mean") * effect).otherwise(F.col("mean")), "variance": F.when(treated, F.col("variance") * effect**2).otherwise(F.col("variance"))})


def welch(stats: DataFrame, keys: list[str], tests: bool = True) -> DataFrame:
    """Welch's test of Treatment against Control for each key: difference, t, degrees of freedom, and with tests p, the 95% interval and significance.

    Variances are at least LEAST_VARIANCE; with fewer than two rows in a group there are only nulls.
    """
    side = lambda g: {f"{c}_{g[0].lower()}": F.max(F.when(F.col("group_name") == g, F.col(c))) for c in ("n", "mean", "variance")}
    both = stats.groupBy(*keys).agg(*[x.alias(k) for k, x in (side("Control") | side("Treatment")).items()])
    enough = (F.col("n_c") >= 2) & (F.col("n_t") >= 2)
    vc, vt = (F.greatest(F.col(f"variance_{g}"), F.lit(LEAST_VARIANCE)) / F.col(f"n_{g}") for g in "ct")
    rows = both.withColumns({"_se": F.when(enough, F.sqrt(vc + vt)), "_diff": F.when(enough, F.col("mean_t") - F.col("mean_c"))})
    rows = rows.withColumns({"_t": F.col("_diff") / F.col("_se"), "_df": F.when(enough, F.pow(vc + vt, F.lit(2.0)) / (vc * vc / (F.col("n_c") - 1) + vt * vt / (F.col("n_t") - 1)))})
    out = {
        "difference": half_up("_diff", 4), "pct_change": F.when(F.col("_diff").isNotNull(), F.when(F.col("mean_c") != 0, half_up(F.col("_diff") / F.col("mean_c") * 100, 2)).otherwise(0.0)), "t_statistic": half_up("_t", 4), "degrees_of_freedom": half_up("_df", 4),
    }
    if tests:
        wide = t_95(F.col("_df")) * F.col("_se")
        rows = rows.withColumns({"_p": p_value(F.col("_t"), F.col("_df")), "_wide": wide})
        out |= {"p_value": half_up("_p", 6), "ci_lower": half_up(F.col("_diff") - F.col("_wide"), 4), "ci_upper": half_up(F.col("_diff") + F.col("_wide"), 4), "is_significant": F.col("_p") < ALPHA}
    return rows.select(*keys, "n_c", "n_t", half_up("mean_c", 4).alias("mean_c"), half_up("mean_t", 4).alias("mean_t"), *[c.alias(k) for k, c in out.items()])


def writeback(mart: DataFrame, tests: DataFrame) -> DataFrame:
    """mart with each test's results on both of its experiment's group rows; rows are only updated."""
    columns = ["p_value", "ci_lower", "ci_upper", "is_significant"]
    source = tests.select("experiment_id", F.explode(F.array(F.lit("Control"), F.lit("Treatment"))).alias("group_name"), *columns)
    wide = mart.withColumns({c: F.lit(None).cast("boolean" if c == "is_significant" else "double") for c in columns if c not in mart.columns})
    return upsert(wide, source, ["experiment_id", "group_name"], columns, insert=False)


def uplift_top(segments: DataFrame, top_n: int = 3) -> DataFrame:
    """Significant segments with the largest falls of the metric."""
    return segments.where("is_significant").orderBy("pct_change", "experiment_id", "segment_type", "segment_value").limit(2 * top_n)

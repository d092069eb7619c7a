"""Scans over blocks against windows, loops and sorts of whole keys."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from depotlake.operators import scans as S

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), T0 + timedelta(seconds=rng.choice([rng.randrange(9 * 86400), 86400 * 3, 7])) if rng.random() > 0.05 else None, float(rng.randrange(100)), k) for k in range(600)]
    return spark.createDataFrame(rows, "k string, at timestamp, v double, id int").repartition(5).cache()


def test_means_before_equal_a_window_over_the_key(timed):
    w = Window.partitionBy("k").orderBy(F.col("at").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    out = S.means_before(timed.withColumn("want", F.avg("v").over(w)), timed, "k", "at", {"got": "v"}).collect()
    assert len(out) == 600
    for r in out:
        assert (r.got is None) == (r.want is None) and (r.got is None or abs(r.got - r.want) < 1e-9), r
    plan = S.means_before(timed, timed, "k", "at", {"got": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan and "hashpartitioning(k" in plan


@pytest.mark.parametrize("alpha, days", [(0.1, 1024), (0.1, 7), (0.5, 4096), (1.0, 10), (0.001, 30)])
def test_ema_against_a_loop(spark, alpha, days):
    rng = random.Random(2)
    rows = [(k, date(2020, 1, 1) + timedelta(days=d), rng.randrange(50)) for k, n in (("a", 3000), ("b", 1), (None, 40)) for d in range(n) if k != "a" or d % 9]
    df = spark.createDataFrame(rows, "k string, d date, v long").repartition(4)
    want, mean = {}, {}
    for k, d, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        mean[k] = v if k not in mean else (1 - alpha) * mean[k] + alpha * v
        want[k, d] = mean[k]
    out = S.ema(df, ["k"], "d", "v", "e", alpha, days).collect()
    assert len(out) == len(want) and all(abs(r.e - want[r.k, r.d]) < 1e-9 for r in out)


def test_ema_of_a_long_series_is_many_tasks(spark):
    df = spark.range(100_000).select(F.lit("k").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (F.col("id") * 7919 % 101).alias("v"))
    out = S.ema(df, ["k"], "d", "v", "e", 0.1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert out.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    v = np.arange(100_000) * 7919 % 101
    mean = float(v[0])
    for x in v[1:]:
        mean = 0.9 * mean + 0.1 * x
    assert abs(out.orderBy(F.desc("d")).first().e - mean) < 1e-9


def test_auc_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, None]), round(rng.gauss(0, 1), 1) if rng.random() > 0.1 else None) for _ in range(900)]
    own = [(y, s) for y, s in rows if y is not None and s is not None]
    pairs = [(a, b) for y, a in own if y == 1 for z, b in own if z == 0]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "y int, s double").repartition(3)
    for ranges in (2, 7, 256):
        assert abs(S.auc_roc(df, "y", "s", ranges).first().auc - want) < 1e-12
    assert S.auc_roc(df.where("y = 1"), "y", "s").first().auc is None and S.auc_roc(df.limit(0), "y", "s").first().auc is None
    assert S.auc_roc(spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double"), "y", "s").first().auc == 0.5


@pytest.mark.parametrize("until", [None, "ends"])
@pytest.mark.parametrize("block", ["day", "month", "year"])
def test_as_of_against_a_loop(spark, until, block):
    rng = random.Random(4)
    day = lambda: T0 + timedelta(hours=6 * rng.randrange(400))
    starts = {(rng.choice("abcd"), day()) for _ in range(60)}
    versions = [(k, t, t + timedelta(days=rng.randrange(1, 40)) if rng.random() < 0.6 else None, f"v{i}") for i, (k, t) in enumerate(sorted(starts))] + [(None, T0, None, "x"), ("a", None, None, "y")]
    facts = [(rng.choice(["a", "b", "c", "z", None]), day() if rng.random() > 0.05 else None, i) for i in range(300)]
    facts += [(k, t + timedelta(seconds=s), 1000 + 3 * i + s) for i, (k, t) in enumerate(sorted(starts)) for s in (-1, 0, 1)]
    f = spark.createDataFrame(facts, "k string, at timestamp, id int").repartition(3)
    v = spark.createDataFrame(versions, "k string, begins timestamp, ends timestamp, name string")
    out = {r.id: r.name for r in S.as_of(f, v, "k", "at", "begins", ["name"], until, block).collect()}
    for k, at, i in facts:
        best = max(((t, e, n) for kk, t, e, n in versions if k is not None and at is not None and kk == k and t is not None and t <= at), key=lambda x: x[0], default=None)
        want = None if best is None or (until and best[1] is not None and at >= best[1]) else best[2]
        assert out[i] == want, (k, at, i)
    assert len(out) == len(facts) and S.as_of(f.limit(0), v, "k", "at", "begins", ["name"]).count() == 0 and S.as_of(f, v.limit(0), "k", "at", "begins", ["name"]).where("name is null").count() == len(facts)

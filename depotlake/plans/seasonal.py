"""Seasonal models of the network's daily demand: a trend and Fourier terms of the week and the year, fitted by least squares.

The normal equations are sums over the days, made in one aggregate; the driver solves a system of as many unknowns as terms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlake.functions.rounding import half_up

#: Days of a season, and how many pairs of sine and cosine it has.
SEASONS = ((7.0, 3), (365.25, 4))


def daily_totals(kpis: DataFrame, dates: DataFrame) -> DataFrame:
    """date and units of the whole network, 0 on days without sales."""
    sold = kpis.groupBy("date").agg(F.sum(F.col("total_units_sold").cast("double")).alias("units"))
    return dates.select("date").distinct().join(sold, "date", "left").withColumn("units", F.coalesce("units", F.lit(0.0)))


def terms(day: Column, origin: date) -> list[Column]:
    """1, the years since origin, and the sines and cosines of each season."""
    t = F.datediff(day, F.lit(origin)).cast("double")
    waves = [f(2 * math.pi * k / length * t) for length, pairs in SEASONS for k in range(1, pairs + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), t / 365.25, *waves]


@dataclass
class Seasonal:
    origin: date
    weights: list[float]

    def predicted(self, day: Column) -> Column:
        """Units of a day, not below 0."""
        return F.greatest(F.lit(0.0), sum((w * x for w, x in zip(self.weights, terms(day, self.origin))), F.lit(0.0)))


def fit_seasonal(days: DataFrame, origin: date, value: str = "units") -> Seasonal | None:
    """Least squares over the days with a value; of terms that the days can't tell apart the smallest weights. None without days."""
    x = terms(F.col("date"), origin)
    n = len(x)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    known = days.where(F.col(value).isNotNull()).select(F.array(*x).alias("x"), F.col(value).cast("double").alias("y"))
    sums = known.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in upper], *[F.sum(F.col("x")[i] * F.col("y")) for i in range(n)]).first()
    if sums[0] is None:
        return None
    a = np.zeros((n, n))
    for s, (i, j) in zip(sums, upper):
        a[i, j] = a[j, i] = s
    return Seasonal(origin, (np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ np.array(sums[len(upper) :], float)).tolist())


def seasonal_scores(days: DataFrame, model: Seasonal) -> DataFrame:
    return days.withColumn("demand_forecast", model.predicted(F.col("date")))


def seasonal_forecast(model: Seasonal, last: date, days: int, spark) -> DataFrame:
    """date and demand_forecast of the network on each of the days after last."""
    future = spark.range(1, days + 1).select(F.date_add(F.lit(last), F.col("id").cast("int")).alias("date"))
    return future.select("date", half_up(model.predicted(F.col("date")), 2).alias("demand_forecast"))

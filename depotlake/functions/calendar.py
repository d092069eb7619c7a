"""The calendar dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Holidays on the same day each year, and seasons by month.
HOLIDAYS = ["01-01", "07-04", "11-11", "12-25"]
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}


def calendar(spark: SparkSession, start: date | None = None, end: date | None = None, dates: DataFrame | None = None) -> DataFrame:
    """One row for each day from start to end, or for each distinct ``date`` of dates. Weekdays are ISO: Monday is 1."""
    if dates is None:
        dates = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    d, month = F.col("date"), F.month("date")
    season = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        season = F.when(month.isin(months), name).otherwise(season)
    return dates.distinct().withColumns({
        "day_of_week": F.date_format(d, "EEEE"), "day_of_week_num": (F.weekday(d) + 1).cast("long"), "week_number": F.weekofyear(d).cast("long"), "month": month.cast("long"), "month_name": F.date_format(d, "MMMM"),
        "quarter": F.quarter(d).cast("long"), "year": F.year(d).cast("long"), "is_holiday": F.date_format(d, "MM-dd").isin(HOLIDAYS), "is_weekend": F.weekday(d) >= 5, "season": season,
    })

"""How a query is registered: a function from tables to a result, and the SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlake.functions.rounding import half_up_sql
from depotlake.sources.fixtures import fixture, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The mapped tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, whole numbers as longs, times as text: types that both engines print alike."""
    def column(f: T.StructField) -> F.Column:
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("long").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def query(name: str, run: Callable[[Tables], DataFrame], columns: str | None = None, sql: str | None = None) -> None:
    """columns: what the result keeps, space separated. sql: with table names in braces; {{...}} is not needed, as nothing else has braces."""
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(Tables(spark, sf_dir))
        return plain(out.select(*columns.split()) if columns else out)

    QUERIES[name] = of
    if sql:
        ORACLES[name] = half_up_sql(oracle(sql))


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def day(*names: str) -> str:
    return ", ".join(f"strftime(CAST({n} AS DATE), '%Y-%m-%d') AS {n}" for n in names)


def when(*names: str) -> str:
    return ", ".join(f"strftime(CAST({n} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {n}" for n in names)

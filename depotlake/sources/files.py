"""Reading and writing tables: CSV by date, JDBC, Parquet caches with a high-water mark, replay of rows as events."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of unparsable lines.
BAD = "_corrupt"
NULLS = ("NULL", "null", "")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV folder or file with a header. Lines that don't parse keep their text in the column BAD; other rows have null there."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    df = spark.read.schema(wide).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("nullValue", NULLS[0]).csv(path)
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.trim(c).isin(*NULLS), F.col(c)) for c in text})


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(BAD).isNull()).drop(BAD)


def bad_rows(df: DataFrame) -> DataFrame:
    """The quarantine: unparsable lines as text. Spark reads them only from a cached or written frame, as it parses nothing for a query without other columns."""
    return df.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def read_dated(spark: SparkSession, base: str, schema: T.StructType, first: date | None = None, last: date | None = None, pattern: str | None = None) -> DataFrame:
    """base/date=YYYY-MM-DD/*.csv, pruned to a range of dates or to those that match a pattern."""
    df = read_csv(spark, base, T.StructType([*schema.fields, T.StructField("date", T.DateType())]) if "date" not in schema.names else schema)
    if first:
        df = df.where(F.col("date") >= F.lit(first))
    if last:
        df = df.where(F.col("date") <= F.lit(last))
    return df.where(F.date_format("date", "yyyy-MM-dd").rlike(f"^{pattern}$")) if pattern else df


def reload_matching(source: DataFrame, table: str, by: str = "date") -> None:
    """Replaces the partitions that source has and leaves the others: a reload can be repeated."""
    source.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(table)


def write_dated(df: DataFrame, path: str, by: str = "date", fmt: str = "csv", mode: str = "append") -> None:
    """One folder for each date, each written by one task, so that files stay few."""
    writer = df.repartition(by).write.mode(mode).partitionBy(by)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_flat(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A dimension, replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_per_key(df: DataFrame, path: str, key: str) -> None:
    df.repartition(key).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def read_table(spark: SparkSession, source: str, table: str | None = None, query: str | None = None, **options: str) -> DataFrame:
    """A table or a pushed-down query: over JDBC if source is a JDBC URL, else from a Parquet folder."""
    if source.startswith("jdbc:"):
        reader = spark.read.format("jdbc").option("url", source).options(**options)
        return reader.option("query", query).load() if query else reader.option("dbtable", table).load()
    df = spark.read.parquet(f"{source}/{table}" if table else source)
    return spark.sql(query, table=df) if query else df


def write_table(df: DataFrame, sink: str, table: str, mode: str = "append", **options: str) -> None:
    if sink.startswith("jdbc:"):
        df.write.format("jdbc").option("url", sink).option("dbtable", table).options(**options).mode(mode).save()
    else:
        df.write.mode(mode).parquet(f"{sink}/{table}")


def last_partition(df: DataFrame, default: date, by: str = "date") -> DataFrame:
    """One row: the latest partition, or the default for an empty table."""
    return df.agg(F.coalesce(F.max(by), F.lit(default)).alias("last_date"))


def extend_cache(source: DataFrame, cache: str, by: str, keys: list[str] | None = None, lookback_days: int = 0) -> DataFrame:
    """Appends to the Parquet folder cache what source has after its last date (all of it at first), and returns the whole cache.

    The high-water mark is read from the cache itself, so a failed append is made up by the next one. With keys and lookback_days, rows of the last date
    and of so many days before it that came late are appended, too: as many of each key as the cache lacks there, and of a repeated key those rows
    that the cache has not. Rows without a date count as late.
    """
    spark = source.sparkSession
    try:
        old = spark.read.parquet(cache)
    except Exception as e:  # Spark has no other way to ask whether a folder holds a table
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        source.write.parquet(cache)
        return spark.read.parquet(cache)
    mark = old.agg(F.max(by).alias("m")).first()["m"]
    if mark is not None and keys:
        recent = lambda df, n: df.where(F.col(by).isNull() | (F.col(by) >= F.date_sub(F.lit(mark), lookback_days))).withColumn("_n", F.lit(n))
        rows = recent(source, 1).unionByName(recent(old, -1)).groupBy(*source.columns).agg(F.sum("_n").alias("_n"))
        of_key = Window.partitionBy(*keys)
        new, before = F.greatest("_n", F.lit(0)), of_key.orderBy(*source.columns).rowsBetween(Window.unboundedPreceding, -1)
        lacks = F.least(new, F.sum("_n").over(of_key) - F.coalesce(F.sum(new).over(before), F.lit(0)))
        late = rows.withColumn("_lacks", lacks).where("_lacks > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_lacks")))
        late.select(*source.columns).write.mode("append").parquet(cache)
    else:
        (source if mark is None else source.where(F.col(by) > F.lit(mark))).write.mode("append").parquet(cache)
    return spark.read.schema(old.schema).parquet(cache)


def as_events(df: DataFrame, kind: str, key: Column, at: Column) -> DataFrame:
    """key and value of a message for each row: the row as JSON, with event_type and event_time."""
    return df.select(key.cast("string").alias("key"), F.to_json(F.struct(F.lit(kind).alias("event_type"), at.alias("event_time"), *df.columns)).alias("value"))


def replay(df: DataFrame, brokers: str, topic: str) -> None:
    """Writes rows of as_events() to a Kafka topic; needs Spark's Kafka connector."""
    df.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and last date of each table: a union of one-row aggregates."""
    out = None
    for name, (df, by) in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date(by)).alias("last_date")).select(F.lit(name).alias("table_name"), "n", "last_date")
        out = row if out is None else out.unionByName(row)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or below the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and (":" not in base or base.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base.rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df computed once and read from a table in a scratch folder. Its size is known before a plan is made, so that Spark broadcasts it while it is small and the other side of a join stays where it is."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

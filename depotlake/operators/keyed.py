"""Tables with keys: latest row, upsert, SCD2 history, incremental builds, overlays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlake.functions.sizes import small


def dedup_latest(df: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """The newest row of each key. Ties go by the other columns in name order, so that each run keeps the same row."""
    rest = [F.col(c).desc_nulls_last() for c in sorted(set(df.columns) - {*keys, order})]
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *rest)
    return df.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def same_key(a: str, b: str, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], insert: bool = True) -> DataFrame:
    """target merged with source: where keys match, null keys included, the update columns come from source; other source rows are added.

    A key that occurs twice in source fails the job; dedup_latest() comes first. Columns that source lacks are null in added rows.
    """
    once = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1, True).otherwise(F.raise_error(F.lit(f"upsert: a key ({', '.join(keys)}) occurs twice in source")).cast("boolean"))
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), source.withColumn("_s", once).alias("s")
    both = t.join(s, same_key("t", "s", keys), "full_outer" if insert else "left")
    in_source, in_target = F.col("s._s").isNotNull(), F.col("t._t").isNotNull()

    def column(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}").alias(c)
        if c in update:
            return F.when(in_source, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        return F.when(in_target, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return both.select(*[column(c) for c in target.columns])


def upsert_table(path: str, source: DataFrame, keys: list[str], update: list[str], partition: str, insert: bool = True) -> None:
    """Upsert into a partitioned Parquet table; only partitions that source touches are read and rewritten, and a rerun changes nothing."""
    spark = source.sparkSession
    touched = small(source.select(partition).distinct())
    old = spark.read.parquet(path)
    merged = upsert(old.join(touched, partition, "left_semi"), source, keys, update, insert).select(old.columns)
    staged = f"{path.rstrip('/')}__new"  # a table can't be read and overwritten in one job
    merged.write.mode("overwrite").partitionBy(partition).parquet(staged)
    again = spark.read.schema(old.schema).parquet(staged).select(old.columns)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def scd2_snapshot(history: DataFrame, source: DataFrame, key: str, checked: list[str], now: datetime) -> DataFrame:
    """history (source's columns, valid_from, valid_to) after a look at source: changed and missing keys are closed, changed and new ones opened.

    Only open versions are compared; nulls compare as values.
    """
    closed, live = history.where("valid_to is not null"), history.where("valid_to is null")
    columns, stamp = source.columns, F.lit(now).cast("timestamp")
    h, s = live.withColumn("_h", F.lit(True)).alias("h"), source.withColumn("_s", F.lit(True)).alias("s")
    both = h.join(s, F.col(f"h.{key}") == F.col(f"s.{key}"), "full_outer")
    changed = F.lit(False)
    for c in checked:
        changed = changed | ~F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}"))
    known, seen = F.col("h._h").isNotNull(), F.col("s._s").isNotNull()
    over, fresh = known & (~seen | changed), seen & (~known | changed)
    old = F.struct(*[F.col(f"h.{c}").alias(c) for c in columns], F.col("h.valid_from").alias("valid_from"), F.when(over, stamp).alias("valid_to"))
    new = F.struct(*[F.col(f"s.{c}").alias(c) for c in columns], stamp.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    versions = both.select(F.explode(F.filter(F.array(F.when(known, old), F.when(fresh, new)), lambda v: v.isNotNull())).alias("v")).select("v.*")
    return closed.select(versions.columns).unionByName(versions)


def incremental(target: DataFrame | None, facts: DataFrame, day: str, build, keys: list[str], lookback_days: int = 0) -> DataFrame:
    """target plus what build makes of the facts after its last date; lookback_days also rebuilds so many days before. None: a full build."""
    if target is None:
        return build(facts)
    last = target.agg(F.max("date").alias("_last"))  # one row
    recent = facts.join(F.broadcast(last), F.col("_last").isNull() | (F.col(day) > F.date_sub("_last", lookback_days))).drop("_last")
    made = build(recent)
    return upsert(target, made, keys, [c for c in target.columns if c not in keys])


def overlay(df: DataFrame, factors: DataFrame, keys: list[str], columns: dict[str, str], guard: Column | None = None) -> DataFrame:
    """df with an adjusted copy, ``<column>_adj``, of each column: times its factor where the keys match and the guard holds. The measured columns stay."""
    named = factors.select(*keys, *[F.col(f).alias(f"_f_{c}") for c, f in columns.items()])
    joined = df.join(small(named), keys, "left")
    apply = F.lit(True) if guard is None else guard
    adjusted = {f"{c}_adj": F.when(apply & F.col(f"_f_{c}").isNotNull(), F.col(c).cast("double") * F.col(f"_f_{c}")).otherwise(F.col(c).cast("double")) for c in columns}
    return joined.withColumns(adjusted).drop(*[f"_f_{c}" for c in columns])

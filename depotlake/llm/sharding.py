"""Sharding by sampled splitters, with DataFrame functions only.

Law ``bytes``: the records, in the order of their keys, are cut where the running total of sizes passes each of the
equal shares, so two shards differ by less than the size of one record at each end.

1. A sample of keys, drawn with a chance in proportion to record size, gives the quantile boundaries (splitters).
2. Records go to the range between two splitters, found by binary search. There are RANGES at most, however many records.
3. A range of over twice its share or over RANGE_ROWS rows, as of one very common text, is divided by the hash of the id; what is
   still too large, as of one repeated row, is divided by a number that each row was given when the keys were written.
4. Totals of the parts give each part its first byte and row; windows inside the parts give each record its own.

Null texts count as empty, null ids are a value of their own, equal rows get neighbouring slots in any order, an
empty table gives an empty result, and further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotlake.llm.common import materialize, small, table, unit_hash

#: Rows of a part at most, about, so that windows fit in a task's memory; ranges at most, so that their boundaries fit in the plan.
RANGE_ROWS, RANGES = 1_000_000, 4096


def splitters(keys: DataFrame, ranges: int, total: int, oversample: int, seed: int) -> list[int]:
    """Boundaries of the ranges from a size-weighted sample of about ranges x oversample keys, whatever the input's size."""
    rate = ranges * oversample / max(total, 1)
    want = F.col("size") * F.lit(rate)
    sample = keys.where(unit_hash("key", "doc_id", seed=seed) < want).select("key", F.greatest(F.lit(1.0), want).alias("w"))
    upto = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sample.groupBy("key").agg(F.sum("w").alias("w")).select("key", upto.alias("upto"))
    cut = F.floor(F.col("upto") / F.lit(float(oversample)))
    rows = ranked.groupBy(cut.alias("cut")).agg(F.min("key").alias("key")).collect()
    return sorted({r["key"] for r in rows})[1:]


def range_of(key: F.Column, bounds: list[int]) -> F.Column:
    """Number of bounds at or below key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    at = F.array(*[F.lit(b) for b in bounds])
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.try_element_at(at, pos + step) <= key, pos + step).otherwise(pos),
    )


def divided(rows: DataFrame, by: list[str], number: F.Column, share: float, name: str, most_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with a column name: the part of its group (by) that the hash of number gives a row, if the group is over-full."""
    over = (F.sum("size") > 2 * share) | (F.count(F.lit(1)) > most_rows)
    parts = F.when(over, F.ceil(F.greatest(F.sum("size") / share, F.count(F.lit(1)) / most_rows))).otherwise(F.lit(1)).cast("long")
    groups = rows.groupBy(*by).agg(parts.alias("parts")).where("parts > 1")  # few: at most half of the shares and of the rows over most_rows
    spread = F.shiftrightunsigned(F.xxhash64(number, F.lit(name)), 33)
    part = F.coalesce(F.shiftrightunsigned(spread * F.col("parts"), 31), F.lit(0))
    groups = materialize(groups, f"shard-{name}")
    return rows.join(small(groups, groups.count()), by, "left").withColumn(name, part).drop("parts")


def shard_by_bytes(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 16, oversample: int = 32, seed: int = 10) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the range and its parts that a record went through."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("number"),  # written here and never made again
    )
    keys = materialize(keys, "shard-keys")
    seen = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total, ranges = max(seen["bytes"] or 0, 1), min(RANGES, max(shards * ranges_per_shard, math.ceil(seen["rows"] / RANGE_ROWS)))
    bounds = splitters(keys, ranges, total, oversample, seed)

    ranged = keys.withColumn("range", range_of(F.col("key"), bounds))
    ranged = divided(ranged, ["range"], F.col("doc_id"), total / ranges, "sub")
    ranged = divided(ranged, ["range", "sub"], F.col("number"), total / ranges, "copy")

    by = ["range", "sub", "copy"]
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy(*by).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    first = first.select(*by, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    first = materialize(first, "shard-parts")

    inside = Window.partitionBy(*by).orderBy("key", "doc_id", "size", "number")
    placed = (
        ranged.withColumn("rn", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(small(first, first.count()), by)
    )
    middle = F.col("bytes_before") + F.col("upto") - F.expr("size div 2")
    placed = placed.withColumn("at", F.col("rows_before") + F.col("rn") - 1).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(total)))).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", *by, "shard", "at"), "shard-rows")
    starts = F.broadcast(placed.groupBy("shard").agg(F.min("at").alias("start")))  # one row for each shard
    return placed.join(starts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *by,
    )


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))

"""Facts in buckets by their key, so that joins and sums by it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df written as a table of so many buckets by the key, each sorted by it, and read back. The table is in the session's catalog, its files are in the warehouse.

    Rows are dealt to the buckets first, so that a bucket is one file and Spark takes its order for sorted. Tables that are to be joined have the same number of buckets.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch for a Python task, and of a slice of texts that it holds in arrays.
BATCH_BYTES, SLICE_BYTES = 1 << 22, 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for tables between stages, where the driver and all executors see it: below spark.checkpoint.dir, or the warehouse where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local[") and (":" not in given or given.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = given.rstrip("/") + "/_stages"
    return f"{given.rstrip('/')}/{spark.sparkContext.applicationId}"


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python tasks have BATCH_BYTES at most, unless the session has a limit of its own: 10,000 whole texts, Spark's other limit, can be of any size."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def clear_stages(spark: SparkSession) -> None:
    """Deletes all tables between stages of this application, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table of materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its number of rows is within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def at_most(df: DataFrame, value: str, most: int) -> DataFrame:
    """The rows of df with the greatest values (positive integers), all those of a value or none: most rows at most. Values are counted by their first seven bits."""
    bits = f"length(bin({value})) - 1"
    classes = df.selectExpr(f"{bits} as bits", f"shiftright({value}, greatest({bits} - 6, 0)) as head").groupBy("bits", "head").count()
    floor = None
    for c in classes.orderBy(F.desc("bits"), F.desc("head")).collect():  # at most 64 classes for each of 63 numbers of bits
        most -= c["count"]
        if most < 0:
            break
        floor = c["head"] << max(c["bits"] - 6, 0)
    return df.where(F.lit(False) if floor is None else F.col(value) >= floor)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A value from [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed)), 11) / F.lit(float(2**53))


def per_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 128) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: step on slices of at most so many rows, so that memory follows the slice and not the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return run


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """texts in slices of about so many bytes; a longer text is a slice of its own. An empty array is one slice."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < len(texts) or not len(texts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def per_bytes(step: Callable[[pa.RecordBatch], pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: step on slices of batches by the bytes of the text in a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(column), most):
                yield step(batch.slice(at, len(part)))
                at += len(part)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows whose totals one task of a prefix sum adds up before the next level.
PREFIX_CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none and runs on one machine (tests) a new folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables of each open scratch(), the innermost last.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that are kept: what leaves must be read from a kept one."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """df as a table in the shared folder: later readers survive lost executors and repeat no work."""
    path = new_path(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df as a table in the shared folder, dealt by key into as many buckets as a shuffle has partitions: tables of one key join without a shuffle."""
    spark = df.sparkSession
    path, table_name = new_path(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


def prefix_sum(df: DataFrame, order: str, value: str, out: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds out: the sum of value over the rows before, by order (distinct longs from 0 on), inside each group of within.

    Two levels, so that no task sees more than the rows of a chunk or one row for each chunk.
    """
    chunk = (F.col(order) / PREFIX_CHUNK).cast("long")
    keyed = df.withColumn("_chunk", chunk)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy(*within, "_chunk").agg(F.sum(value).alias("_total"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before(Window.partitionBy(*within).orderBy("_chunk"))), F.lit(0))).drop("_total")
    inner = F.coalesce(F.sum(value).over(before(Window.partitionBy(*within, "_chunk").orderBy(order))), F.lit(0))
    return keyed.withColumn("_inner", inner).join(totals, [*within, "_chunk"]).withColumn(out, (F.col("_inner") + F.col("_base")).cast("long")).drop("_chunk", "_inner", "_base")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(df: DataFrame) -> DataFrame:
    """One column rec that holds all columns, so that helper columns beside it never clash with them."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("rec"))


def from_batches(batch, column: str) -> list:
    """The values of one Arrow column as Python objects."""
    return batch.column(batch.schema.get_field_index(column)).to_pylist()

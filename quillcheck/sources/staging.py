"""Tables that several branches of a plan read, written once, and the folder they stand in; tables dealt by size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none, one is made and set on a single machine (tests); on a cluster that is an error, since no
    folder of one machine would do and a check without written tables would compute its blocks in each of its branches.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task gets of a table that is dealt by its size.
TASK_ROWS = 1 << 16


def dealt(df: DataFrame, *keys: Column | str, rows: int | None = None) -> DataFrame:
    """df dealt by keys into as many partitions as its rows need, so that the memory of the tasks that group, sort and join by them does not grow with the table.

    The rows are counted first, which for a Parquet table reads the footers only, unless their number is given; tables dealt by one number meet without a shuffle.
    """
    return df.repartition(partitions_of(df.count() if rows is None else rows), *keys)


def partitions_of(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def staged_by(df: DataFrame, name: str, key: str, partitions: int) -> DataFrame:
    """df as a table in the shared folder, dealt by key into so many buckets: joins, groups and windows by the key, of it or of tables with as many buckets, need no shuffle.

    Spark knows the buckets of a table by its entry in the session's catalog, which goes as soon as the table is read; the files stay.
    """
    unique = uuid.uuid4().hex
    table = f"{name}_{unique}".replace("-", "_")
    df.repartition(partitions, key).write.bucketBy(partitions, key).option("path", f"{shared_folder(df.sparkSession)}/{name}-{unique}").saveAsTable(table)
    found = df.sparkSession.table(table)
    df.sparkSession.sql(f"DROP TABLE {table}")
    return found.toDF(*df.columns)  # columns without the table's name, or Spark does not see that branches which are put together are dealt alike

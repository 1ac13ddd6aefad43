"""Tables of a loop's rounds: written in the folder all executors share, so that neither plans nor size estimates grow with the rounds."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corvane-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; for a local master without one a new folder. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _local_folder()).rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def staged(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read back; deleted by release, and at the latest when the application ends."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    system, path = _path(spark, name)
    system.deleteOnExit(path)
    df.write.parquet(name)
    table = spark.read.schema(df.schema).parquet(name)
    table._corvane_round = name
    return table


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df by its keys over as many tasks as give each about `each` of its `rows`, and no fewer than Spark's own number.

    That number is fixed whatever the input, so what a task sorts or groups would grow with the tables.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)


def together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of the same columns as one, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._corvane_round for t in tables])


def release(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    system, path = _path(table.sparkSession, table._corvane_round)
    system.delete(path, True)

"""Shared tables in the checkpoint folder, joins that heavy keys don't skew, and connected components on Spark joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of the rows, as 1 in HEAVY, is heavy; so there are fewer than HEAVY heavy keys.
HEAVY = 10_000
#: Links (16 bytes each) of one node that a task may hold in a join.
HUB_ROWS = 100_000
#: Rows of texts that a Python worker holds at once, and that its JVM keeps for it.
BATCH_ROWS = 1_000

#: The open scratches of this thread or task, the innermost last: other threads' tables are theirs.
_open: ContextVar[tuple[Scratch, ...]] = ContextVar("open", default=())


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="corvane-")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one when a local master has none set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder()


def _path(spark: SparkSession, path: str):
    whole = spark._jvm.org.apache.hadoop.fs.Path(path)
    return whole.getFileSystem(spark._jsc.hadoopConfiguration()), whole


class Scratch:
    """Within it, tables that materialize writes are noted, and deleted at its end, on success and on failure alike.

    keep(table) hands a table on to the scratch around this one, or to the end of the application.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Scratch:
        self.around = _open.get()
        self.token = _open.set((*self.around, self))
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        folder = table._corvane_folder
        self.folders.remove(folder)
        if self.around:
            self.around[-1].folders.append(folder)
        return table

    def __exit__(self, *_) -> None:
        _open.reset(self.token)
        for folder in self.folders:
            system, path = _path(self.spark, folder)
            system.delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation of what came before. Callers
    project to narrow columns first, as these bytes count as disk. The folder goes with the scratch it is written in,
    and at the latest when the application ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, path = _path(spark, folder)
    system.deleteOnExit(path)
    if _open.get():
        _open.get()[-1].folders.append(folder)
    df.write.parquet(folder)
    table = spark.read.schema(df.schema).parquet(folder)
    table._corvane_folder = folder
    return table


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, Python workers get at most so many rows at a time: for tables that are written there and hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    folder = table._corvane_folder
    for scratch in _open.get():
        if folder in scratch.folders:
            scratch.folders.remove(folder)
    system, path = _path(table.sparkSession, folder)
    system.delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of the names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, least: int = 1) -> DataFrame:
    """rows joined with facts (one row for each key, and in `count` how many rows have it) on key; inner, null keys meet none.

    Facts of heavy keys, fewer than HEAVY whatever the table, are broadcast, so the rows of a hot key stay where they
    are; the other keys are joined as Spark chooses, and none of them has more than one row in HEAVY. Keys of no more than
    `least` narrow rows, which any task holds, are never heavy; where all rows are no more, one plain join does.
    """
    bound = max(total // HEAVY, least)
    if total <= bound:
        return rows.join(facts, key).drop(count)
    hot, cold = facts.where(F.col(count) > bound), facts.where(F.col(count) <= bound)
    (mark,) = fresh(rows.join(facts, key), "is_hot")
    marked = rows.join(F.broadcast(hot.select(key).withColumn(mark, F.lit(True))), key, "left")
    near = marked.where(F.col(mark)).drop(mark).join(F.broadcast(hot), key)
    far = marked.where(F.col(mark).isNull()).drop(mark).join(cold, key)
    return near.unionByName(far).drop(count)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (node, root): every node that has a link, with the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014); each round's edges are a written table, and the
    one before is deleted. Only counts come to the driver. A node with very many links is joined by broadcast
    (spread_join). Null ends and self links are ignored; repeated links are harmless.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, low, "u", "n", 2 * mark["n"], HUB_ROWS).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = spread_join(large, low, "u", "n", mark["n"], HUB_ROWS)
        small = low.select("u", F.col("m").alias("v")).unionAll(
            hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        before, now = now, materialize(small.where("u <> v").distinct(), "links")
        discard(before)
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

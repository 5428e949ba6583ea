"""Chunks of the time of busy keys, equally filled, so that no task gets more than so many rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deal(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` hashed on ``keys``, into ``parts`` tasks where a number is given."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


#: Tasks of an exchange whose rows Spark writes as they come; for more tasks it holds a task's rows to sort them.
UNSORTED = 200


def thinned(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df``, before rows are multiplied for an exchange into ``parts`` tasks; in many tasks where that one would hold all that a task reads."""
    return df.repartition(UNSORTED, *keys) if parts and parts > UNSORTED else df


def chunk_of(bounds: Column, time: Column) -> Column:
    """The number of the chunk that a time falls into."""
    return F.size(F.filter(bounds, lambda b: b <= time)).cast("long")


def busy(df: DataFrame, rows: int, key: str = "source_ip", time: str = "t_us", slot_us: int = 100_000) -> DataFrame:
    """(key, bounds, end) of the keys with more than ``rows`` rows: the times at which their chunks of about ``rows`` rows begin, and one after their last row.

    Rows are counted by slots of time, and a chunk holds whole slots.  The keys, and then the table, which has an entry for
    every ``rows`` rows of ``df`` at most, are fetched and made tables of their own.
    """
    many = df.groupBy(F.col(key).alias("__many")).agg(F.count("*").alias("n")).where(F.col("n") > rows).select("__many")
    many = df.sparkSession.createDataFrame(many.collect(), many.schema)
    slots = df.join(F.broadcast(many), F.col(key).eqNullSafe(F.col("__many")), "left_semi").groupBy(F.col(key).alias("key"), F.floor(F.col(time) / slot_us).alias("slot")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    chunks = slots.withColumn("chunk", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / rows)).where("chunk > 0")
    begins = chunks.groupBy("key", "chunk").agg((F.min("slot") * slot_us).cast("long").alias("begin"), ((F.max("slot") + 1) * slot_us).cast("long").alias("end"))
    found = begins.groupBy("key").agg(F.sort_array(F.collect_list("begin")).alias("bounds"), F.max("end").alias("end"))
    return df.sparkSession.createDataFrame(found.collect(), found.schema)

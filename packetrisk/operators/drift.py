"""Behavioural drift of a source's packet counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from packetrisk.config import DEFAULTS, RiskConfig
from packetrisk.operators.chunks import deal


def behavioral_drift(df: DataFrame, config: RiskConfig = DEFAULTS, name: str = "drift", bucket_s: int | None = None, chunk: str | None = None, parts: int | None = None) -> DataFrame:
    """|packet_count - mean of the previous counts (at most 19)|, 0 with fewer than 4 of them.

    With ``bucket_s`` a source's time is cut into buckets of that length, and each bucket gets the last rows
    before it as context; a busy source then spreads over many tasks with the same values.  ``chunk``: a column (dropped) of
    such buckets, ``parts``: the number of tasks.
    """
    if bucket_s or chunk:
        # dealt once: own rows and the context taken from them read the same exchange
        dealt = df.withColumnRenamed(chunk, "__b") if chunk else df.withColumn("__b", F.floor(F.col("t_us") / (bucket_s * 1_000_000)))
        dealt = deal(dealt, parts, "source_ip", "__b")
        both = _with_context(dealt, config.drift_history - 1)
        both = deal(both, parts, "source_ip", "__b") if parts else both
        return _drift(both, ["source_ip", "__b"], config, name).where("__own").drop("__b", "__own")
    return _drift(df, ["source_ip"], config, name)


def _drift(df: DataFrame, key: list[str], config: RiskConfig, name: str) -> DataFrame:
    past = Window.partitionBy(*key).orderBy("t_us", "packet_id").rowsBetween(-(config.drift_history - 1), -1)
    gap = F.abs(F.col("packet_count") - F.avg("packet_count").over(past))
    return df.withColumn(name, F.when(F.count("*").over(past) >= config.drift_least - 1, gap).otherwise(0.0))


def _with_context(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (``__own``) and, in each bucket of a source, the ``rows`` rows before it (not ``__own``).

    A bucket hands on its last rows only; a bucket's context lies in as many earlier buckets at most.
    """
    place = [c for c in df.columns if c not in ("source_ip", "__b")]
    latest = Window.partitionBy("source_ip", "__b").orderBy(F.desc("t_us"), F.desc("packet_id"))
    row = F.struct("t_us", "packet_id", F.struct(*place).alias("row"))
    ends = df.select("source_ip", "__b", row.alias("row"), F.row_number().over(latest).alias("__r")).where(F.col("__r") <= rows)
    ends = ends.groupBy("source_ip", "__b").agg(F.array_sort(F.collect_list("row"), lambda a, b: F.when(a["t_us"] < b["t_us"], -1).when(a["t_us"] > b["t_us"], 1).when(a["packet_id"] < b["packet_id"], -1).otherwise(1)).alias("end"))
    before = Window.partitionBy("source_ip").orderBy("__b").rowsBetween(-rows, -1)
    context = ends.select("source_ip", "__b", F.flatten(F.collect_list("end").over(before)).alias("all"))
    context = context.select("source_ip", "__b", F.explode(F.slice("all", F.greatest(F.lit(1), F.size("all") - rows + 1), rows)).alias("c")).select("source_ip", "__b", "c.row.*")
    return df.withColumn("__own", F.lit(True)).unionByName(context.withColumn("__own", F.lit(False)))


#: A value's weight halves with every row: 64 rows hold all that a double can tell.
SPANS = (1, 2, 4, 8, 16, 32)


def halved(x: np.ndarray, first: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The baseline after each row, b -> (b + x) / 2, of groups of rows: ``first`` is where a row's group begins, ``entry`` the baseline before it.

    Any run of rows is the map b -> b / 2**n + c; runs are put together to twice their length until they hold 64 rows.
    """
    at = np.arange(len(x))
    out = x / 2.0
    for span in SPANS:
        inside = at - span >= first
        out[inside] = (out + np.ldexp(np.append(np.zeros(min(span, len(x))), out[:-span]), -span))[inside]
    return out + np.ldexp(entry, -(at - first + 1))


def _groups(batch: pa.RecordBatch, by: list[str]) -> tuple[list[tuple], np.ndarray]:
    """The values of ``by`` in every run of equal ones, and the runs' bounds."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
    edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else [0]
    return [keys[i] for i in edges[:-1]], np.array(edges)


def halving_drift(df: DataFrame, value: str = "packet_count", config: RiskConfig = DEFAULTS, name: str = "ema_drift", chunk_s: int | None = None) -> DataFrame:
    """|x - baseline|, where the baseline starts at the first x and moves half way to each x; first 0.

    Rows are read in order and a task keeps one baseline.  With ``chunk_s`` a source's time is cut into chunks of that length: each is
    reduced to its map b -> b / 2**n + c, these are chained by source, and the chunks' rows are judged apart, from the same
    exchange.  A source that is null or empty has 0 and no baseline; a null value is 0; an empty table gives no rows.
    """
    order, columns = ["t_us", "packet_id"], df.columns
    chunk = F.coalesce(F.floor(F.col("t_us") / (chunk_s * 1_000_000)), F.lit(-(1 << 62))) if chunk_s else F.lit(0).cast("long")
    # As a struct a null source equals itself in the join, which then needs no other exchange of the rows.
    dealt = df.withColumns({"__k": F.struct("source_ip"), "__c": chunk, "__x": F.coalesce(F.col(value).cast("double"), F.lit(0.0))}).repartition("__k", "__c")
    if chunk_s:
        dealt = dealt.join(_entries(dealt, order), ["__k", "__c"], "left")
    by = ["source_ip", "__c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, 0.0
        for batch in batches:
            groups, edges = _groups(batch, by)
            x = batch.column("__x").to_numpy()
            given = batch.column("__entry").to_pylist() if chunk_s else None
            entry = [base if g == now else x[a] if given is None or given[a] is None else given[a] for g, a in zip(groups, edges)]
            many = np.diff(edges)
            after = halved(x, np.repeat(edges[:-1], many), np.repeat(np.array(entry, dtype=float), many))
            before = np.append(0.0, after[:-1])
            before[edges[:-1]] = entry
            if len(x):
                now, base = groups[-1], after[-1]
            named = np.repeat(np.array([bool(g[0]) for g in groups], dtype=bool), many)
            drift = pa.array(np.where(named, np.abs(x - before), 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), drift], names=[*columns, name])

    return dealt.sortWithinPartitions("__k", "__c", *order).mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def _entries(dealt: DataFrame, order: list[str]) -> DataFrame:
    """(__k, __c, __entry): the baseline before each chunk of a source; null before its first."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, c, x0 = None, 0, 0.0, 0.0
        for batch in batches:
            groups, edges = _groups(batch, ["source_ip", "__c"])
            x, done = batch.column("__x").to_numpy(), []
            many = np.diff(edges)
            ends = halved(x, np.repeat(edges[:-1], many), np.repeat(np.array([c if g == now else 0.0 for g in groups]), many))
            for g, a, b in zip(groups, edges[:-1], edges[1:]):
                if g != now:
                    if now is not None:
                        done.append((*now, n, c, x0))
                    now, n, x0 = g, 0, x[a]
                n, c = n + int(b - a), float(ends[b - 1])
            yield _maps(done)
        if now is not None:
            yield _maps([(*now, n, c, x0)])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = (), None
        for batch in batches:
            before = []
            for key, n, c, x0 in zip(*(batch.column(x).to_pylist() for x in ("key", "n", "c", "x0"))):
                now, base = (now, base) if now == (key,) else ((key,), None)
                before.append(base)
                base = math.ldexp(x0 if base is None else base, -n) + c
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(before, pa.float64())], names=["key", "chunk", "entry"])

    maps = dealt.sortWithinPartitions("__k", "__c", *order).mapInArrow(reduce, "key string, chunk long, n long, c double, x0 double")
    chained = maps.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(chain, "key string, chunk long, entry double")
    return chained.select(F.struct(F.col("key").alias("source_ip")).alias("__k"), F.col("chunk").alias("__c"), F.col("entry").alias("__entry"))


def _maps(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "chunk", "n", "c", "x0"])

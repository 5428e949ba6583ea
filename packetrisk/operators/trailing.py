"""Trailing counts per key in event time, both ends included.

A row adds one when it comes and takes one away when it leaves each window: rows are
exploded into one arrival and one expiry marker per window, and running sums over the
sorted markers give all counts with one sort, however many rows a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetrisk.operators.chunks import chunk_of, deal, thinned


def trailing_counts(
    df: DataFrame, windows: dict[str, int], key: str = "source_ip", time: str = "t_us", order: str = "packet_id", bucket_s: int | None = None, peers: bool = False, bounds: str | None = None, parts: int | None = None, end: str | None = None
) -> DataFrame:
    """``df`` with a count per window (name -> seconds): rows of the key in [t - w, t], itself included.

    Rows at one time count in the order of ``order``, or with ``peers`` all of them, as a RANGE frame counts them.  With
    ``bucket_s`` a key's time is cut into buckets of that length and rows are also copied, as context, into the buckets that their windows
    reach; a busy key then spreads over many tasks with the same counts.  With ``bounds`` (a column of ``chunks.busy``, dropped)
    every marker goes to the chunk of its own time, without copies, and what earlier chunks bring along, a row per chunk, is added; the
    chunk stays as ``__c``; expiries from ``end`` on (a column, dropped: no row of the key comes then) are left out, they change no count and would all meet in the
    last chunk.  ``parts``: the number of tasks.
    """
    if bounds:
        return _chunked(df, windows, key, time, order, peers, bounds, parts, end)
    payload = F.struct(*(F.col(c) for c in df.columns))
    longest = max(windows.values())
    base = df.withColumn("__row", payload)
    if bucket_s:
        size = bucket_s * 1_000_000
        first = F.floor(F.col(time) / size)
        last = F.floor((F.col(time) + longest * 1_000_000) / size)
        base = base.withColumn("__b", F.explode(F.sequence(first.cast("long"), last.cast("long")))).withColumn("__own", F.col("__b") == first)
    else:
        base = base.withColumn("__b", F.lit(0).cast("long")).withColumn("__own", F.lit(True))
    null_row = F.lit(None).cast(base.schema["__row"].dataType)
    marks = _marks(windows, time, F.when(F.col("__own"), F.col("__row")).otherwise(null_row), null_row)
    long = base.select(F.col(key).alias("__k"), "__b", F.col(order).alias("__o"), F.explode(F.array(*marks)).alias("m")).select("__k", "__b", "__o", "m.*")
    counts = [c.alias(n) for n, c in _running(windows, ["__k", "__b"], peers).items()]
    own = [F.col("__k").alias(c) if c == key else F.col("row")[c].alias(c) for c in df.columns]  # the key itself keeps the partitioning known
    return long.select("__k", "row", *counts).where("row is not null").select(*own, *windows)


def _marks(windows: dict[str, int], time: str, row: Column, null_row: Column) -> list[Column]:
    """A row's arrival and, for each window, its expiry."""
    mark = lambda kind, name, at, what: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("w"), at.alias("at"), what.alias("row"))
    return [mark(0, "", F.col(time), row), *(mark(1, n, F.col(time) + s * 1_000_000, null_row) for n, s in windows.items())]


def _steps(windows: dict[str, int]) -> dict[str, Column]:
    """What a marker adds to the count of each window."""
    return {n: F.when(F.col("kind") == 0, 1).when(F.col("w") == n, -1).otherwise(0) for n in windows}


def _running(windows: dict[str, int], by: list[str], peers: bool) -> dict[str, Column]:
    """Running sums over the markers; with ``peers`` those of one time and kind count together."""
    order = Window.partitionBy(*by).orderBy("at", "kind", *(() if peers else ("__o",)))
    run = (order.rangeBetween if peers else order.rowsBetween)(Window.unboundedPreceding, 0)
    return {n: F.sum(c).over(run) for n, c in _steps(windows).items()}


def _chunked(df: DataFrame, windows: dict[str, int], key: str, time: str, order: str, peers: bool, bounds: str, parts: int | None, end: str | None) -> DataFrame:
    names = [c for c in df.columns if c not in (bounds, end)]
    counts = (F.col("m.kind") == 0) | ~F.coalesce(F.col("m.at") >= F.col(end), F.lit(False)) if end else F.lit(True)
    placed = lambda rows, marks: rows.withColumn("m", F.explode(F.array(*marks))).where(counts).withColumn("__c", chunk_of(F.col(bounds), F.col("m.at")))
    nothing = F.lit(None).cast("int")
    light = placed(df.select(key, time, bounds, *([end] if end else [])), _marks(windows, time, nothing, nothing)).select(key, "__c", "m.*")
    before = Window.partitionBy("__k").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    brought = light.groupBy(F.col(key).alias("__k"), "__c").agg(*(F.sum(c).alias(n) for n, c in _steps(windows).items()))
    brought = brought.select(F.col("__k").alias("__bk"), F.col("__c").alias("__bc"), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in windows))
    whole = thinned(df, parts, time, order).withColumn("__row", F.struct(*names))
    null_row = F.lit(None).cast(whole.schema["__row"].dataType)
    long = placed(whole, _marks(windows, time, F.col("__row"), null_row)).select(F.col(key).alias("__k"), "__c", F.col(order).alias("__o"), "m.*")
    long = deal(long, parts, "__k", "__c").select("__k", "__c", "row", *(c.alias(n) for n, c in _running(windows, ["__k", "__c"], peers).items())).where("row is not null")
    # a row for each chunk of a busy key
    long = long.join(F.broadcast(brought), F.col("__k").eqNullSafe(F.col("__bk")) & (F.col("__c") == F.col("__bc")), "left")
    return long.select(*(F.col("row")[c].alias(c) for c in names), "__c", *((F.col(n) + F.col(f"__before_{n}")).alias(n) for n in windows))


def range_counts(df: DataFrame, windows: dict[str, int], key: str = "source_ip", time: str = "t_us") -> DataFrame:
    """The same by RANGE frames (rows at one time count each other): a cross-check for tests and benchmarks."""
    for name, seconds in windows.items():
        frame = Window.partitionBy(key).orderBy(time).rangeBetween(-seconds * 1_000_000, 0)
        df = df.withColumn(name, F.count("*").over(frame))
    return df

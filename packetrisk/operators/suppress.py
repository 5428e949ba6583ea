"""Greedy suppression: after an emitted row, rows of the key are held back for a while."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def emitted(times: np.ndarray, hold: int, inclusive: bool, last: int | None = None) -> np.ndarray:
    """Flags of sorted times: emit the first (at or after ``last`` and the hold), then the first at (inclusive) or after the hold, and so on."""
    out, side = np.zeros(len(times), dtype=bool), "left" if inclusive else "right"
    i = 0 if last is None else int(np.searchsorted(times, last + hold, side=side))
    while i < len(times):
        out[i] = True
        i = int(np.searchsorted(times, times[i] + hold, side=side))
    return out


def _runs(batch: pa.RecordBatch, by: list[str], time: str) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
    """(values of ``by``, begin, end, times) of each run of equal values; rows without a time, which come first, are left out."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
    times = batch.column(time)
    lacking = times.is_null().to_numpy(zero_copy_only=False)
    times = pc.fill_null(times, 0).to_numpy()
    edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            begin = a + int(np.count_nonzero(lacking[a:b]))
            yield keys[a], begin, b, times[begin:b]


class _Ways:
    """Where a chunk's first emitted time leads: its sorted times are added part by part, and only the ways are held.

    ``starts`` and ``ends``: the latest first time and the last emitted time of each way through the chunk; at most one for each time in
    its first hold, since the row before the chunk holds back no longer than that.
    """

    def __init__(self, begin: int, hold: int, inclusive: bool):
        self.limit, self.hold, self.side = begin + hold, hold, "left" if inclusive else "right"
        self.starts = self.ends = np.empty(0, dtype=np.int64)
        self.open = True

    def add(self, times: np.ndarray) -> None:
        times = np.unique(times)
        after = np.searchsorted(times, times + self.hold, side=self.side)
        way = np.where(after < len(times), after, np.arange(len(times)))
        while not np.array_equal(further := way[way], way):
            way = further
        at = np.searchsorted(times, self.ends + self.hold, side=self.side)
        ends = np.where(at < len(times), times[way[np.minimum(at, len(times) - 1)]], self.ends)
        starts = self.starts
        if self.open:
            # up to the first time that any row before the chunk lets through
            first = min(len(times), int(np.searchsorted(times, self.limit, side="right")) + 1)
            new = times[:first]
            fresh = slice(1, None) if len(starts) and first and new[0] == starts[-1] else slice(None)
            starts, ends = np.append(starts, new[fresh]), np.append(ends, times[way[:first]][fresh])
            self.open = times[-1] <= self.limit
        last = np.append(ends[1:] != ends[:-1], True)
        self.starts, self.ends = starts[last], ends[last]


def _entries(dealt: DataFrame, key: str, time: str, hold: int, inclusive: bool, chunk: int) -> DataFrame:
    """(key, __chunk, __last): the last time emitted before each chunk of a key.

    Each chunk is reduced to its ways through, at most one for each time in its first hold; only these are chained by key.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ways = None, None

        def close() -> pa.RecordBatch:
            arrays = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([ways.starts], pa.list_(pa.int64())), pa.array([ways.ends], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "chunk", "starts", "ends"])

        for batch in batches:
            for group, _, _, times in _runs(batch, [key, "__chunk"], time):
                if group[1] is None:
                    continue
                if group != now:
                    if ways is not None:
                        yield close()
                    now, ways = group, _Ways(group[1] * chunk, hold, inclusive)
                ways.add(times)
        if ways is not None:
            yield close()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, side = (), None, "left" if inclusive else "right"
        for batch in batches:
            before = []
            for k, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("key", "starts", "ends"))):
                now, last = (now, last) if now == (k,) else ((k,), None)
                before.append(last)
                at = 0 if last is None else int(np.searchsorted(starts, last + hold, side=side))
                last = ends[at] if at < len(ends) else last
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(before, pa.int64())], names=["key", "chunk", "last"])

    ways = dealt.sortWithinPartitions("__k", "__chunk", time).mapInArrow(reduce, "key string, chunk long, starts array<long>, ends array<long>")
    chained = ways.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(chain, "key string, chunk long, last long")
    return chained.select(F.struct(F.col("key").alias(key)).alias("__k"), F.col("chunk").alias("__chunk"), F.col("last").alias("__last"))


def suppress(
    candidates: DataFrame, hold_s: int, inclusive: bool, key: str = "source_ip", time: str = "t_us", order: str = "packet_id", carry: tuple[str, ...] = (), chunk_holds: int | None = None
) -> DataFrame:
    """(key, time, order, ``carry`` columns, emitted). ``inclusive``: a row exactly ``hold_s`` after the last emitted one is emitted.

    Rows are read in order of key and time, and a task keeps only the last time emitted.  With ``chunk_holds`` a key (text) is
    dealt out in chunks of so many holds, so that a busy key is spread over tasks: the same flags, for a second reading
    of the dealt rows.  A null key is a key of its own; a row without a time is not emitted; an empty table gives no rows.
    """
    hold = hold_s * 1_000_000
    kept = candidates.select(key, time, order, *carry)
    columns, results = kept.columns, StructType([*kept.schema.fields, StructField("emitted", BooleanType())])
    if chunk_holds is None:
        by, dealt = [key], kept.repartition(key).sortWithinPartitions(key, time, order)
    else:
        by, chunk = [key, "__chunk"], max(1, chunk_holds) * hold
        # As a struct a null key equals itself in the join, which then needs no other exchange of the rows.
        dealt = kept.withColumns({"__k": F.struct(key), "__chunk": F.floor(F.col(time) / chunk)}).repartition("__k", "__chunk")
        dealt = dealt.join(_entries(dealt, key, time, hold, inclusive, chunk), ["__k", "__chunk"], "left").sortWithinPartitions("__k", "__chunk", time, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            flags = np.zeros(batch.num_rows, dtype=bool)
            for group, begin, end, times in _runs(batch, by, time):
                if group != now:
                    now, last = group, None if chunk_holds is None or begin == end else batch.column("__last")[begin].as_py()
                flags[begin:end] = found = emitted(times, hold, inclusive, last)
                last = int(times[found][-1]) if found.any() else last
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(flags)], names=[*columns, "emitted"])

    return dealt.mapInArrow(run, results)

"""Heavy hitters of a stream with bounded state: mergeable Space-Saving summaries (Metwally, Agrawal, El Abbadi, ICDT 2005).

Keys are dealt to shards, and each shard keeps ``capacity`` counters.  A key without a counter takes over the smallest one: its count
may then be too high by what that counter held, which is kept as its error.  No count is ever too low; while a shard's keys fit its
counters, all counts are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNTER = "key string, n long, error long, t_us long, packet_id long"
HITTERS = f"slot long, {COUNTER}, others long"


def merged(counters: dict[int, tuple], counts: dict[str, tuple], capacity: int) -> dict[int, tuple]:
    """The counters (slot -> key, n, error, first time, first packet) that change when ``counts`` (key -> n, first time, first packet) are added.

    Counters of known keys grow first; then new keys, the largest counts first, take free slots or the smallest counters.
    """
    slots, changed = {c[0]: s for s, c in counters.items()}, {}
    for key in counts.keys() & slots.keys():
        n, t, p = counts[key]
        k, have, error, t0, p0 = counters[slots[key]]
        changed[slots[key]] = (k, have + n, error, *min((t0, p0), (t, p)))
    new = sorted((k for k in counts if k not in slots), key=lambda k: (-counts[k][0], counts[k][1:], k))
    size, over = len(counters), len(counters) + len(new) > capacity
    heap = [(changed.get(s, c)[1], s) for s, c in counters.items()] if over else []
    heapq.heapify(heap)
    for key in new:
        n, t, p = counts[key]
        if size < capacity:
            slot, least = size, 0
            size += 1
            if over:
                heapq.heappush(heap, (n, slot))
        else:
            least, slot = heap[0]
            heapq.heapreplace(heap, (least + n, slot))
        changed[slot] = (key, least + n, least, t, p)
    return changed


class HittersProcessor(StatefulProcessor):
    """The counters of one shard, in a map state: a batch writes those that it changes, and hands them on."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getMapState("counters", "slot long", COUNTER)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts: dict[str, tuple] = {}
        for part in rows:
            grouped = part.sort_values(["t_us", "packet_id"]).groupby("key", sort=False)
            firsts, sizes = grouped[["t_us", "packet_id"]].first(), grouped.size()
            for name, at_t, at_p, more in zip(firsts.index, firsts["t_us"].tolist(), firsts["packet_id"].tolist(), sizes.loc[firsts.index].tolist()):
                n, t, p = counts.get(name, (0, None, None))
                counts[name] = (n + more, *((at_t, at_p) if t is None else min((t, p), (at_t, at_p))))
        counters = {slot[0]: tuple(c) for slot, c in self.counters.iterator()} if self.counters.exists() else {}
        changed = merged(counters, counts, self.capacity)
        for slot, counter in changed.items():
            self.counters.updateValue((slot,), counter)
        counters |= changed
        others = min(c[1] for c in counters.values()) if len(counters) >= self.capacity else 0
        # a full shard hands on all counters, since the count that keys without one may have has changed with them
        told = counters if others else changed
        yield pd.DataFrame([(key[0] * self.capacity + s, *c, others) for s, c in sorted(told.items())], columns=[x.split()[0] for x in HITTERS.split(", ")])

    def close(self) -> None:
        pass


def heavy_hitters(rows: DataFrame, key: str = "source_ip", capacity: int = 1000, shards: int = 16) -> DataFrame:
    """A stream of changed counters (slot, key, n, error, t_us and packet_id of a first row, others) of rows with t_us and packet_id.

    The last row of a slot counts.  The true count of a key lies in [n - error, n]; ``others`` bounds that of any key of the shard that has no
    counter (0: there is none).  State: ``shards`` * ``capacity`` counters.  A key's error is at most its shard's rows / capacity.
    """
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.col(key).cast("string").alias("key"), "t_us", "packet_id")
    return dealt.groupBy("shard").transformWithStateInPandas(statefulProcessor=HittersProcessor(capacity), outputStructType=HITTERS, outputMode="update", timeMode="none")


def top_hitters(counters: DataFrame, n: int) -> DataFrame:
    """The n largest counters: key, n, error and ``sure`` (whether no other key, with a counter or without, can have a larger count)."""
    ranked = counters.orderBy(F.desc("n"), F.asc("t_us"), F.asc("packet_id")).limit(n + 1)
    rows = ranked.agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("t_us")).alias("t"), (-F.col("packet_id")).alias("p"), "key", "error")), asc=False).alias("r"))
    rest = counters.agg(F.coalesce(F.max("others"), F.lit(0)).alias("others"))
    both = rows.withColumn("one", F.lit(1)).join(F.broadcast(rest.withColumn("one", F.lit(1))), "one")  # one row on either side
    out = both.select("others", F.posexplode("r").alias("at", "c"), F.expr(f"coalesce(try_element_at(r, {n} + 1).n, 0)").alias("next")).where(F.col("at") < n)
    return out.select("at", F.col("c.key").alias("key"), F.col("c.n").alias("n"), F.col("c.error").alias("error"), (F.col("c.n") - F.col("c.error") >= F.greatest("others", "next")).alias("sure")).orderBy("at").drop("at")

"""Streaming jobs: live activity and scores, alerts with a cooldown, flow sessions, trends.

Rows wait in state until the watermark has passed them and are then worked on in
(t_us, packet_id) order, so that a stream gives what the batch job gives on the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetrisk.config import DEFAULTS, SERIOUS, RiskConfig
from packetrisk.operators.analytics import exact_sum, serious
from packetrisk.operators.isolation_forest import Forest
from packetrisk.operators.response import alert_candidates, with_refusals
from packetrisk.operators.trust import with_trust
from packetrisk.plans.score import assess, detect, flagged
from packetrisk.streaming.hitters import heavy_hitters
from packetrisk.streaming.shards import ActivityShard, BlockShard, shard_of

ACTIVITY_IN = ["packet_id", "t_us", "timestamp", "source_ip", "destination_ip", "protocol", "src_port", "dst_port", "packet_length", "anomaly_detected"]
ACTIVITY = (
    "source_ip string, packet_id long, t_us long, timestamp timestamp, destination_ip string, protocol int, src_port int, dst_port int, packet_length int, anomaly_detected boolean, "
    "packet_count long, unique_ports long, rate_10s long, rate_30s long, density_60s long, drift double"
)
#: A row that waits for the watermark, as the states hold it.
WAITING = "packet_id long, t_us long, stamp_us long, destination_ip string, protocol int, src_port int, dst_port int, packet_length int, anomaly_detected boolean"


#: Rows that a processor hands on at once.
FRAME_ROWS = 20_000


class _Ordered(StatefulProcessor):
    """Holds rows of a key until the watermark passes their timestamp, then hands them on in order.

    Waiting rows are a list state, to which a batch only adds; it is written anew when rows leave it.  What a key remembers is held by
    the subclass in states of its own.  Once the watermark is ``idle_s`` past a key's last row, ``expire`` drops what no
    later row can need.  (Spark offers a state's time to live in processing time only; timers keep it in event time.)
    """

    idle_s: float = 0.0
    waiting: str = WAITING

    def states(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def steps(self, key: str, rows: list[tuple]) -> list[dict]:
        """Work on rows in order of (t_us, packet_id)."""
        raise NotImplementedError

    def expire(self, seen_ms: int, idle_ms: int) -> bool:
        """Drop what has run out after ``idle_ms`` without rows; whether anything is left worth keeping."""
        return False

    def clear(self) -> None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("waiting", self.waiting)
        self.seen = handle.getValueState("seen", "ms long")
        self.states(handle)

    def _release(self, key: str, added: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        before = list(self.held.get()) if self.held.exists() else []
        waiting = sorted([*before, *added], key=lambda r: (r[1], r[0]))
        ready = [r for r in waiting if r[2] // 1000 < watermark_ms]
        rest = [r for r in waiting if r[2] // 1000 >= watermark_ms]
        if ready and (before or rest):
            self.held.put(rest) if rest else self.held.clear()
        elif added and not ready:
            self.held.appendList(added)
        out = self.steps(key, ready) if ready else []
        out += self.due(watermark_ms)
        if ready:
            seen = max(r[2] for r in ready) // 1000
            self.seen.update((seen,))
        else:
            seen = self.seen.get()[0] if self.seen.exists() else None
        ends = None if seen is None else seen + int(self.idle_s * 1000) + 1
        if rest:
            self.handle.registerTimer(min(r[2] for r in rest) // 1000 + 1)
        elif ends is not None and watermark_ms < ends:
            self.handle.registerTimer(ends)
        elif ends is not None and not self.expire(seen, watermark_ms - seen):
            self.clear()
            self.seen.clear()
        if out:
            for at in range(0, len(out), FRAME_ROWS):
                yield self.framed(out[at : at + FRAME_ROWS])

    def due(self, watermark_ms: int) -> list[dict]:
        """Rows that the watermark brings about by itself, after all rows before it."""
        return []

    def framed(self, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: list[tuple] = []
        for part in rows:
            added += self.entered(part)
        yield from self._release(key[0], added, timerValues.getCurrentWatermarkInMs())

    def entered(self, part: pd.DataFrame) -> list[tuple]:
        columns = [c.split()[0] for c in self.waiting.split(", ")]
        part = part.assign(stamp_us=part["timestamp"].astype("int64") // _per_us(part["timestamp"]))
        return [tuple(_plain(v) for v in r) for r in part[columns].itertuples(index=False, name=None)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() or self.seen.exists():
            yield from self._release(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _per_us(stamps: pd.Series) -> int:
    """Units of a timestamp column in a microsecond."""
    return 1000 if "ns" in str(stamps.dtype) else 1


def _plain(value):
    """A Python value of a cell, None where it is missing."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


class ActivityProcessor(_Ordered):
    """Flow counters, trailing counts and drift of one source; flows nest under their source.

    State in parts, so that a batch reads and writes only what its rows touch: a map of flows (destination: packets, ports, last
    time), a map of their ports (read for a flow that has rows, written when it meets a new port), a list of the times of the last
    60 seconds (added to, and written anew when half of it has run out), and the short history of the drift.  An idle source keeps
    only that history.  With ``forget_s`` it goes too, a time after the last row: state is then bounded by the sources of that
    time, and a source that returns later starts without history.
    """

    config: RiskConfig = DEFAULTS

    def __init__(self, forget_s: float | None = None):
        c = self.config
        self.idle_s = float(max(c.flow_timeout_s, c.density_window_s, c.packet_rate_window_s, c.rate_limit_window_s))
        self.forget_s = None if forget_s is None else max(self.idle_s, forget_s)

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.flows = handle.getMapState("flows", "destination_ip string", "packets long, ports long, last_us long")
        self.ports = handle.getMapState("ports", "destination_ip string", "ports array<int>")
        self.times = handle.getListState("times", "t_us long")
        self.counts = handle.getValueState("counts", "counts array<long>")
        self.swept = handle.getValueState("swept", "t_us long")

    def clear(self) -> None:
        for state in (self.flows, self.ports, self.times, self.counts, self.swept):
            state.clear()

    def expire(self, seen_ms: int, idle_ms: int) -> bool:
        for state in (self.flows, self.ports, self.times, self.swept):
            state.clear()
        if self.forget_s is None:
            return True
        ends = int(self.forget_s * 1000) + 1
        if idle_ms < ends:
            self.handle.registerTimer(seen_ms + ends)
            return True
        return False

    def _sweep(self, now: int, timeout: int) -> None:
        """Drop the flows that have run out; every flow is looked at once in a timeout at most."""
        swept = self.swept.get()[0] if self.swept.exists() else None
        if swept is not None and now - swept <= timeout:
            return
        self.swept.update((now,))
        if swept is not None:
            for key in [k for k, v in self.flows.iterator() if now - v[2] > timeout]:
                self.flows.removeKey(key)
                if self.ports.containsKey(key):
                    self.ports.removeKey(key)

    def steps(self, key: str, rows: list[tuple]) -> list[dict]:
        c, out = self.config, []
        timeout, longest = c.flow_timeout_s * 1_000_000, c.density_window_s * 1_000_000
        flows: dict[str, list] = {}
        for d in dict.fromkeys(r[3] for r in rows):
            known = self.flows.getValue((d,)) if self.flows.containsKey((d,)) else None
            ports = self.ports.getValue((d,)) if known is not None and self.ports.containsKey((d,)) else None
            # packets, ports, last time; whether the ports have changed
            flows[d] = [0, set(), None, False] if known is None else [known[0], set(ports[0]) if ports else set(), known[2], False]
        before = [t[0] for t in self.times.get()] if self.times.exists() else []
        # rising; rows at one time leave the waiting list together and count each other
        times, counts = [*before, *(r[1] for r in rows)], list(self.counts.get()[0]) if self.counts.exists() else []
        for packet_id, t, stamp_us, destination, protocol, src_port, dst_port, length, anomaly in rows:
            flow = flows[destination]
            if flow[2] is None or t - flow[2] > timeout:
                flow[:] = [0, set(), t, True]
            flow[0], flow[2] = flow[0] + 1, t
            if dst_port and dst_port not in flow[1]:
                flow[1].add(dst_port)
                flow[3] = True
            within = lambda s: bisect_right(times, t) - bisect_left(times, t - s * 1_000_000)  # noqa: E731, B023
            past = counts[-(c.drift_history - 1) :]
            drift = abs(flow[0] - sum(past) / len(past)) if len(past) >= c.drift_least - 1 else 0.0
            counts = [*past, flow[0]]
            out.append({
                "source_ip": key, "packet_id": packet_id, "t_us": t, "timestamp": pd.Timestamp(stamp_us, unit="us"), "destination_ip": destination, "protocol": protocol, "src_port": src_port, "dst_port": dst_port,
                "packet_length": length, "anomaly_detected": anomaly, "packet_count": flow[0], "unique_ports": len(flow[1]), "rate_10s": within(c.rate_limit_window_s), "rate_30s": within(c.packet_rate_window_s),
                "density_60s": within(c.density_window_s), "drift": float(drift),
            })
        for d, (packets, ports, last, changed) in flows.items():
            self.flows.updateValue((d,), (packets, len(ports), last))
            if changed:
                self.ports.updateValue((d,), (sorted(ports),))
        old = bisect_left(times, times[-1] - longest)
        if 2 * old > len(times):
            self.times.put([(t,) for t in times[old:]])
        else:
            self.times.appendList([(t,) for t in times[len(before) :]])
        self.counts.update((counts,))
        self._sweep(rows[-1][1], timeout)
        return out


class CooldownProcessor(_Ordered):
    """Emits a row unless one was emitted less than the cooldown before; a source idle for the cooldown leaves no state."""

    config: RiskConfig = DEFAULTS
    waiting = "packet_id long, t_us long, stamp_us long, threat_level string, risk_score double"

    def __init__(self):
        self.idle_s = float(self.config.alert_cooldown_s)

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t_us long")

    def clear(self) -> None:
        self.last.clear()

    def steps(self, key: str, rows: list[tuple]) -> list[dict]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for packet_id, t, _, level, risk in rows:
            if last is None or t - last >= self.config.alert_cooldown_s * 1_000_000:
                last = t
                out.append({"source_ip": key, "packet_id": packet_id, "t_us": t, "threat_level": level, "risk_score": risk})
        if out:
            self.last.update((last,))
        return out


class BlockProcessor(_Ordered):
    """Blocks a source's candidates, and releases a block once its hold is over: a timer emits the release when no row comes.

    The state of a source is its block alone; it goes with the release.
    """

    config: RiskConfig = DEFAULTS
    waiting = "packet_id long, t_us long, stamp_us long, source_ip string, refused string"

    def __init__(self):
        self.idle_s = float(self.config.block_hold_s)

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.block = handle.getValueState("block", "packet_id long, t_us long, stamp_us long, source_ip string")

    def clear(self) -> None:
        self.block.clear()

    def framed(self, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out).astype({"expires_us": "Int64"})

    def _row(self, packet_id: int, t: int, stamp_us: int, ip: str | None, status: str, expires: int | None = None) -> dict:
        return {"packet_id": packet_id, "t_us": t, "timestamp": pd.Timestamp(stamp_us, unit="us"), "source_ip": ip, "status": status, "expires_us": expires}

    def _released(self, block: tuple) -> dict:
        packet_id, t, stamp_us, ip = block
        after = self.config.block_hold_s * 1_000_000 + 1
        return self._row(packet_id, t + after, stamp_us + after, ip, f"Released IP: {ip}")

    def steps(self, key: str, rows: list[tuple]) -> list[dict]:
        hold, out = self.config.block_hold_s * 1_000_000, []
        before = block = self.block.get() if self.block.exists() else None
        for packet_id, t, stamp_us, ip, refused in rows:
            if refused is not None:
                out.append(self._row(packet_id, t, stamp_us, ip, refused))
                continue
            if block is not None and t - block[1] > hold:
                out.append(self._released(block))
                block = None
            if block is None:
                block = (packet_id, t, stamp_us, ip)
                out.append(self._row(packet_id, t, stamp_us, ip, f"Blocked IP: {ip}", t + hold))
            else:
                out.append(self._row(packet_id, t, stamp_us, ip, "Already Blocked"))
        if block is not None and block != before:
            self.block.update(block)
        return out

    def due(self, watermark_ms: int) -> list[dict]:
        block = self.block.get() if self.block.exists() else None
        if block is None:
            return []
        ends_ms = (block[2] + self.config.block_hold_s * 1_000_000) // 1000 + 1
        if watermark_ms <= ends_ms:
            self.handle.registerTimer(ends_ms + 1)
            return []
        self.block.clear()
        return [self._released(block)]


def _keyed(df: DataFrame, processor: StatefulProcessor, schema, key: str = "source_ip") -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def _sharded(df: DataFrame, processor: StatefulProcessor, schema: str, key: str, shards: int) -> DataFrame:
    """``df``, which has a watermark, through a processor of shards of ``key``; times pass it as microseconds."""
    rows = df.withColumns({"stamp_us": F.unix_micros("timestamp"), "shard": shard_of(key, shards)})
    out = _keyed(rows, processor, schema.replace("timestamp timestamp", "stamp_us long"), "shard")
    return out.withColumn("timestamp", F.timestamp_micros("stamp_us")).select(*(c.split()[0] for c in schema.split(", ")))


def live_activity(packets: DataFrame, delay: str = "5 seconds", forget_s: float | None = None, shards: int | None = None) -> DataFrame:
    """Streaming form of the activity step. Needs the RocksDB state store provider. ``forget_s``: see ActivityProcessor.

    ``shards``: for large micro-batches of many sources, in so many shards of sources (see ``streaming.shards``); the same values.
    """
    rows = packets.select(*ACTIVITY_IN).withWatermark("timestamp", delay)
    return _sharded(rows, ActivityShard(forget_s), ACTIVITY, "source_ip", shards) if shards else _keyed(rows, ActivityProcessor(forget_s), ACTIVITY)


def live_scores(packets: DataFrame, rdns: DataFrame, delay: str = "5 seconds", config: RiskConfig = DEFAULTS, forest: Forest | None = None, forget_s: float | None = None, shards: int | None = None) -> DataFrame:
    df = flagged(live_activity(packets, delay, forget_s, shards), forest).withColumn("rate_limited", F.col("rate_10s") > config.rate_limit_packets)
    return assess(with_trust(detect(df, config), rdns), config)


class OrderedCooldownProcessor(StatefulProcessor):
    """The cooldown of rows that come in order by source, as the live scores do: its state is the last alert's time."""

    config: RiskConfig = DEFAULTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.last.get()[0] if self.last.exists() else None, []
        for r in pd.concat(list(rows)).sort_values(["t_us", "packet_id"]).itertuples(index=False):
            if last is None or r.t_us - last >= self.config.alert_cooldown_s * 1_000_000:
                last = r.t_us
                out.append({"source_ip": key[0], "packet_id": r.packet_id, "t_us": r.t_us, "threat_level": r.threat_level, "risk_score": r.risk_score})
        if out:
            self.last.update((int(last),))
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def alerts_of_scores(scores: DataFrame) -> DataFrame:
    """Alerts within the query that makes the live scores, from the rows as it hands them on: in order of time for each source.

    A source that has had an alert keeps one number.  For scores from elsewhere, in any order, see ``live_alerts``.
    """
    rows = alert_candidates(scores).select("packet_id", "t_us", "source_ip", "threat_level", "risk_score")
    schema = "source_ip string, packet_id long, t_us long, threat_level string, risk_score double"
    return rows.groupBy("source_ip").transformWithStateInPandas(statefulProcessor=OrderedCooldownProcessor(), outputStructType=schema, outputMode="append", timeMode="none")


def live_alerts(scored: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Alerts of a stream of scored rows."""
    rows = alert_candidates(scored).select("packet_id", "t_us", "timestamp", "source_ip", "threat_level", "risk_score")
    return _keyed(rows.withWatermark("timestamp", delay), CooldownProcessor(), "source_ip string, packet_id long, t_us long, threat_level string, risk_score double")


def live_blocks(candidates: DataFrame, delay: str = "5 seconds", shards: int | None = None) -> DataFrame:
    """The block ledger of a stream of candidates (packet_id, t_us, timestamp, source_ip): their statuses, and the releases as their time comes. ``shards``: as in ``live_activity``."""
    rows = with_refusals(candidates.select("packet_id", "t_us", "timestamp", "source_ip")).withWatermark("timestamp", delay)
    schema = "packet_id long, t_us long, timestamp timestamp, source_ip string, status string, expires_us long"
    return _sharded(rows, BlockShard(), schema, "held", shards) if shards else _keyed(rows, BlockProcessor(), schema, key="held")


def live_block_table(ledger: DataFrame) -> DataFrame:
    """Changed rows (source_ip, packet_id, t_us, expires_us) of the table of blocks, by source: its latest block, or null where it has been released.

    For a ``KeptTable`` ordered by t_us; a row without ``expires_us`` is a source that is free.
    """
    return ledger.where(F.col("status").startswith("Blocked IP: ") | F.col("status").startswith("Released IP: ")).select("source_ip", "packet_id", "t_us", "expires_us")


def live_sessions(packets: DataFrame, delay: str = "5 seconds", config: RiskConfig = DEFAULTS) -> DataFrame:
    """Closed flow sessions. A session window is open as long as gaps are at most the timeout."""
    gap = F.session_window("timestamp", f"{config.flow_timeout_s * 1_000_000 + 1} microseconds")
    ports = F.size(F.collect_set(F.when(F.col("dst_port") != 0, F.col("dst_port")))).cast("long")
    grouped = packets.withWatermark("timestamp", delay).groupBy("source_ip", "destination_ip", gap.alias("w"))
    return grouped.agg(F.count("*").alias("packet_count"), ports.alias("unique_ports"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")).drop("w")


def live_trends(scored: DataFrame) -> DataFrame:
    """Running counts, largest and total risks per source, for output mode complete or update. Totals are exact, whatever the order and the batches of the rows."""
    return scored.groupBy("source_ip").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"), exact_sum(F.col("risk_score")).alias("total_risk"))


def live_attackers(scored: DataFrame, levels: list[str] = SERIOUS, capacity: int = 1000, shards: int = 16) -> DataFrame:
    """Changed counters of the sources with most serious rows, in bounded state (see ``heavy_hitters``); ``top_hitters`` of them are the top attackers."""
    return heavy_hitters(serious(scored, levels), capacity=capacity, shards=shards)

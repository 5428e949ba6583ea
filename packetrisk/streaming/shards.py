"""The live processors over shards of sources, for large micro-batches of many sources.

A processor of one source costs a few milliseconds for every source that a batch touches, whatever its rows: its states are read and
written value by value.  Here sources are dealt to shards, and a shard's states are a few packed tables, which a batch reads and writes
once; its rows are worked on together, in columns.  The values are those of the processors in ``live``, and so are the limits of the
state: rows that wait, what has not run out, and a short history of idle sources, each in an entry of its own that only
that source's return reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetrisk.config import DEFAULTS, RiskConfig

#: Shards that sources are dealt to, and rows that a processor hands on at once.
SHARDS, FRAME_ROWS = 128, 20_000

TEXT, LONG, INT = pa.string(), pa.int64(), pa.int32()


def shard_of(key: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard")


def _table(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


def _packed(table: pa.Table) -> bytes | None:
    if not table.num_rows:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all() if data else schema.empty_table()


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _objects(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_pylist(), dtype=object)


def _codes(*texts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of equal texts (missing ones are equal), in order of appearance, for each array; and the texts by number."""
    codes, names = pd.factorize(np.concatenate(texts), use_na_sentinel=False)
    return np.split(codes, np.cumsum([len(t) for t in texts])[:-1]), names


class _Shard(StatefulProcessor):
    """Holds the rows of a shard until the watermark passes their time, then hands them to ``steps`` in order of (``by``, t_us, packet_id)."""

    config: RiskConfig = DEFAULTS
    by: str
    waiting: pa.Schema
    #: Tables that the shard remembers.
    memory: dict[str, pa.Schema]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getValueState("packed", ", ".join([*(f"{n} binary" for n in ("waiting", *self.memory)), "timer_ms long", "idle long"]))
        self.states(handle)

    def states(self, handle: StatefulProcessorHandle) -> None:
        pass

    def steps(self, rows: pa.Table, rest: pa.Table, known: dict[str, pa.Table], watermark_ms: int) -> tuple[pd.DataFrame | None, dict[str, pa.Table], int | None]:
        """Work on ``rows`` and on what the watermark brings about, while ``rest`` waits: rows to hand on, the tables from now on, and when to look at them again."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._release([pa.Table.from_pandas(part[self.waiting.names], schema=self.waiting, preserve_index=False) for part in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release([], timerValues.getCurrentWatermarkInMs(), fired=True)

    def _release(self, added: list[pa.Table], watermark_ms: int, fired: bool = False) -> Iterator[pd.DataFrame]:
        packed = self.packed.get()
        waiting, *tables, timer, self.idle = packed or (None,) * (2 + len(self.memory)) + (0,)
        rows = pa.concat_tables([_unpacked(waiting, self.waiting), *added]).combine_chunks()
        passed = _longs(rows, "stamp_us") < watermark_ms * 1000
        ready, rest = rows.filter(pa.array(passed)), rows.filter(pa.array(~passed))
        ready = ready.sort_by([(c, "ascending") for c in (self.by, "t_us", "packet_id")])
        known = {name: _unpacked(data, schema) for (name, schema), data in zip(self.memory.items(), tables)}
        out, known, again = self.steps(ready, rest, known, watermark_ms)
        times = [again] if again is not None else []
        if rest.num_rows:
            times.append(pc.min(rest.column("stamp_us")).as_py() // 1000 + 1)
        due = min(times, default=None)
        if timer is not None and not fired and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and (fired or due != timer):
            self.handle.registerTimer(due)
        if rest.num_rows or self.idle or any(t.num_rows for t in known.values()):
            self.packed.update((_packed(rest), *(_packed(known[name]) for name in self.memory), due, self.idle))
        elif packed:
            self.packed.clear()
        for at in range(0, 0 if out is None else len(out), FRAME_ROWS):
            yield out.iloc[at : at + FRAME_ROWS]

    def close(self) -> None:
        pass


PACKETS = _table(packet_id=LONG, t_us=LONG, stamp_us=LONG, source_ip=TEXT, destination_ip=TEXT, protocol=INT, src_port=INT, dst_port=INT, packet_length=INT, anomaly_detected=pa.bool_())


class ActivityShard(_Shard):
    """Flow counters, trailing counts and drift of a shard's sources: the values of ``live.ActivityProcessor``.

    Tables: sources with their last time; the times of the last 60 seconds, flows, and the last packet counts by source (its
    row's number); ports by flow.  The counts of an idle source go to a map entry of its own (with ``forget_s`` they stay and go after that).
    """

    by, waiting = "source_ip", PACKETS
    memory = {"sources": _table(source_ip=TEXT, seen_ms=LONG), "times": _table(at=LONG, t_us=LONG), "flows": _table(at=LONG, destination_ip=TEXT, packets=LONG, last_us=LONG), "ports": _table(flow=LONG, port=LONG), "past": _table(at=LONG, n=LONG)}

    def __init__(self, forget_s: float | None = None):
        c = self.config
        self.idle_ms = 1000 * max(c.flow_timeout_s, c.density_window_s, c.packet_rate_window_s, c.rate_limit_window_s)
        self.forget_ms = None if forget_s is None else max(self.idle_ms, int(forget_s * 1000))

    def states(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "source_ip string", "counts array<long>")

    def _returned(self, names: np.ndarray, first: int) -> tuple[list[int], list[int]]:
        """Numbers and counts of the sources from ``first`` on that were idle."""
        at, n = [], []
        for number in range(first, len(names) if self.idle else 0):
            key = (None if names[number] != names[number] else names[number],)
            if self.history.containsKey(key):
                counts = self.history.getValue(key)[0]
                self.history.removeKey(key)
                self.idle -= 1
                at += [number] * len(counts)
                n += counts
        return at, n

    def steps(self, rows: pa.Table, rest: pa.Table, known: dict[str, pa.Table], watermark_ms: int) -> tuple[pd.DataFrame | None, dict[str, pa.Table], int | None]:
        c, out = self.config, None
        (_, code), names = _codes(_objects(known["sources"], "source_ip"), _objects(rows, "source_ip"))
        seen = np.full(len(names), -(2**62))
        seen[: known["sources"].num_rows] = _longs(known["sources"], "seen_ms")
        np.maximum.at(seen, code, _longs(rows, "stamp_us") // 1000)
        back_at, back_n = self._returned(names, known["sources"].num_rows)
        past_at, past_n = np.concatenate([_longs(known["past"], "at"), np.array(back_at, "int64")]), np.concatenate([_longs(known["past"], "n"), np.array(back_n, "int64")])
        times_at, times_t = _longs(known["times"], "at"), _longs(known["times"], "t_us")
        flows, ports = known["flows"].to_pandas(), known["ports"].to_pandas()
        if rows.num_rows:
            t = _longs(rows, "t_us")
            times_at, times_t, last, rates = self._rates(times_at, times_t, code, t, len(names))
            flows, ports, packets, unique = self._flows(flows, ports, code, _objects(rows, "destination_ip"), t, np.nan_to_num(rows.column("dst_port").to_pandas().to_numpy("float64")).astype("int64"), last)
            past_at, past_n, drift = self._drift(past_at, past_n, code, packets)
            out = rows.to_pandas().assign(packet_count=packets, unique_ports=unique, **rates, drift=drift)
        waits = pc.is_in(pa.array(names, TEXT, from_pandas=True), value_set=rest.column("source_ip").combine_chunks().unique()).to_numpy(zero_copy_only=False)
        idle = (watermark_ms > seen + self.idle_ms) & ~waits
        gone = idle if self.forget_ms is None else (watermark_ms > seen + self.forget_ms) & ~waits
        if self.forget_ms is None and idle.any():
            wanted = idle[past_at]
            for number, counts in pd.Series(past_n[wanted]).groupby(past_at[wanted]):
                self.history.updateValue((None if names[number] != names[number] else names[number],), ([int(n) for n in counts],))
                self.idle += 1
        number = np.cumsum(~gone) - 1
        flows = flows.assign(number=np.arange(len(flows)))[~idle[flows["at"].to_numpy("int64")]]
        moved = pd.Series(np.arange(len(flows)), index=flows["number"])
        ports = ports[ports["flow"].isin(moved.index)]
        times, past = ~idle[times_at], ~gone[past_at]
        columns = {
            "sources": (names[~gone], seen[~gone]), "times": (number[times_at[times]], times_t[times]), "flows": (number[flows["at"].to_numpy("int64")], flows["destination_ip"], flows["packets"], flows["last_us"]),
            "ports": (moved[ports["flow"]], ports["port"]), "past": (number[past_at[past]], past_n[past]),
        }
        tables = {name: pa.Table.from_arrays([pa.array(np.asarray(x), f.type, from_pandas=True) for x, f in zip(columns[name], schema)], schema=schema) for name, schema in self.memory.items()}
        ends = np.where(idle, seen + (self.forget_ms or 0), seen + self.idle_ms)[~gone & ~waits]
        return out, tables, int(ends.min()) + 1 if len(ends) else None

    def _rates(self, times_at: np.ndarray, times_t: np.ndarray, code: np.ndarray, t: np.ndarray, sources: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Times that later rows can reach, each source's last time, and the trailing counts of the rows; rows at one time count each other."""
        c = self.config
        windows = {"rate_10s": c.rate_limit_window_s, "rate_30s": c.packet_rate_window_s, "density_60s": c.density_window_s}
        longest = max(windows.values()) * 1_000_000
        at, all_t = np.concatenate([times_at, code]), np.concatenate([times_t, t])
        order = np.lexsort((all_t, at))
        at, all_t = at[order], all_t[order]
        begin, end = np.searchsorted(at, np.arange(sources)), np.searchsorted(at, np.arange(sources), side="right")
        some = end > begin
        low, last = np.zeros(sources, "int64"), np.zeros(sources, "int64")
        low[some], last[some] = all_t[begin[some]], all_t[end[some] - 1]
        # sources one after the other on one axis, further apart than a window
        shift = np.concatenate([[0], np.cumsum(last - low + longest + 1)[:-1]]) - low
        axis, here = all_t + shift[at], t + shift[code]
        until = np.searchsorted(axis, here, side="right")
        rates = {name: until - np.searchsorted(axis, here - s * 1_000_000, side="left") for name, s in windows.items()}
        near = all_t >= last[at] - longest
        return at[near], all_t[near], last, rates

    def _flows(self, flows: pd.DataFrame, ports: pd.DataFrame, code: np.ndarray, destination: np.ndarray, t: np.ndarray, port: np.ndarray, last: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
        """Flows and ports after the rows, which come in order by source; packets and different ports of each row's flow by then."""
        timeout = self.config.flow_timeout_s * 1_000_000
        old_at = flows["at"].to_numpy("int64")
        (old_d, new_d), texts = _codes(flows["destination_ip"].to_numpy(object), destination)
        found, number = np.unique(np.concatenate([old_at * len(texts) + old_d, code * len(texts) + new_d]), return_inverse=True)
        before, flow = number[: len(flows)], number[len(flows) :]
        had, packets, at_us = np.zeros(len(found), bool), np.zeros(len(found), "int64"), np.zeros(len(found), "int64")
        had[before], packets[before], at_us[before] = True, flows["packets"], flows["last_us"]
        order = np.argsort(flow, kind="stable")
        f, ts, p = flow[order], t[order], port[order]
        first = np.concatenate([[True], f[1:] != f[:-1]])
        gap = ts - np.where(first, at_us[f], np.concatenate([[0], ts[:-1]]))
        fresh = np.where(first & ~had[f], True, gap > timeout)
        begins = first | fresh
        session, begin = np.cumsum(begins) - 1, np.flatnonzero(begins)
        goes_on = ~fresh[begin]
        count = np.arange(len(f)) - begin[session] + 1 + np.where(goes_on, packets[f[begin]], 0)[session]
        # the ports that a session which goes on has met, then those of the rows
        carried = np.full(len(found), -1)
        carried[f[begin[goes_on]]] = np.flatnonzero(goes_on)
        port_flow, port_n = before[ports["flow"].to_numpy("int64")], ports["port"].to_numpy("int64")
        met = carried[port_flow] >= 0
        named = p != 0
        of, which = np.concatenate([carried[port_flow[met]], session[named]]), np.concatenate([port_n[met], p[named]])
        new = ~pd.Series(of * 2**32 + which % 2**32).duplicated().to_numpy()
        brought = np.bincount(of[: met.sum()], minlength=len(begin))
        fresh_port = np.zeros(len(f), "int64")
        fresh_port[named] = new[met.sum() :]
        total = np.cumsum(fresh_port)
        unique = total - (total - fresh_port)[begin][session] + brought[session]
        ends = np.flatnonzero(np.concatenate([f[1:] != f[:-1], [True]]))
        packets[f[ends]], at_us[f[ends]] = count[ends], ts[ends]
        owner, touched = found // len(texts), np.zeros(len(found), bool)
        touched[f] = True
        kept = last[owner] - at_us <= timeout
        last_session = np.full(len(found), -1)
        last_session[f[ends]] = session[ends]
        of_flow = f[begin][of]
        current = new & (last_session[of_flow] == of)
        still = ~touched[port_flow]
        ports_flow, ports_n = np.concatenate([port_flow[still], of_flow[current]]), np.concatenate([port_n[still], which[current]])
        place = np.cumsum(kept) - 1
        flows = pd.DataFrame({"at": owner[kept], "destination_ip": texts[(found % len(texts))[kept]], "packets": packets[kept], "last_us": at_us[kept]})
        ports = pd.DataFrame({"flow": place[ports_flow[kept[ports_flow]]], "port": ports_n[kept[ports_flow]]})
        back = np.empty(len(order), "int64")
        back[order] = np.arange(len(order))
        return flows, ports, count[back], unique[back]

    def _drift(self, past_at: np.ndarray, past_n: np.ndarray, code: np.ndarray, packets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last packet counts of each source, and each row's distance from the mean of those before it."""
        c = self.config
        at, n = np.concatenate([past_at, code]), np.concatenate([past_n, packets])
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        begin, end = np.searchsorted(at, at), np.searchsorted(at, at, side="right")
        here, total = np.arange(len(at)), np.concatenate([[0], np.cumsum(n)])
        low = np.maximum(begin, here - (c.drift_history - 1))
        size = here - low
        drift = np.where(size >= c.drift_least - 1, np.abs(n - (total[here] - total[low]) / np.maximum(size, 1)), 0.0)
        row = order >= len(past_at)
        out = np.empty(len(code))
        out[order[row] - len(past_at)] = drift[row]
        kept = end - here < c.drift_history
        return at[kept], n[kept], out


class BlockShard(_Shard):
    """The block ledger of a shard's sources, and the releases as their time comes: the rows of ``live.BlockProcessor``. It remembers the blocks in force."""

    by, waiting = "held", _table(packet_id=LONG, t_us=LONG, stamp_us=LONG, held=TEXT, source_ip=TEXT, refused=TEXT)
    memory = {"blocks": _table(held=TEXT, packet_id=LONG, t_us=LONG, stamp_us=LONG, source_ip=TEXT)}

    def steps(self, rows: pa.Table, rest: pa.Table, known: dict[str, pa.Table], watermark_ms: int) -> tuple[pd.DataFrame | None, dict[str, pa.Table], int | None]:
        hold, out = self.config.block_hold_s * 1_000_000, []
        blocks = {held: block for held, *block in zip(*(c.to_pylist() for c in known["blocks"].columns))}

        def released(block: list) -> None:
            packet_id, t, stamp_us, ip = block
            out.append((packet_id, t + hold + 1, stamp_us + hold + 1, ip, f"Released IP: {ip}", None))

        for packet_id, t, stamp_us, held, ip, refused in zip(*(c.to_pylist() for c in rows.columns)):
            if refused is not None:
                out.append((packet_id, t, stamp_us, ip, refused, None))
                continue
            block = blocks.get(held)
            if block is not None and t - block[1] > hold:
                released(block)
                block = None
            if block is None:
                blocks[held] = [packet_id, t, stamp_us, ip]
                out.append((packet_id, t, stamp_us, ip, f"Blocked IP: {ip}", t + hold))
            else:
                out.append((packet_id, t, stamp_us, ip, "Already Blocked", None))
        ends = {held: (block[2] + hold) // 1000 + 1 for held, block in blocks.items()}
        for held in [h for h, end in ends.items() if watermark_ms > end]:
            released(blocks.pop(held))
            del ends[held]
        table = pa.Table.from_pylist([dict(zip(self.memory["blocks"].names, (held, *block))) for held, block in blocks.items()], schema=self.memory["blocks"])
        names = ["packet_id", "t_us", "stamp_us", "source_ip", "status", "expires_us"]
        return pd.DataFrame(out, columns=names).astype({"expires_us": "Int64"}) if out else None, {"blocks": table}, min(ends.values()) + 1 if ends else None

"""Processors of shards give the rows of the processors of one source, in few state calls, and keep no more."""

import random

import pandas as pd
import pytest

from packetrisk.plans import streams
from packetrisk.plans.queries import QUERIES
from packetrisk.streaming.live import ActivityProcessor, BlockProcessor
from packetrisk.streaming.shards import ActivityShard, BlockShard
from tests.test_live_state import Clock, Handle, started


class Counted(Handle):
    def deleteTimer(self, at):
        self.timers.remove(at)


def shard(processor):
    handle = Counted()
    processor.init(handle)
    return handle


def plain(value):
    return None if value is None or value is pd.NaT or value != value else value


def told(frames, names, times=("timestamp", "stamp_us")):
    """Rows by packet and status, times as microseconds."""
    out = []
    for frame in frames:
        for row in frame.to_dict("records"):
            stamp = row.get("stamp_us", None)
            row["stamp_us"] = stamp if stamp is not None else row["timestamp"].value // 1000
            out.append(tuple(plain(row[n]) for n in names))
    return sorted(out, key=str)


def packets(rng, number, begin_s, span_s, sources):
    rows = []
    for i in range(number):
        t = begin_s * 1_000_000 + rng.randrange(span_s * 10) * 100_000
        rows.append({
            "packet_id": rng.randrange(10**6) * 1000 + i, "t_us": t, "timestamp": pd.Timestamp(t, unit="us"), "stamp_us": t, "source_ip": rng.choice(sources), "destination_ip": rng.choice(["x", "y", None]), "protocol": rng.choice([6, 17]),
            "src_port": rng.choice([1, None]), "dst_port": rng.choice([0, None, 22, 53, 80, 443, rng.randrange(60000)]), "packet_length": 60, "anomaly_detected": rng.choice([True, False]),
        })
    return pd.DataFrame(rows)


@pytest.mark.parametrize("forget_s", [None, 100])
@pytest.mark.parametrize("seed", range(6))
def test_activity_of_a_shard_is_that_of_its_sources(seed, forget_s):
    """Busy, idle and returning sources, missing addresses, equal times; batches of several frames."""
    rng, one, many = random.Random(seed), {}, ActivityShard(forget_s)
    handle = shard(many)
    names = ["source_ip", "packet_id", "t_us", "stamp_us", "destination_ip", "protocol", "src_port", "dst_port", "packet_length", "anomaly_detected", "packet_count", "unique_ports", "rate_10s", "rate_30s", "density_60s", "drift"]
    begin, rows_out = 0, 0
    for batch in range(14):
        sources = rng.sample(["a", "b", "c", "d", "e", "", None], 4)
        rows = packets(rng, rng.choice([1, 30, 300]), begin, 12, sources)
        watermark = Clock(begin * 1000 + rng.choice([0, 3000, 5500]))
        want = []
        for source in {s for s in rows["source_ip"]} | one.keys():
            if source not in one:
                one[source] = ActivityProcessor(forget_s)
                started(one[source])
            part = rows[rows["source_ip"].isna() if source is None else rows["source_ip"] == source]
            frames = one[source].handleInputRows((source,), iter([part]), watermark) if len(part) else one[source].handleExpiredTimer((source,), watermark, None)
            want += list(frames)
        halves = [rows.iloc[: len(rows) // 2], rows.iloc[len(rows) // 2 :]]
        got = told(many.handleInputRows((0,), iter([h for h in halves if len(h)]), watermark), names)
        assert got == told(want, names)
        rows_out += len(got)
        assert len(handle.timers) == 1
        begin += rng.choice([12, 12, 40, 130])
    assert rows_out > 300
    last = handle.timers[-1]
    many_out = told(many.handleExpiredTimer((0,), Clock((begin + 1000) * 1000), None), names)
    assert many_out == told([f for s, p in one.items() for f in p.handleExpiredTimer((s,), Clock((begin + 1000) * 1000), None)], names) and last
    # all are idle: histories in entries of their own, or nothing
    assert (handle.rows("history") > 3) is (forget_s is None)
    if forget_s is None:
        assert [x for x in handle.states["packed"].data[:-1] if x is not None] == [] and handle.states["packed"].data[-1] == handle.rows("history")
    else:
        assert not handle.kept()


def test_a_shard_is_read_and_written_once():
    processor = ActivityShard()
    handle = shard(processor)
    rng, calls = random.Random(1), []
    for name in ("get", "update"):
        plain_call = getattr(handle.states["packed"], name)
        setattr(handle.states["packed"], name, lambda *a, c=plain_call, n=name: (calls.append(n), c(*a))[1])
    for batch in range(3):
        rows = packets(rng, 500, 10 * batch, 10, [f"s{i}" for i in range(200)])
        list(processor.handleInputRows((0,), iter([rows]), Clock(10_000 * batch)))
    assert calls == ["get", "update"] * 3


@pytest.mark.parametrize("seed", range(4))
def test_blocks_of_a_shard_are_those_of_its_sources(seed):
    rng, one, many = random.Random(seed), {}, BlockShard()
    handle = shard(many)
    names, begin = ["packet_id", "t_us", "stamp_us", "source_ip", "status", "expires_us"], 0
    for batch in range(12):
        rows = packets(rng, rng.choice([1, 20]), begin, 30, ["a", "b", "c", "d", None]).assign(refused=lambda d: d["source_ip"].map(lambda s: "Invalid IP" if s in ("d", None) else None).astype(object))
        rows["refused"] = ["Invalid IP" if s is None or s in ("d", None) or s != s else None for s in rows["source_ip"]]
        rows["held"] = [f"refused:{s or ''}" if r else s for s, r in zip(rows["source_ip"], rows["refused"])]
        watermark = Clock(begin * 1000)
        want = []
        for held in set(rows["held"]) | one.keys():
            if held not in one:
                one[held] = BlockProcessor()
                started(one[held])
            part = rows[rows["held"] == held]
            want += list(one[held].handleInputRows((held,), iter([part]), watermark) if len(part) else one[held].handleExpiredTimer((held,), watermark, None))
        assert told(many.handleInputRows((0,), iter([rows]), watermark), names) == told(want, names)
        begin += rng.choice([30, 30, 200])
    far = Clock((begin + 1000) * 1000)
    assert told(many.handleExpiredTimer((0,), far, None), names) == told([f for h, p in one.items() for f in p.handleExpiredTimer((h,), far, None)], names)
    assert not handle.kept()


def test_scores_of_many_batches(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "work_folder", lambda spark: str(tmp_path))
    got = sorted(map(str, QUERIES["stream_scores"](spark, small).collect()))
    assert got == sorted(map(str, QUERIES["score_packets"](spark, small).collect()))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/scores-state").option("stateVarName", "packed").load()
    assert 1 < state.count() <= streams.SHARDS


def test_a_batch_does_not_read_the_tables_again(spark, small, tmp_path):
    """Of the given tables' folder nothing is in the plan of a batch: host names are derived once."""
    plan = streams._live_scores(spark, small, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    files = [f for r in spark.read.parquet(f"{tmp_path}/rdns").inputFiles() for f in [r]]
    assert files and "event_id" not in plan and "user_id" not in plan

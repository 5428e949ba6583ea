"""Kept tables, bounded heavy hitters, the event sink and the live block ledger."""

import os
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetrisk.operators import response
from packetrisk.plans.streams import drain, kept_table
from packetrisk.sources import event_store
from packetrisk.streaming.hitters import HITTERS, HittersProcessor, heavy_hitters, merged, top_hitters
from packetrisk.streaming.live import BlockProcessor, OrderedCooldownProcessor, live_blocks
from packetrisk.streaming.tables import KeptTable
from tests.test_live_state import Clock, Handle, started

S = 1_000_000
SCHEMA = StructType().add("key", "string").add("n", "long")


def files(folder):
    return sum(len([f for f in names if f.startswith("part-")]) for _, _, names in os.walk(folder))


def test_files_stay_bounded(spark, tmp_path):
    """Fifty batches leave the last rows of all keys and a bounded number of files."""
    table, want, most, rng = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "key", every=5, files=2), {}, 0, random.Random(1)
    assert table.read().count() == 0
    for number in range(50):
        rows = [(k, rng.randrange(1000)) for k in {rng.choice("abcdefghijklmnop") for _ in range(3)}]
        table.update(spark.createDataFrame(rows, SCHEMA), number)
        want |= dict(rows)
        most = max(most, files(tmp_path / "t"))
    assert {r.key: r.n for r in table.read().collect()} == want
    assert most <= 2 * (2 * 6 + 1) and len(os.listdir(tmp_path / "t" / "manifest")) <= 2 * 3


def test_a_batch_runs_again(spark, tmp_path, monkeypatch):
    """After a failure at any point the batch starts from the manifest before it; readers see the old table until the manifest is there."""
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "key", every=3, files=1)
    frames = [spark.createDataFrame([("a", i), (f"k{i}", i)], SCHEMA) for i in range(8)]
    for number, frame in enumerate(frames):
        before = sorted(map(tuple, table.read().collect()))
        with monkeypatch.context() as broken:
            broken.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                table.update(spark.createDataFrame([("a", -1), ("junk", 0)], SCHEMA), number)
        assert sorted(map(tuple, table.read().collect())) == before
        for _ in range(2):
            table.update(frame, number)
        assert {r.key: r.n for r in table.read().collect()} == {"a": number, **{f"k{i}": i for i in range(number + 1)}}


def test_order_decides(spark, tmp_path):
    table = KeptTable(spark, str(tmp_path / "t"), SCHEMA, "key", order=("n",), every=2)
    for number, rows in enumerate([[("a", 5), ("a", 9)], [("a", 7)], [("b", 1)], [("b", 0)]]):
        table.update(spark.createDataFrame(rows, SCHEMA), number)
    assert {r.key: r.n for r in table.read().collect()} == {"a": 9, "b": 1}


@pytest.mark.parametrize("capacity", [1, 4, 50])
def test_counters_keep_their_bounds(capacity):
    rng, truth, counters, seen = random.Random(capacity), Counter(), {}, 0
    for step in range(60):
        keys = [f"k{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(rng.randrange(1, 40))]
        truth.update(keys)
        seen += len(keys)
        counters |= merged(counters, {k: (n, step, i) for i, (k, n) in enumerate(Counter(keys).items())}, capacity)
        assert len(counters) <= capacity and len({c[0] for c in counters.values()}) == len(counters)
        others = min(c[1] for c in counters.values()) if len(counters) == capacity else 0
        assert others <= seen / capacity
        for key, n, error, *_ in counters.values():
            assert n - error <= truth[key] <= n and error <= seen / capacity
        assert all(n <= others for k, n in truth.items() if k not in {c[0] for c in counters.values()})


def test_counters_are_exact_where_keys_fit():
    counters, truth = {}, Counter()
    for step in range(20):
        keys = random.Random(step).choices("abcdefgh", k=30)
        truth.update(keys)
        counters |= merged(counters, {k: (n, step, 0) for k, n in Counter(keys).items()}, 8)
    assert {c[0]: c[1] for c in counters.values()} == truth and all(c[2] == 0 for c in counters.values())


def hitters_of(spark, tmp_path, rows, capacity, shards, parts=6):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], "source_ip string, t_us long, packet_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_ip string, t_us long, packet_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return kept_table(heavy_hitters(stream, capacity=capacity, shards=shards), str(tmp_path / "out"), "slot")


def test_hitters_of_a_skewed_stream(spark, tmp_path):
    """A third of all rows come from one source, thousands of sources come once: the counters stay few and within their bounds."""
    rng = random.Random(7)
    names = ["hot"] * 3000 + [f"warm{i % 5}" for i in range(2500)] + [f"cold{i}" for i in range(3000)]
    rng.shuffle(names)
    truth = Counter(names)
    table = hitters_of(spark, tmp_path, [(k, i, i) for i, k in enumerate(names)], capacity=40, shards=4)
    rows = table.collect()
    assert len(rows) <= 160 and len({r.key for r in rows}) == len(rows)
    assert all(r.n - r.error <= truth[r.key] <= r.n for r in rows)
    most = {}
    for r in rows:
        most.setdefault(r.slot // 40, set()).add(r.others)
    assert all(len(x) == 1 for x in most.values())
    top = top_hitters(table, 6).collect()
    assert top[0].key == "hot" and {r.key for r in top} == {"hot", *(f"warm{i}" for i in range(5))} and all(r.sure for r in top)
    assert not top_hitters(table, 30).orderBy("n").first().sure


def test_hitters_are_exact_where_sources_fit(spark, tmp_path):
    names = [random.Random(i).choice("abcdefgh") for i in range(300)]
    table = hitters_of(spark, tmp_path, [(k, i, i) for i, k in enumerate(names)], capacity=10, shards=3)
    assert {r.key: (r.n, r.error, r.t_us, r.others) for r in table.collect()} == {k: (n, 0, names.index(k), 0) for k, n in Counter(names).items()}
    assert [r.key for r in top_hitters(table, 3).collect()] == [k for k, _ in sorted(Counter(names).items(), key=lambda x: (-x[1], names.index(x[0])))[:3]]
    assert top_hitters(table.limit(0), 3).count() == 0


def test_a_shard_writes_what_changes():
    processor, handle = HittersProcessor(5), Handle()
    processor.init(handle)
    frame = lambda *keys: pd.DataFrame({"key": list(keys), "t_us": range(len(keys)), "packet_id": range(len(keys))})
    first = pd.concat(processor.handleInputRows((2,), iter([frame("a", "b", "a")]), None))
    assert first.columns.tolist() == [x.split()[0] for x in HITTERS.split(", ")] and first["slot"].tolist() == [10, 11] and first["n"].tolist() == [2, 1]
    assert pd.concat(processor.handleInputRows((2,), iter([frame("b")]), None))["slot"].tolist() == [11]


def stored(spark, rows):
    empty = spark.createDataFrame([], event_store.STORED)
    made = spark.createDataFrame(rows, "packet_id long, timestamp timestamp, risk_score double")
    return made.select(*(F.col(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path, write = str(tmp_path / "events"), event_store.batch_sink(str(tmp_path / "events"), "s")
    day = lambda d: pd.Timestamp(2024, 1, d).to_pydatetime()
    write(stored(spark, [(1, day(1), 1.0), (2, day(2), 2.0)]), 0)
    write(stored(spark, [(3, day(2), 3.0)]), 1)
    for _ in range(2):
        write(stored(spark, [(3, day(2), 3.0)]), 1)
    event_store.append_events(stored(spark, [(4, day(2), 4.0)]), path)
    event_store.batch_sink(path, "other")(stored(spark, [(5, day(2), 5.0)]), 1)
    write(stored(spark, [(1, day(1), 1.0), (2, day(2), 2.0)]), 0)
    assert sorted(r.packet_id for r in event_store.read_events(spark, path).collect()) == [1, 2, 3, 4, 5]
    plan = event_store.read_events(spark, path).where("timestamp >= '2024-01-02'")
    assert plan.count() == 4 and event_store.clear_events(spark, path) == (5, 0)


def test_a_restarted_stream_adds_nothing(spark, tmp_path):
    """A stream that fails after writing, and one that starts again with its checkpoint, store every event once."""
    source, path = str(tmp_path / "in"), str(tmp_path / "events")
    rows = stored(spark, [(i, pd.Timestamp(2024, 1, 1 + i % 3).to_pydatetime(), float(i)) for i in range(30)])
    rows.repartition(6).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write, calls = event_store.batch_sink(path, "s"), []

    def failing(batch, number):
        write(batch, number)
        calls.append(number)
        if len(calls) == 3:
            raise RuntimeError("lost")

    start = lambda sink: stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start(failing).awaitTermination()
    start(failing).awaitTermination()
    assert calls == [0, 1, 2, 2, 3, 4, 5]
    assert sorted(r.packet_id for r in event_store.read_events(spark, path).collect()) == list(range(30))


def blocked(processor, seconds, watermark_s, ip="8.8.8.8", refused=None):
    rows = pd.DataFrame([{"packet_id": s, "t_us": s * S, "timestamp": pd.Timestamp(s, unit="s"), "source_ip": ip, "refused": refused} for s in seconds])
    return [(r.t_us, r.status) for out in processor.handleInputRows((ip,), iter([rows]), Clock(watermark_s * 1000)) for r in out.itertuples()]


def test_a_timer_releases_a_block():
    processor = BlockProcessor()
    handle = started(processor)
    assert blocked(processor, [100, 150, 219], 220) == [(100 * S, "Blocked IP: 8.8.8.8"), (150 * S, "Already Blocked"), (219 * S, "Already Blocked")]
    assert 220_002 in handle.timers
    assert not [r for out in processor.handleExpiredTimer(("8.8.8.8",), Clock(220_001), None) for r in out.itertuples()]
    out = [r for out in processor.handleExpiredTimer(("8.8.8.8",), Clock(220_002), None) for r in out.itertuples()]
    assert [(r.packet_id, r.t_us, r.status) for r in out] == [(100, 220 * S + 1, "Released IP: 8.8.8.8")]
    assert handle.kept() == {"seen"}
    list(processor.handleExpiredTimer(("8.8.8.8",), Clock(339_001), None))
    assert not handle.kept()


def test_the_hold_is_inclusive():
    processor = BlockProcessor()
    started(processor)
    out = blocked(processor, [0, 120, 121, 300], 1000)
    assert out == [(0, "Blocked IP: 8.8.8.8"), (120 * S, "Already Blocked"), (120 * S + 1, "Released IP: 8.8.8.8"), (121 * S, "Blocked IP: 8.8.8.8"), (241 * S + 1, "Released IP: 8.8.8.8"), (300 * S, "Blocked IP: 8.8.8.8"), (420 * S + 1, "Released IP: 8.8.8.8")]
    assert blocked(processor, [2000], 3000, "10.0.0.1", "Skipped (Local/Private IP)") == [(2000 * S, "Skipped (Local/Private IP)")]


def test_blocks_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Several small batches: the release of a quiet source comes by itself, as the watermark moves with other sources."""
    rng, rows, t = random.Random(3), [], 0
    for i in range(250):
        t += rng.choice([0, S, 7 * S, 40 * S])
        rows.append((i, t, pd.Timestamp(t, unit="us").to_pydatetime(), rng.choice(["8.8.8.8", "9.9.9.9", "10.1.1.1", "x", None])))
    rows.append((999, t + 10_000 * S, pd.Timestamp(t + 10_000 * S, unit="us").to_pydatetime(), "x"))
    schema = "packet_id long, t_us long, timestamp timestamp, source_ip string"
    for i in range(0, len(rows), 50):
        spark.createDataFrame(rows[i : i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(live_blocks(stream), str(tmp_path), "ledger").where("packet_id <> 999").select("packet_id", "t_us", "source_ip", "status", "expires_us")
    ledger = response.block_ledger(spark.createDataFrame(rows[:-1], schema))
    want = response.block_events(ledger, t + 10_000 * S)
    row = lambda df: sorted(map(str, df.select("packet_id", "t_us", "source_ip", "status", "expires_us").collect()))
    assert row(got) == row(want) and got.where("status like 'Released%'").count() > 3


def test_releases_by_then(spark):
    ledger = spark.createDataFrame([(1, 0, "a", "Blocked IP: a", 120 * S), (2, 5, "a", "Already Blocked", None), (3, 50 * S, "b", "Blocked IP: b", 170 * S), (4, 130 * S, "c", "Invalid IP", None)], "packet_id long, t_us long, source_ip string, status string, expires_us long")
    got = {(r.packet_id, r.t_us, r.status) for r in response.block_events(ledger, 120 * S + 1).collect()}
    assert got == {(1, 0, "Blocked IP: a"), (1, 120 * S + 1, "Released IP: a"), (2, 5, "Already Blocked"), (3, 50 * S, "Blocked IP: b")}
    assert len(response.block_events(ledger, 120 * S).collect()) == 3


def test_cooldown_of_rows_in_order():
    processor, handle = OrderedCooldownProcessor(), Handle()
    processor.init(handle)
    frame = lambda *seconds: pd.DataFrame([{"packet_id": i, "t_us": s * S, "threat_level": "HIGH", "risk_score": 80.0} for i, s in enumerate(seconds)])
    out = [r.t_us // S for rows in ([frame(40, 10, 39), frame(41)], [frame(69, 70, 100)], [frame(101)]) for x in processor.handleInputRows(("a",), iter(rows), None) for r in x.itertuples()]
    assert out == [10, 40, 70, 100] and handle.states["last"].data == (100 * S,)

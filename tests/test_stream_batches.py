"""Micro-batches by bytes and rows, whatever the number of files; equal times in the live activity; exact attackers where counters are few."""

import os

import pandas as pd

from packetrisk.plans import streams
from packetrisk.streaming import live
from packetrisk.streaming.live import ActivityProcessor
from tests.test_live_state import Clock, started


def test_many_small_files_are_one_batch(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "work_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(streams, "FILE_ROWS", 200)
    few = live.live_attackers
    monkeypatch.setattr(live, "live_attackers", lambda scored, levels: few(scored, levels, capacity=1, shards=1))
    got = [(r.key, r.n) for r in streams.stream_attackers(spark, small, ["LOW", "MEDIUM"]).collect()]
    scores = spark.read.parquet(f"{tmp_path}/scores").where("source_ip <> 'sentinel' and threat_level in ('LOW', 'MEDIUM') and source_ip not like '10.%' and source_ip not like '192.168%'")
    counts = {r.source_ip: r["count"] for r in scores.groupBy("source_ip").count().collect()}
    assert dict(got) == {k: counts[k] for k, _ in got} and sorted((n for _, n in got), reverse=True) == sorted(counts.values(), reverse=True)[:5]
    assert len([n for n in os.listdir(tmp_path / "in") if n.startswith("part-")]) == 6
    assert len([n for n in os.listdir(tmp_path / "table-state" / "commits") if n.isdigit()]) == 1


def test_equal_times_count_each_other_live():
    processor = ActivityProcessor()
    started(processor)
    rows = pd.DataFrame([{"packet_id": i, "t_us": 5_000_000, "timestamp": pd.Timestamp(5, unit="s"), "destination_ip": "d", "protocol": 6, "src_port": 1, "dst_port": 80, "packet_length": 1, "anomaly_detected": False} for i in range(3)])
    out = pd.concat(processor.handleInputRows(("a",), iter([rows]), Clock(60_000)))
    assert out["rate_10s"].tolist() == [3, 3, 3] and out["packet_count"].tolist() == [1, 2, 3]


def test_block_table_in_few_batches(spark, small, tmp_path, monkeypatch):
    """The ledger's files, one for each task of a batch, are one batch of the table; state has no more parts than there are cores."""
    monkeypatch.setattr(streams, "work_folder", lambda spark: str(tmp_path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        table = streams.stream_block_table(spark, small)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "12"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    blocks = spark.read.parquet(f"{tmp_path}/ledger").where("expires_us is not null and source_ip <> 'sentinel'")
    assert {(r.source_ip, r.t_us - 120_000_001) for r in table.collect()} == {(r.source_ip, r["max(t_us)"]) for r in blocks.groupBy("source_ip").agg({"t_us": "max"}).collect()}
    assert len([n for n in os.listdir(tmp_path / "table-state" / "commits") if n.isdigit()]) == 1
    assert len([n for n in os.listdir(tmp_path / "ledger-state" / "state" / "0") if n.isdigit()]) == 4

"""Replayed files are read in the order of their packets, whichever task ends first."""

import os

import pytest
from pyspark.sql import functions as F

from packetrisk.plans import streams
from packetrisk.plans.queries import QUERIES
from packetrisk.sources import mapping
from packetrisk.streaming import live


def test_files_are_read_in_order_of_time(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    streams.replay(spark, small, str(tmp_path))
    spans = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name().alias("file")).agg(F.min("t_us").alias("first"), F.max("t_us").alias("last")).collect()
    by_change = sorted(spans, key=lambda r: os.stat(r.file.removeprefix("file://")).st_mtime_ns // 1_000_000)
    assert len({os.stat(r.file.removeprefix("file://")).st_mtime_ns // 1_000_000 for r in spans}) == len(spans) == 21
    assert all(a.last < b.first for a, b in zip(by_change, by_change[1:]))


@pytest.mark.parametrize("late", [False, True])
def test_sessions_of_many_batches(spark, small, tmp_path, monkeypatch, late):
    """Ten batches give the sessions of the whole; were the files read backwards, rows would be lost."""
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    source = streams.replay(spark, small, str(tmp_path))
    if late:
        streams._in_turn(spark, streams._parts(spark, f"{tmp_path}/in")[::-1])
    got = streams.drain(live.live_sessions(source), str(tmp_path), "sessions").where("source_ip <> 'sentinel'")
    want = QUERIES["flow_sessions"](spark, small).groupBy("source_ip", "destination_ip", "first_us").agg(F.max("packet_count").alias("n"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    same = rows(got.select("source_ip", "destination_ip", "first_us", "packet_count")) == rows(want)
    assert same is not late and mapping.packets(spark, small).count() == 1000


def test_totals_do_not_depend_on_the_batches(spark, tmp_path):
    """As doubles 0.1 + 0.2 + 0.3 is 0.6000000000000001 in one order and 0.6 in the other; over many rows such parts reach the digits shown."""
    for value in (0.1, 0.2, 0.3):
        spark.createDataFrame([("a", value)], "source_ip string, risk_score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams._in_turn(spark, sorted(streams._parts(spark, str(tmp_path / "in")), key=lambda f: spark.read.parquet(f).first().risk_score))
    stream = spark.readStream.schema("source_ip string, risk_score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in streams.kept_table(live.live_trends(stream), str(tmp_path), "source_ip").collect()] == [("a", 3, 0.3, 0.6)]

"""Rounded risk, the levels beside it, alerts with missing fields, the ledger in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.functions.numbers import cents
from packetrisk.operators import analytics, response
from packetrisk.plans.score import assess, score_packets
from packetrisk.sources import mapping

S = 1_000_000


def test_cents_are_exact(spark):
    rng = random.Random(2)
    values = [2.675, 0.125, 0.375, 1.005, 74.996, 74.995, 89.996, 45.001, 45.004, 0.0, 100.0, 99.995, 1e-9]
    values += [rng.randrange(20_000) / 200 for _ in range(3000)] + [rng.uniform(0, 100) for _ in range(2000)] + [0.4 * rng.randrange(250) * 0.7 * 0.3 for _ in range(1000)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").withColumn("y", cents(F.col("x"))).orderBy("i").collect()
    assert [r.y for r in got] == [round(v, 2) for v in values]


ROW = "source_ip string, signature_score int, anomaly_detected boolean, density_60s long, drift double, rate_30s long, trust_score double, domain string"


def test_level_comes_from_the_unrounded_risk(spark):
    """A risk that rounds up to a limit keeps the level below it."""
    rows = [("8.8.8.8", 100, True, 0, d, 0, 0.4, "x") for d in (249.8, 250.0)]  # 70 + 10 * d / 500: 74.996 and 75
    out = assess(spark.createDataFrame(rows, ROW)).orderBy("drift").select("risk_score", "threat_level").collect()
    assert [tuple(r) for r in out] == [(75.0, "MEDIUM"), (75.0, "HIGH")]
    rows = [("8.8.8.8", 100, True, 50, d, 0, 0.4, "x") for d in (-0.2, 0.001)]  # 90 + 10 * d / 500: 89.996 and 90.00002
    out = assess(spark.createDataFrame(rows, ROW)).orderBy("drift").select("risk_score", "threat_level", "response_action").collect()
    assert [tuple(r) for r in out] == [(90.0, "HIGH", "Monitored"), (90.0, "CRITICAL", "Would Block (Simulation): 8.8.8.8")]


def test_profiles_of_rounded_risks(spark):
    """74.996 counts as 75 in the table, and 45.001 and 45.004 tie, so that the first to come is first."""
    rows = [(1, 1, "b", 45.001), (2, 2, "a", 45.004), (3, 3, "c", 74.996)]
    df = spark.createDataFrame(rows, "t_us long, packet_id long, source_ip string, x double").withColumns({"risk_score": cents(F.col("x")), "threat_level": F.lit("MEDIUM"), "timestamp": F.lit(None).cast("timestamp")})
    assert [(r.source_ip, r.risk) for r in analytics.top_profiles(df).collect()] == [("c", 75), ("b", 45), ("a", 45)]


def test_scores_have_two_decimals(spark, small):
    rows = score_packets(mapping.packets(spark, small), mapping.rdns(spark, small)).select("risk_score").collect()
    assert all(r.risk_score == round(r.risk_score, 2) for r in rows) and len({r.risk_score for r in rows}) > 5


@pytest.mark.parametrize("chunk_holds", [None, 2])
def test_alerts_of_missing_fields(spark, chunk_holds):
    rows = [(1, 0, None, "HIGH", None), (2, 1, "", "HIGH", 80.0), (3, 30 * S, None, "CRITICAL", 95.5), (4, 0, "a", "LOW", 99.0), (5, 0, "a", None, 99.0)]
    df = spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string, threat_level string, risk_score double")
    got = {r.packet_id: (r.source_ip, r.risk_score, r.message) for r in response.alerts(df, chunk_holds=chunk_holds).collect()}
    assert got == {1: ("unknown", 0.0, "Threat detected from unknown with risk 0.0"), 3: ("unknown", 95.5, "Threat detected from unknown with risk 95.5")}


@pytest.mark.parametrize("chunk_holds", [None, 1])
def test_ledger_of_repeated_ids(spark, chunk_holds):
    rows = [(1, 0, "45.1.1.1"), (1, 0, "45.1.1.1"), (1, 5, "10.0.0.1"), (1, 6, None), (1, 200 * S, "45.1.1.1"), (2, 200 * S, "x"), (3, None, "45.1.1.1")]
    df = spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string")
    ledger = response.block_ledger(df, chunk_holds=chunk_holds)
    assert sorted(r.status for r in ledger.collect()) == ["Already Blocked"] * 2 + ["Blocked IP: 45.1.1.1"] * 2 + ["Invalid IP"] * 2 + ["Skipped (Local/Private IP)"]
    assert response.block_status(ledger, 200 * S).first().asDict() == {"total_blocked": 1, "recent_blocks": ["45.1.1.1", "45.1.1.1"]}
    assert response.block_status(ledger, 100 * S).first().asDict() == {"total_blocked": 1, "recent_blocks": ["45.1.1.1"]}
    assert response.block_status(response.block_ledger(df.limit(0)), 0).first().asDict() == {"total_blocked": 0, "recent_blocks": []}


def test_ledger_and_status_read_their_input_once(spark, small):
    rows = mapping.packets(spark, small).where("value > 100")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("events.parquet") or df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    ledger = response.block_ledger(rows)
    assert scans(ledger) == scans(rows) == 1 and scans(response.block_status(ledger, 0)) == 1


def test_status_keeps_the_latest_of_many_tasks(spark):
    df = spark.range(0, 4000, 1, 8).select(F.col("id").alias("packet_id"), (F.col("id") * 7 % 4001).alias("t_us"), F.concat(F.lit("9.9.9."), F.col("id").cast("string")).alias("source_ip"), F.lit(10**9).cast("long").alias("expires_us"))
    want = [f"9.9.9.{i}" for i in sorted(range(4000), key=lambda i: (-(i * 7 % 4001), -i))[:10]]
    assert response.block_status(df, 10**6).first().asDict() == {"total_blocked": 4000, "recent_blocks": want}

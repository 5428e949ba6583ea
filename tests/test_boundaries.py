"""Thresholds, windows and holds, one assert on each side."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.config import RiskConfig
from packetrisk.functions import addresses, numbers, scores
from packetrisk.operators import analytics, response
from packetrisk.operators.drift import behavioral_drift, halving_drift
from packetrisk.operators.flows import flow_sessions, flow_snapshots
from packetrisk.operators.suppress import emitted, suppress
from packetrisk.operators.trailing import range_counts, trailing_counts
from packetrisk.operators.trust import with_trust
from packetrisk.sources import event_store, training
from packetrisk.sources.packets import NESTED, flatten, ingest

S = 1_000_000


def packets(spark, rows):
    return spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string, destination_ip string, dst_port int")


def test_flow_gap_and_ports(spark):
    df = packets(spark, [(1, 0, "a", "x", 80), (2, 10 * S, "a", "x", 80), (3, 20 * S + 1, "a", "x", 0), (4, 20 * S + 1, "a", "x", 22), (5, 5, "a", "y", 1)])
    got = {r.packet_id: (r.packet_count, r.unique_ports) for r in flow_snapshots(df).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 0), 4: (2, 1), 5: (1, 1)}
    sessions = flow_sessions(flow_snapshots(df), at_us=30 * S + 1).collect()
    assert sum(r.active for r in sessions) == 1 and len(sessions) == 3


@pytest.mark.parametrize("bucket", [None, 7, 60])
def test_trailing_edges_and_buckets(spark, bucket):
    df = packets(spark, [(1, 0, "a", "x", 1), (2, 10 * S, "a", "x", 1), (3, 10 * S + 1, "a", "x", 1), (4, 30 * S, "a", "x", 1), (5, 30 * S, "a", "x", 1), (6, 60 * S + 1, "b", "x", 1)])
    got = {r.packet_id: (r.w10, r.w30) for r in trailing_counts(df, {"w10": 10, "w30": 30}, bucket_s=bucket).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 3), 4: (1, 4), 5: (2, 5), 6: (1, 1)}


def test_trailing_agrees_with_range_frames(spark):
    rng = random.Random(5)
    rows = [(i, t * 1000 + i, rng.choice("abc"), "x", 1) for i, t in enumerate(rng.sample(range(200_000), 400))]
    df = packets(spark, rows)
    windows = {"w10": 10, "w60": 60}
    want = sorted(map(tuple, range_counts(df, windows).select("packet_id", "w10", "w60").collect()))
    for bucket in (None, 30):
        got = sorted(map(tuple, trailing_counts(df, windows, bucket_s=bucket).select("packet_id", "w10", "w60").collect()))
        assert got == want
        assert all(a <= b for _, a, b in got)


def test_drift_history(spark):
    rows = [(i, i * S, "a", "x", 1, c) for i, c in enumerate([1, 1, 1, 1, 5] + [2] * 20)]
    df = spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string, destination_ip string, dst_port int, packet_count long")
    got = [r.drift for r in behavioral_drift(df).orderBy("packet_id").collect()]
    assert got[:5] == [0.0, 0.0, 0.0, 0.0, 4.0]
    assert got[24] == 0.0  # the last 19 before it are all 2


def test_halving_drift_is_the_whole_fold(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 1000) for _ in range(150)]
    df = spark.createDataFrame([(i, i, "a", v) for i, v in enumerate(values)], "packet_id long, t_us long, source_ip string, packet_count long")
    base, want = None, []
    for x in values:
        want.append(0.0 if base is None else abs(x - base))
        base = float(x) if base is None else (base + x) / 2
    assert [r.ema_drift for r in halving_drift(df).orderBy("packet_id").collect()] == pytest.approx(want, abs=1e-9)


FIELDS = "unique_ports int, packet_rate int, packet_count int, protocol string, dst_port int, source_ip string"


@pytest.mark.parametrize(
    ("ports", "rate", "count", "protocol", "want"),
    [(20, 0, 0, "6", 0), (21, 0, 0, "6", 40), (4, 50, 0, "6", 0), (4, 51, 0, "6", 30), (3, 51, 0, "6", 0), (3, 0, 500, "6", 0), (3, 0, 501, "6", 20), (2, 0, 501, "6", 0), (2, 99, 999, "TCP", 0), (30, 99, 999, "TCP", 90), (30, 99, 999, "6", 90)],
)
def test_threshold_signatures(spark, ports, rate, count, protocol, want):
    df = spark.createDataFrame([(ports, rate, count, protocol, 1, "s")], FIELDS)
    row = df.select(scores.signature_score().alias("s"), scores.signature_alerts().alias("a")).first()
    assert row.s == want and sum({"PORT_SCAN": 40, "TRAFFIC_FLOOD": 30, "HIGH_TRAFFIC_SOURCE": 20}[x.type] for x in row.a) == want


def test_tcp_number_option(spark):
    df = spark.createDataFrame([(2, 99, 999, "6", 1, "s")], FIELDS)
    assert df.select(scores.signature_score(RiskConfig(tcp_number=6)).alias("s")).first().s == 0


@pytest.mark.parametrize(
    ("port", "count", "protocol", "want"),
    [(0, 21, 6, ""), (1, 20, 6, ""), (1, 21, 6, "Port Scan"), (1023, 21, 6, "Port Scan"), (1024, 21, 6, ""), (5000, 100, 6, ""), (5000, 101, 6, "Possible DDoS"), (5000, 80, 17, ""), (5000, 81, 17, "Suspicious UDP Flood"),
     (22, 15, 6, ""), (22, 16, 6, "SSH Brute Force"), (80, 60, 6, "Port Scan"), (80, 61, 6, "Port Scan,HTTP Flood"), (53, 70, 6, "Port Scan"), (53, 71, 6, "Port Scan,DNS Amplification")],
)
def test_rule_catalogue(spark, port, count, protocol, want):
    df = spark.createDataFrame([(port, count, protocol)], "dst_port int, packet_count int, protocol int")
    assert df.select(F.array_join(scores.matched_rules(), ",").alias("m")).first().m == want


def test_own_rules_are_columns(spark):
    rules = [("Odd", F.col("x") % 2 == 1, 7)]
    assert spark.range(3).withColumnRenamed("id", "x").select(scores.rule_score(rules).alias("s")).agg(F.sum("s")).first()[0] == 7


@pytest.mark.parametrize(("score", "level"), [(39.999, "LOW"), (40.0, "MEDIUM"), (74.999, "MEDIUM"), (75.0, "HIGH"), (89.999, "HIGH"), (90.0, "CRITICAL")])
def test_levels(spark, score, level):
    assert spark.range(1).select(scores.threat_level(F.lit(score)).alias("l")).first().l == level


def test_signal_strength_edges(spark):
    df = spark.createDataFrame([(30, False, 20, 50.0, 10), (31, True, 21, 50.1, 11)], "signature_score int, anomaly_detected boolean, density_60s int, drift double, rate_30s int")
    assert [r.n for r in df.select(scores.signal_strength().alias("n")).collect()] == [0, 5]


@pytest.mark.parametrize(("density", "drift", "want"), [(50, 20, 0), (51, 21, 25), (100, 50, 25), (101, 51, 50)])
def test_fusion(spark, density, drift, want):
    got = spark.range(1).select(scores.fused(F.lit(0), F.lit(density), F.lit(drift), F.lit(False)).alias("x"), scores.fused(F.lit(90), F.lit(200), F.lit(99), F.lit(True)).alias("y")).first()
    assert got.x == want and got.y == 100


def test_holds(spark):
    rows = [(1, 0, "a", "x", 1), (2, 29_999_999, "a", "x", 1), (3, 30 * S, "a", "x", 1), (4, 31 * S, "a", "x", 1), (5, 31 * S, "b", "x", 1)]
    got = {r.packet_id: r.emitted for r in suppress(packets(spark, rows), 30, inclusive=True).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert emitted(__import__("numpy").array([0, 120 * S, 120 * S + 1]), 120 * S, False).tolist() == [True, False, True]


def test_block_ledger(spark):
    rows = [(1, 0, "45.1.1.1", "x", 1), (2, 120 * S, "45.1.1.1", "x", 1), (3, 120 * S + 1, "45.1.1.1", "x", 1), (4, 0, "unknown", "x", 1), (5, 0, "10.0.0.1", "x", 1)]
    ledger = response.block_ledger(packets(spark, rows))
    assert {r.packet_id: r.status for r in ledger.collect()} == {1: "Blocked IP: 45.1.1.1", 2: "Already Blocked", 3: "Blocked IP: 45.1.1.1", 4: "Invalid IP", 5: "Skipped (Local/Private IP)"}
    status = response.block_status(ledger, 120 * S + 1).first()
    assert status.total_blocked == 1 and status.recent_blocks == ["45.1.1.1", "45.1.1.1"]


@pytest.mark.parametrize(("ip", "shape"), [("999.1.1.1", True), ("1.2.3", False), (None, False), ("1.2.3.4.5", False), ("a.b.c.d", False)])
def test_ip_shape(spark, ip, shape):
    assert spark.createDataFrame([(ip,)], "ip string").select(addresses.is_ipv4_shape(F.col("ip")).alias("x")).first().x is shape


def test_trust(spark):
    names = spark.createDataFrame([("1", "cdn.cloudflare.amazonaws.example"), ("2", "EDGE.GOOGLE.example"), ("3", "Host.example"), ("3", "Host.example")], "ip string, hostname string")
    df = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("",), (None,)], "source_ip string")
    got = {r.source_ip: (r.trust_score, r.domain) for r in with_trust(df, names).collect()}
    assert got == {"1": (0.8, "amazonaws"), "2": (0.8, "google"), "3": (0.4, "Host.example"), "4": (0.1, "unknown"), "": (0.1, "unknown"), None: (0.1, "unknown")}


def test_safe_numbers(spark):
    df = spark.createDataFrame([(None, None), ("7", 3.9), ("12.5", -3.9), ("abc", 0.0)], "s string, d double")
    got = df.select(numbers.safe_int(F.col("s")), numbers.safe_float(F.col("s")), numbers.safe_int(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0), (7, 7.0, 3), (0, 12.5, -3), (0, 0.0, 0)]


def test_nested_ingest(spark):
    rows = [(1, ("a", "", 6), (1, 2), None, 9, None), (2, None, (1, 2), None, 9, None), (3, (None, "b", 17), None, (5, 6), 9, None), (4, ("c", "d", 1), None, None, 9, None)]
    got = {r.packet_id: (r.source_ip, r.destination_ip, r.src_port, r.dst_port) for r in ingest(flatten(spark.createDataFrame(rows, NESTED))).collect()}
    assert got == {1: ("a", "unknown", 1, 2), 3: ("unknown", "b", 5, 6), 4: ("c", "d", 0, 0)}


EVENTS = "t_us long, packet_id long, source_ip string, threat_level string, risk_score double, timestamp timestamp, alerts array<struct<type:string>>, observed_text string"


def events(spark, rows):
    return spark.createDataFrame([(t, i, ip, level, risk, None, alerts, text) for t, i, ip, level, risk, alerts, text in rows], EVENTS)


def test_top_ties_keep_arrival_and_hours_as_written(spark):
    df = events(spark, [(1, 1, "b", "HIGH", 1.0, [("X",)], "2024-01-01T23:30:00+05:00"), (2, 2, "a", "HIGH", 1.0, [(None,)], "2024-01-01T05:00:00"), (3, 3, "10.0.0.1", "HIGH", 1.0, [], "x"), (4, 4, "c", "LOW", 1.0, [], "2024-01-01"), (5, 5, "d", "CRITICAL", 1.0, [("X",)], "not a time")])
    assert [r.key for r in analytics.attackers(df, 2).collect()] == ["b", "a"]
    assert {r.key: r.n for r in analytics.attack_hours(df).collect()} == {"23": 1, "5": 1}
    assert {r.key: r.n for r in analytics.attack_types(df).collect()} == {"X": 2, "unknown": 1}
    report = {r.metric: r.key for r in analytics.trend_report(df).where("metric <> 'top_5_attackers'").collect()}
    assert report == {"unique_attackers": None, "top_attacker": "b", "most_common_attack": "X", "peak_attack_hour": "23"}
    assert analytics.trend_report(df.limit(0)).count() == 0
    assert [(r.metric, r.n) for r in analytics.trend_report(df.where("threat_level = 'LOW'")).collect()] == [("unique_attackers", 0)]


def test_profile_defaults(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 1L, 'a', 'HIGH', -5.0D, timestamp'2024-01-01'), (2L, 2L, 'a', 'LOW', -7.0D, NULL), (3L, 3L, '', 'LOW', 9.0D, NULL), (4L, 4L, 'b', NULL, NULL, NULL), (5L, 5L, 'b', 'HIGH', 3.0D, NULL) AS t(t_us, packet_id, source_ip, threat_level, risk_score, timestamp)")
    got = {r.source_ip: r for r in analytics.risk_profiles(df).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].max_risk == 0.0 and got["a"].latest_threat == "HIGH" and got["a"].avg_risk == -6.0
    assert got["b"].latest_threat == "LOW" and got["b"].max_risk == 3.0


def test_event_store(spark, tmp_path):
    path = str(tmp_path / "none")
    assert event_store.read_events(spark, path).count() == 0 == event_store.count_events(spark, path)


def test_training_checks(spark):
    with pytest.raises(ValueError, match="missing"):
        training.checked(spark.range(1))
    columns = "packet_count string, protocol string, src_port string, dst_port string"
    with pytest.raises(ValueError, match="no training rows"):
        training.clean_training(spark.createDataFrame([], columns))
    literal = [(3, 6, 22, 80), (10, 17, 53, 53), (25, 6, 443, 443), (40, 6, 80, 22), (55, 17, 53, 80), (80, 6, 22, 22), (120, 6, 80, 80), (160, 17, 53, 53), (220, 6, 443, 22), (300, 6, 80, 443)]
    df = training.clean_training(spark.createDataFrame([tuple(map(str, r)) for r in literal] + [("x", None, "1.5", "2")], columns))
    assert df.count() == 11 and tuple(df.where("src_port = 1.5").first()) == (0.0, 0.0, 1.5, 2.0)

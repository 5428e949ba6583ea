"""Totals of the risk profiles as a loop over the events in their order adds them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from packetrisk.functions.numbers import rounded
from packetrisk.operators.analytics import risk_profiles, risk_profiles_in_order
from packetrisk.plans.oracle import ORACLE
from packetrisk.plans.queries import QUERIES

SCHEMA = "packet_id long, t_us long, source_ip string, risk_score double, threat_level string, timestamp timestamp"


def events(spark):
    """Four sources over nine seconds, with equal times, null risks and rows without a time."""
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        t = rng.randrange(0, 9_000_000, 50_000)
        rows.append((i, t, rng.choice(["a", "a", "b", "c", None, ""]), None if i % 97 == 0 else rng.randrange(10_000) / 100.0, rng.choice(["LOW", "HIGH", None]), t if i % 5 else None))
    rows.append((4000, None, "a", 0.07, "LOW", None))
    rng.shuffle(rows)
    raw = spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "us long"))
    return rows, raw.select("*", F.timestamp_micros("us").alias("timestamp")).drop("us")


@pytest.mark.parametrize("parts, batch", [(1, "10000"), (7, "3")])
def test_sum_in_order(spark, parts, batch):
    rows, df = events(spark)
    want = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0])):
        if r[2]:
            n, total = want.get(r[2], (0, 0.0))
            want[r[2]] = (n + 1, total + (r[3] or 0.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.source_ip: r for r in risk_profiles_in_order(df.repartition(parts)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    exact = {r.source_ip: r for r in risk_profiles(df).collect()}
    assert {k: (r["count"], r.total_risk) for k, r in got.items()} == want
    assert any(exact[k].total_risk != r.total_risk for k, r in got.items())
    for k, r in got.items():
        same = ("count", "max_risk", "latest_threat", "last_seen", "first_seen")
        assert [r[c] for c in same] == [exact[k][c] for c in same] and r.avg_risk == r.total_risk / r["count"]


def test_no_events(spark):
    assert risk_profiles_in_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_its_sql_on_one_thread(spark):
    """At sf0.01 one mean lies exactly at half a digit: 131,671.10 / 2,000."""
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    for t in ("nation", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    columns = ["source_ip", "count", "total_risk", "max_risk", "avg_risk", "latest_threat", "last_seen"]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE['ip_risk_profile']})").fetchall()
    assert sorted(want) == sorted(map(tuple, QUERIES["ip_risk_profile"](spark, folder).select(*columns).collect()))


def test_rounding_of_doubles(spark):
    """DuckDB's round: 81.49 / 40 and 34.67 / 40 lie near a half."""
    values = [81.49 / 40, 34.67 / 40, 65.83555, -2.5, -0.00005, 0.0, 14.1, 1e12 + 0.25]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchall()[0][0] for v in values]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 4)).collect()
    assert [r[0] for r in got] == want

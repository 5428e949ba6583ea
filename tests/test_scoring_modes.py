"""The scoring job for busy sources and with the model inside; single scans; event store; coercions."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.functions.features import normalised_features
from packetrisk.functions.numbers import safe_number
from packetrisk.operators import analytics, isolation_forest, response
from packetrisk.operators.flows import by_source, flow_snapshots
from packetrisk.plans.score import activity, score_packets
from packetrisk.sources import event_store, mapping


def busy(spark):
    rng, rows, t = random.Random(3), [], 0
    for i in range(600):
        t += rng.choice([0, 1, 400_000, 3_000_000, 40_000_000 if i % 90 == 0 else 200_000])
        rows.append((i, t, rng.choice(["8.8.8.8"] * 9 + ["9.9.9.9", None]), f"10.0.0.{rng.randrange(4)}", 6, 1000, rng.randrange(5), 60, False))
    return spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string, destination_ip string, protocol int, src_port int, dst_port int, packet_length int, anomaly_detected boolean")


@pytest.mark.parametrize("bucket", [1, 7, 90])
def test_buckets_change_no_value(spark, bucket):
    packets = busy(spark)
    columns = ["packet_id", "packet_count", "unique_ports", "rate_10s", "rate_30s", "density_60s", "drift"]
    one, other = (sorted(map(tuple, activity(packets, bucket_s=b).select(*columns).collect())) for b in (None, bucket))
    assert one == other


def test_a_busy_source_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packets = busy(spark).where("source_ip = '8.8.8.8'")
        sizes = lambda b: sorted(n for n in (r["count"] for r in activity(packets, bucket_s=b).groupBy(F.spark_partition_id().alias("p")).count().collect()))
        whole, spread = sizes(None), sizes(7)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(whole) == 1 and len(spread) > 2 and spread[-1] < 0.6 * whole[0]


def test_forest_inside_the_scoring_job(spark, small):
    packets, rdns = mapping.packets(spark, small), mapping.rdns(spark, small)
    df = flow_snapshots(by_source(packets)).select("packet_id", *normalised_features())
    forest = isolation_forest.train_forest(df, "packet_id")
    want = {r.packet_id: r.is_anomaly for r in isolation_forest.score(df, forest).collect()}
    got = {r.packet_id: r.anomaly_detected for r in score_packets(packets, rdns, forest=forest).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)


def test_alerts_read_their_input_once(spark, small):
    scored = score_packets(mapping.packets(spark, small), mapping.rdns(spark, small))
    rows = response.alerts(scored)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") <= scored._jdf.queryExecution().optimizedPlan().toString().count("events.parquet") and "LeftSemi" not in plan
    assert all(r.message.startswith(f"Threat detected from {r.source_ip} with risk ") for r in rows.collect())


def test_threat_table_holds_its_rows(spark, small):
    table = analytics.threat_table(score_packets(mapping.packets(spark, small), mapping.rdns(spark, small)), mapping.rdns(spark, small), mapping.geo(spark, small))
    assert "Window" not in table._jdf.queryExecution().optimizedPlan().toString() and table.count() == 5


def test_event_store_clears_and_appends_again(spark, tmp_path):
    path = str(tmp_path / "events")
    assert event_store.count_events(spark, path) == 0
    rows = spark.createDataFrame([(1,), (2,)], "packet_id long")
    rows = rows.select("packet_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in event_store.read_events(spark, path).schema if f.name != "packet_id"))
    event_store.append_events(rows, path)
    assert event_store.clear_events(spark, path) == (2, 0)
    event_store.append_events(rows.limit(1), path)
    assert event_store.count_events(spark, path) == 1


def test_safe_number_keeps_numbers(spark):
    df = spark.createDataFrame([(3.9, "3.9", "7"), (None, "x", None)], "a double, b string, c string")
    assert [tuple(r) for r in df.select(*(safe_number(F.col(c)) for c in "abc")).collect()] == [(3.9, 0.0, 7.0), (0.0, 0.0, 0.0)]

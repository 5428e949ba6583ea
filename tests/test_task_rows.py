"""Equal times counted as RANGE frames do, and the scoring job with so many rows a task."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.operators.chunks import busy
from packetrisk.operators.trailing import range_counts, trailing_counts
from packetrisk.plans.score import activity
from tests.test_scoring_modes import busy as packets_of

COLUMNS = ["packet_id", "packet_count", "unique_ports", "rate_10s", "rate_30s", "density_60s", "drift", "session"]


@pytest.mark.parametrize("bucket", [None, 7, 60])
def test_equal_times_count_each_other(spark, bucket):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, 1_000_000 * rng.randrange(100), rng.choice("abc")) for i in range(300)], "packet_id long, t_us long, source_ip string")
    windows = {"w10": 10, "w60": 60}
    want = sorted(map(tuple, range_counts(df, windows).select("packet_id", "w10", "w60").collect()))
    assert sorted(map(tuple, trailing_counts(df, windows, bucket_s=bucket, peers=True).select("packet_id", "w10", "w60").collect())) == want


@pytest.mark.parametrize("task_rows", [20, 150, 599])
def test_task_rows_change_no_value(spark, task_rows):
    packets = packets_of(spark)
    one, other = (sorted(map(tuple, activity(packets, task_rows=n).select(*COLUMNS).collect())) for n in (None, task_rows))
    assert one == other and len(one) == 600


def test_a_task_gets_so_many_rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        packets = packets_of(spark)
        sizes = [r["count"] for r in activity(packets, task_rows=60).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 600 and max(sizes) <= 180


def test_bounds_of_busy_keys(spark):
    df = spark.createDataFrame([(i * 100_000, "a") for i in range(100)] + [(5, None)] * 30 + [(7, "b")], "t_us long, source_ip string")
    assert {r.key: r.bounds for r in busy(df, 40).collect()} == {"a": [4_000_000, 8_000_000]}

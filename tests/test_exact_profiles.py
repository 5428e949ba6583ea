"""Totals of the risk profiles do not depend on the order of the rows."""

import random

from pyspark.sql import functions as F

from packetrisk.operators.analytics import exact_sum, risk_profiles


def test_mean_at_half_a_digit(spark):
    """131,671.10 over 2,000 rows is 65.83555: a plain sum of doubles falls to one side of it or the other."""
    cents = [6583] * 1999 + [13167110 - 6583 * 1999]
    random.Random(4).shuffle(cents)
    rows = [(i, i, "8.8.8.8", c / 100.0, "LOW", None) for i, c in enumerate(cents)]
    df = spark.createDataFrame(rows, "packet_id long, t_us long, source_ip string, risk_score double, threat_level string, timestamp timestamp")
    for parts in (1, 7):
        row = risk_profiles(df.repartition(parts)).select("total_risk", F.round("avg_risk", 4).alias("avg")).first()
        assert (row.total_risk, row.avg) == (131671.1, 65.8356)


def test_values_without_a_decimal(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert df.agg(exact_sum(F.col("x"))).first()[0] == 0.3
    assert df.union(df.limit(1).select(F.lit(float("inf")))).agg(exact_sum(F.col("x"))).first()[0] == float("inf")

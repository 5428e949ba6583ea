"""The outlier threshold is one exact quantile at every size."""

import inspect

import pytest
from packetrisk.operators import isolation_forest
from pyspark.sql import functions as F


def test_threshold_is_exact_at_every_size(spark):
    df = spark.range(3_000).select((F.round(F.rand(3), 3) / 3 + F.when(F.col("id") % 2 == 0, F.rand(4) / 1e6).otherwise(0.0)).alias("x")).localCheckpoint()
    for p in (0.0, 0.05, 0.5, 0.95, 0.9712345, 1.0):
        want = df.agg(F.percentile("x", p)).first()[0]
        for most in (1, 7, 100_000):
            assert isolation_forest.quantile(df, "x", p, most) == pytest.approx(want, rel=1e-15, abs=0)
    assert "approx" not in inspect.getsource(isolation_forest.train_forest)

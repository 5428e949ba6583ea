"""The halving baseline of a busy source, in chunks of time, against the whole fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetrisk.operators.drift import halved, halving_drift

S = 1_000_000
COLUMNS = "packet_id long, t_us long, source_ip string, packet_count long, __entry string"


def rows(seed, many=1500):
    rng, out, t = random.Random(seed), [], -5 * S
    for i in range(many):
        t += rng.choice([0, 1, S, 400 * S if i % 200 == 0 else 2 * S])
        out.append((i, t, rng.choice(["a"] * 9 + ["b", "", None]), rng.choice([rng.randint(0, 10**6), None]), "x"))
    return [*out, (9000, None, "a", 5, "x"), (9001, 3, "only", 7, "x"), (9002, 3, "twice", 7, "x"), (9002, 3, "twice", 9, "x")]


def plain(data):
    base, out = {}, []
    for i, t, key, x, _ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        x = x or 0
        if not key:
            out.append((i, 0.0))
        else:
            out.append((i, abs(x - base.get(key, x))))
            base[key] = (base[key] + x) / 2 if key in base else float(x)
    return sorted(out)


@pytest.mark.parametrize("chunk_s", [None, 1, 60, 1000])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_the_whole_fold(spark, chunk_s, batch):
    data = rows(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(data, COLUMNS).drop("__entry").repartition(3)
        got = sorted(tuple(r) for r in halving_drift(df, chunk_s=chunk_s).select("packet_id", "ema_drift").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain(data)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-9, rel=1e-12)


def test_a_long_source_keeps_its_precision():
    x = np.random.default_rng(1).integers(0, 10**9, 100_000).astype(float)
    base, want = x[0], []
    for v in x:
        base = (base + v) / 2
        want.append(base)
    assert np.allclose(halved(x, np.zeros(len(x), int), np.full(len(x), x[0])), want, rtol=1e-14, atol=0)


def test_one_source_is_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("packet_id"), (F.col("id") * S).alias("t_us"), F.concat(F.lit("a"), F.col("id") * 0).alias("source_ip"), (F.col("id") % 100).alias("packet_count"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [sorted(r["n"] for r in halving_drift(df, chunk_s=c).groupBy(F.spark_partition_id()).agg(F.count("ema_drift").alias("n")).collect()) for c in (None, 50)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes[0]) == 1 and len(sizes[1]) > 2 and sizes[1][-1] < 0.6 * 4000


def test_empty(spark):
    for chunk_s in (None, 60):
        assert halving_drift(spark.createDataFrame([], COLUMNS).drop("__entry"), chunk_s=chunk_s).count() == 0

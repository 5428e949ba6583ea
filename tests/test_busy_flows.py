"""Flow counters of a busy flow in chunks of time against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.operators.flows import flow_snapshots

S = 1_000_000
COLUMNS = "packet_id long, t_us long, source_ip string, destination_ip string, dst_port int, session string, own int"


def rows(seed):
    rng, out, t = random.Random(seed), [], -100 * S
    for i in range(1200):
        t += rng.choice([0, 0, 1, S, 3 * S, 10 * S, 10 * S + 1, 60 * S if i % 150 == 0 else 2 * S])
        out.append((i, t, rng.choice(["a"] * 9 + ["b", None]), rng.choice(["x"] * 5 + [None, "y"]), rng.choice([0, 80, 443, rng.randrange(1, 400), None]), "s", 1))
    return [*out, (5000, None, "a", "x", 22, "s", 1), (5001, None, "c", "x", 22, "s", 1), (5002, 7, "c", "x", 22, "s", 1), (5002, 7, "c", "x", 22, "s", 1)]


def plain(data):
    flows, out = {}, []
    for i, t, src, dst, port, *_ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        flow = flows.setdefault((src, dst), [0, 0, set(), None])
        if flow[3] is not None and t - flow[3] > 10 * S:
            flow[:3] = [flow[0] + 1, 0, set()]
        flow[1] += 1
        flow[2] |= {port} if port else set()
        flow[3] = t
        out.append((i, flow[0], flow[1], len(flow[2])))
    return sorted(out)


def got(df, chunk_s):
    return sorted(tuple(r) for r in flow_snapshots(df.drop("session", "own"), chunk_s=chunk_s).select("packet_id", "session", "packet_count", "unique_ports").collect())


@pytest.mark.parametrize("chunk_s", [None, 1, 7, 90, 100_000])
def test_same_as_the_plain_loop(spark, chunk_s):
    for seed in (1, 2):
        data = rows(seed)
        assert got(spark.createDataFrame(data, COLUMNS).repartition(3), chunk_s) == plain(data)


def test_empty(spark):
    assert got(spark.createDataFrame([], COLUMNS), 90) == []


def test_one_flow_is_spread(spark):
    """A flood is one source and one destination, in one session without an end."""
    df = spark.range(4000).select(F.col("id").alias("packet_id"), (F.col("id") * S).alias("t_us"), F.concat(F.lit("a"), F.col("id") * 0).alias("source_ip"), F.lit("x").alias("destination_ip"), (F.col("id") % 700 + 1).cast("int").alias("dst_port"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [sorted(r["count"] for r in flow_snapshots(df, chunk_s=c).groupBy(F.spark_partition_id()).agg(F.count("packet_count").alias("count"), F.max("packet_count")).collect()) for c in (None, 50)]
        assert len(sizes[0]) == 1 and len(sizes[1]) > 2 and sizes[1][-1] < 0.6 * 4000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last = flow_snapshots(df, chunk_s=50).orderBy(F.desc("packet_id")).first()
    assert (last.session, last.packet_count, last.unique_ports) == (0, 4000, 700)

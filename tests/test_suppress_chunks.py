"""Suppression against a plain loop, whole keys and keys in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from packetrisk.operators.suppress import suppress

COLUMNS = "packet_id long, t_us long, source_ip string, emitted int"
S = 1_000_000


def rows(seed):
    rng, out, t = random.Random(seed), [], -50 * S
    for i in range(1500):
        t += rng.choice([0, 0, 1, S // 3, S, 5 * S, 11 * S if seed % 2 else S, 200 * S if i % 300 == 0 else 0])
        out.append((i, None if i % 97 == 0 else t, rng.choice(["a"] * 8 + ["b", None]), 7))
    out += [(2000 + i, i * 10 * S, "steady", 7) for i in range(200)]
    return out


def plain(data, hold, inclusive):
    last, out = {}, {}
    for i, t, k, _ in sorted((r for r in data if r[1] is not None), key=lambda r: (r[1], r[0])):
        gap = None if k not in last else t - last[k]
        out[i] = gap is None or (gap >= hold if inclusive else gap > hold)
        if out[i]:
            last[k] = t
    return {r[0]: out.get(r[0], False) for r in data}


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("chunk_holds", [None, 1, 3, 16])
def test_flags(spark, inclusive, chunk_holds):
    for seed in (1, 2):
        data = rows(seed)
        df = spark.createDataFrame(data, COLUMNS).drop("emitted").repartition(5)
        got = suppress(df, 30, inclusive, chunk_holds=chunk_holds).collect()
        assert len(got) == len(data)
        assert {r.packet_id: r.emitted for r in got} == plain(data, 30 * S, inclusive)


def test_small_batches_and_empty(spark):
    data = rows(3)
    df = spark.createDataFrame(data, COLUMNS).drop("emitted")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for chunk_holds in (None, 2):
            assert {r.packet_id: r.emitted for r in suppress(df, 30, True, chunk_holds=chunk_holds).collect()} == plain(data, 30 * S, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert suppress(df.limit(0), 30, True, chunk_holds=2).count() == 0


def test_a_busy_key_is_spread(spark):
    df = spark.range(4000).select(F.col("id").alias("packet_id"), (F.col("id") * S).alias("t_us"), F.lit("a").alias("source_ip"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [sorted(r["count"] for r in suppress(df, 30, True, chunk_holds=c).groupBy(F.spark_partition_id()).count().collect()) for c in (None, 1)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes[0]) == 1 and len(sizes[1]) > 2 and sizes[1][-1] < 0.6 * 4000


@pytest.mark.parametrize("inclusive", [True, False])
def test_ways_part_by_part(inclusive):
    """The ways through a chunk are those of all its times at once, however they come, and few are held."""
    import numpy as np

    from packetrisk.operators.suppress import _Ways, emitted

    rng = np.random.default_rng(4)
    for _ in range(60):
        hold, begin = int(rng.integers(1, 40)), 1000
        times = np.sort(rng.integers(begin, begin + 8 * hold, int(rng.integers(1, 120))))
        whole, parts = _Ways(begin, hold, inclusive), _Ways(begin, hold, inclusive)
        whole.add(times)
        for part in np.split(times, np.sort(rng.integers(0, len(times), 5))):
            if len(part):
                parts.add(part)
        assert whole.starts.tolist() == parts.starts.tolist() and whole.ends.tolist() == parts.ends.tolist() and len(parts.starts) <= hold + 2
        for last in range(begin - hold - 2, begin):
            flags = emitted(times, hold, inclusive, last)
            at = int(np.searchsorted(parts.starts, last + hold, side="left" if inclusive else "right"))
            assert (parts.ends[at] if at < len(parts.ends) else last) == (times[flags][-1] if flags.any() else last)

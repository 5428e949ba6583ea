"""The last chunk of a busy key gets its own rows' markers, not those of all windows that end after it; rows are spread before they are multiplied."""

from pyspark.sql import functions as F

from packetrisk.operators import chunks
from packetrisk.operators.chunks import busy, thinned
from packetrisk.operators.trailing import range_counts, trailing_counts

WINDOWS = {"w10": 10, "w60": 60}


def _rows(spark):
    return spark.range(2000).select(F.col("id").alias("packet_id"), (F.floor(F.col("id") / 2) * 100_000).alias("t_us"), F.when(F.col("id") % 10 < 9, "a").alias("source_ip"))


def _in_chunks(spark, **more):
    df = _rows(spark)
    bounds = busy(df, 100)
    rows = df.join(F.broadcast(bounds), F.col("source_ip").eqNullSafe(F.col("key"))).drop("key")
    return trailing_counts(rows, WINDOWS, peers=True, bounds="bounds", end="end", **more)


def test_counts_are_those_of_range_frames(spark, monkeypatch):
    want = sorted(map(tuple, range_counts(_rows(spark), WINDOWS).select("packet_id", *WINDOWS).collect()))
    monkeypatch.setattr(chunks, "UNSORTED", 3)
    for parts in (2, 5):  # as they are read, and thinned
        got = sorted(map(tuple, _in_chunks(spark, parts=parts).select("packet_id", *WINDOWS).collect()))
        assert got == want and len(got) == 2000


def test_no_marker_after_the_last_row(spark):
    bounds = {r.key: r.end for r in busy(_rows(spark), 100).collect()}
    assert bounds == {"a": 100_000_000, None: 100_000_000}


def test_thinned_only_where_the_next_exchange_holds_its_rows(spark):
    one = _rows(spark).coalesce(1)
    assert thinned(one, 200, "packet_id").rdd.getNumPartitions() == 1
    assert thinned(one, 201, "packet_id").rdd.getNumPartitions() == 200

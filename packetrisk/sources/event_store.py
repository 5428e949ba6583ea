"""The event store: a Parquet table partitioned by date and by append."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = (
    "packet_id long, timestamp timestamp, source_ip string, destination_ip string, protocol int, src_port int, dst_port int, packet_count long, signature_score int, "
    "matched_rules array<string>, anomaly_detected boolean, risk_score double, threat_level string, packet_rate long, behavioral_drift double, trust_score double, response_action string"
)


#: Files of a date that one micro-batch writes at most.
BATCH_FILES = 4


def _write(events: DataFrame, path: str, batch: str, mode: str) -> None:
    """Files by date and by the append that brought them."""
    rows = events.withColumns({"event_date": F.to_date("timestamp"), "batch": F.lit(batch)})
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    _write(events, path, f"append-{uuid.uuid4().hex}", "append")


def batch_sink(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append each micro-batch exactly once.

    A batch's files lie under its number (and the stream's name), and a batch that runs again, after a failure or a restart from the stream's
    checkpoint, replaces its own files only.
    """

    def write(batch: DataFrame, number: int) -> None:
        dealt = batch.repartition(F.to_date("timestamp"), F.pmod(F.xxhash64("packet_id"), F.lit(BATCH_FILES)))
        _write(dealt, path, f"{stream}-{number}", "overwrite")

    return write


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All events; an empty table where there is no store. Order by (timestamp, packet_id) for insertion order."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path)


def count_events(spark: SparkSession, path: str) -> int:
    return read_events(spark, path).count()


def clear_events(spark: SparkSession, path: str) -> tuple[int, int]:
    """Delete all events; the numbers before and after."""
    before = count_events(spark, path)
    spark.createDataFrame([], STORED).write.mode("overwrite").parquet(path)
    return before, count_events(spark, path)

"""Streaming queries driven to completion over packets replayed as files."""

from __future__ import annotations

import math
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.operators import analytics, events
from packetrisk.sources import event_store, mapping, messages
from packetrisk.streaming import live
from packetrisk.streaming.hitters import top_hitters
from packetrisk.streaming.shards import SHARDS
from packetrisk.streaming.tables import KeptTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = 10**15
#: Rows of a file of replayed packets, of which a micro-batch reads two, and bytes of stored rows that one reads.
FILE_ROWS, BATCH_BYTES = 250_000, 64 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, or a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base}/stream-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store while a stream is started and run, in a part for each core at most: every part costs about a second of a core in every batch."""
    parts = "spark.sql.shuffle.partitions"
    values = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, parts: str(min(int(spark.conf.get(parts)), max(4, spark.sparkContext.defaultParallelism)))}
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def replay(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Write the packets as files in time order and read them as a stream."""
    return _replayed(mapping.packets(spark, sf_dir).select(*live.ACTIVITY_IN), folder)


def _replayed(rows: DataFrame, folder: str, least: int = 4) -> DataFrame:
    """``rows`` as ``least`` files or as many as they need, in time order, with a far-off packet of its own source that moves the watermark past all others, as a stream."""
    last = rows.limit(1).select(
        F.lit(-1).cast("long").alias("packet_id"), F.lit(FAR).cast("long").alias("t_us"), F.timestamp_micros(F.lit(mapping.EPOCH_US + FAR)).alias("timestamp"), F.lit("sentinel").alias("source_ip"), F.lit("sentinel").alias("destination_ip"),
        *(F.lit(0).alias(c) for c in ("protocol", "src_port", "dst_port", "packet_length")), F.lit(False).alias("anomaly_detected"),
    )
    files = max(least, math.ceil(rows.count() / FILE_ROWS))
    rows.repartitionByRange(files, "t_us").sortWithinPartitions("t_us").write.parquet(f"{folder}/in")
    first = _parts(rows.sparkSession, f"{folder}/in")
    last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _in_turn(rows.sparkSession, [*first, *(x for x in _parts(rows.sparkSession, f"{folder}/in") if x not in first)])
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a written folder by name, which is the order of the tasks that wrote them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().toString() for x in found if x.getPath().getName().startswith("part-"))


def _in_turn(spark: SparkSession, files: list[str]) -> None:
    """Give files times of change a second apart, in the order given: a stream reads files by these times, and tasks end in any order.

    A file that comes after a later one would lie behind the watermark.
    """
    begin = int(time.time() * 1000) - 1000 * len(files)
    for at, name in enumerate(files):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.setTimes(path, begin + 1000 * at, -1)
        if system.getFileStatus(path).getModificationTime() // 1000 != (begin + 1000 * at) // 1000:
            raise OSError(f"cannot set the time of {name}, by which a stream would read it in its turn")


def drain(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Run a stream to the end of its input into a Parquet sink and read the sink."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def _live_scores(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Live scores of the replayed packets. The host names are stored first: every micro-batch reads them, and would derive them from all packets again."""
    names = mapping.rdns(spark, sf_dir)
    names.write.parquet(f"{folder}/rdns")
    return live.live_scores(replay(spark, sf_dir, folder), spark.read.schema(names.schema).parquet(f"{folder}/rdns"), shards=SHARDS)


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    out = drain(_live_scores(spark, sf_dir, folder), folder, "scores")
    return out.where("source_ip <> 'sentinel'")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the packets, in one streaming query: activity, scores and cooldown."""
    folder = work_folder(spark)
    scores = _live_scores(spark, sf_dir, folder)
    return drain(live.alerts_of_scores(scores), folder, "alerts").where("source_ip <> 'sentinel'")


def stream_stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of stored scores, read as a stream in any order."""
    folder = work_folder(spark)
    scores = drain(_live_scores(spark, sf_dir, folder), folder, "scores")
    far = scores.limit(1).withColumns({"source_ip": F.lit("sentinel"), "threat_level": F.lit("CRITICAL"), "timestamp": F.timestamp_micros(F.lit(mapping.EPOCH_US + FAR)), "t_us": F.lit(FAR).cast("long")})
    scores.write.parquet(f"{folder}/scored")
    far.select(*scores.columns).write.mode("append").parquet(f"{folder}/scored")
    out = drain(live.live_alerts(spark.readStream.schema(scores.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{folder}/scored")), folder, "alerts")
    return out.where("source_ip <> 'sentinel'")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    return drain(live.live_sessions(replay(spark, sf_dir, folder)), folder, "sessions").where("source_ip <> 'sentinel'")


def kept_table(changes: DataFrame, folder: str, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream of changed rows to its end into a ``KeptTable`` and read the table."""
    spark = changes.sparkSession
    table = KeptTable(spark, f"{folder}/table", changes.schema, key, order)
    with state_store(spark):
        started = changes.writeStream.outputMode("update").foreachBatch(table.update)
        started.option("checkpointLocation", f"{folder}/table-state").trigger(availableNow=True).start().awaitTermination()
    return table.read()


def _scores_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream over the sink of live scores. Micro-batches are cut by bytes: the sink has many small files, one for each task of a batch."""
    scores = drain(_live_scores(spark, sf_dir, folder), folder, "scores")
    return spark.readStream.schema(scores.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{folder}/scores").where("source_ip <> 'sentinel'")


def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend table of live scores, kept by a stream."""
    folder = work_folder(spark)
    return kept_table(live.live_trends(_scores_stream(spark, sf_dir, folder)), folder, "source_ip")


def stream_attackers(spark: SparkSession, sf_dir: str, levels: list[str]) -> DataFrame:
    """The top attackers of live scores, by counters kept by a stream; counted from the stored scores where the keys outgrew the counters."""
    folder = work_folder(spark)
    scores = _scores_stream(spark, sf_dir, folder)
    counters = kept_table(live.live_attackers(scores, levels), folder, "slot")
    if counters.where("others > 0").isEmpty():
        return top_hitters(counters, 5)
    return analytics.attackers(spark.read.schema(scores.schema).parquet(f"{folder}/scores").where("source_ip <> 'sentinel'"), 5, levels)


def _ledger_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The live ledger of the packets of a high value; the far-off packet's source is refused."""
    rows = mapping.packets(spark, sf_dir).where("value > 100").select(*live.ACTIVITY_IN)
    return drain(live.live_blocks(_replayed(rows, folder), shards=SHARDS), folder, "ledger").where("source_ip <> 'sentinel' or source_ip is null")


def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, refusals and releases of a stream of candidates."""
    return _ledger_stream(spark, sf_dir, work_folder(spark))


def stream_block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's last block and whether it has been released, kept by a stream over the live ledger."""
    folder = work_folder(spark)
    ledger = _ledger_stream(spark, sf_dir, folder)
    source = spark.readStream.schema(ledger.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{folder}/ledger")
    return kept_table(live.live_block_table(source), folder, "source_ip", ("t_us",))


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and bad records of a stream of messages, parted in one pass: (packet_id, source_ip, dst_port, reason)."""
    folder = work_folder(spark)
    rows = mapping.messages(spark, sf_dir)
    rows.repartition(6).write.parquet(f"{folder}/messages")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/messages")
    sink = messages.judged(source).writeStream.foreachBatch(messages.parted_sink(f"{folder}/packets", f"{folder}/rejected")).option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    bad = spark.read.parquet(f"{folder}/rejected")
    bad = bad.select(F.col("key").cast("long").alias("packet_id"), F.lit(None).cast("string").alias("source_ip"), F.lit(None).cast("int").alias("dst_port"), "reason")
    return spark.read.parquet(f"{folder}/packets").select("packet_id", "source_ip", "dst_port", F.lit(None).cast("string").alias("reason")).unionByName(bad)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event store as a stream of live scores fills it."""
    folder = work_folder(spark)
    rows = events.stored_events(_scores_stream(spark, sf_dir, folder))
    with state_store(spark):
        sink = rows.writeStream.foreachBatch(event_store.batch_sink(f"{folder}/events", "scores")).option("checkpointLocation", f"{folder}/events-state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return event_store.read_events(spark, f"{folder}/events")

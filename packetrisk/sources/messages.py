"""Packets as JSON records of a message source: the good ones as packets, the bad ones put aside with a reason.

A message has a ``key`` and a ``value``, text or binary, as Spark's message sources give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.functions.numbers import ip_or_unknown

NUMBERS = ("protocol", "src_port", "dst_port", "packet_length")


def read_messages(spark: SparkSession, form: str, stream: bool = False, **options: str) -> DataFrame:
    """(key, value) of a source of messages (``form``, such as kafka, with its options); of a source of lines the key is null."""
    rows = (spark.readStream if stream else spark.read).format(form).options(**options).load()
    return rows.select(*(F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("key", "value")))


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("__json", f"$[0].{name}", kind)


def judged(messages: DataFrame) -> DataFrame:
    """Each message's key and text, its packet fields, and ``reason``: why it is no packet, or null.

    Reasons, the first that holds: ``no text``, ``not JSON``, ``not an object``, ``no IP layer`` (neither addresses nor a protocol), ``no time`` (no
    timestamp, or one that cannot be read).  Numbers may be written as text; what is not one becomes 0, as do missing ones.  A missing or
    empty address is 'unknown'.  A missing packet_id is null.  Fields beside these are ignored.
    """
    rows = messages.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("text"))
    # in brackets nothing can follow the record unseen
    rows = rows.withColumn("__json", F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))))
    source, target, time = _field("src_ip", "string"), _field("dst_ip", "string"), F.try_to_timestamp(_field("timestamp", "string"))
    record, more = (F.try_variant_get("__json", f"$[{i}]", "variant") for i in (0, 1))
    reason = (
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text").when(F.col("__json").isNull() | more.isNotNull(), "not JSON").when(~F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)), "not an object")
        .when(source.isNull() & target.isNull() & _field("protocol", "string").isNull(), "no IP layer").when(time.isNull(), "no time")
    )
    fields = [ip_or_unknown(source).alias("source_ip"), ip_or_unknown(target).alias("destination_ip"), *(F.coalesce(_field(c, "int"), F.lit(0)).alias(c) for c in NUMBERS)]
    return rows.select("key", "text", reason.alias("reason"), _field("packet_id", "long").alias("packet_id"), *fields, time.alias("timestamp"), F.unix_micros(time).alias("t_us"))


def packets_of(rows: DataFrame) -> DataFrame:
    """The packets among judged messages, in the form that ``ingest`` gives."""
    return rows.where("reason is null").drop("key", "text", "reason")


def rejected_of(rows: DataFrame) -> DataFrame:
    """(key, text, reason) of the judged messages that are no packets."""
    return rows.where("reason is not null").select("key", "text", "reason")


def parted_sink(packets: str, rejected: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over judged messages: each micro-batch's packets and bad records to two folders, read once.

    Folders by batch number: a batch that runs again replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            packets_of(batch).write.mode("overwrite").parquet(f"{packets}/batch={number}")
            rejected_of(batch).write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        finally:
            batch.unpersist()

    return write

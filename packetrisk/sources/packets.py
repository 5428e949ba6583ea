"""Packet records: schemas, ingest of flat and nested input, batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.functions.numbers import ip_or_unknown, safe_int

FLAT = "packet_id long, src_ip string, dst_ip string, protocol int, src_port int, dst_port int, packet_length int, timestamp timestamp"
NESTED = "packet_id long, ip struct<src:string,dst:string,proto:int>, tcp struct<sport:int,dport:int>, udp struct<sport:int,dport:int>, length int, timestamp timestamp"


def read_packets(spark: SparkSession, path: str, form: str = "parquet", schema: str = FLAT) -> DataFrame:
    return spark.read.schema(schema).format(form).load(path)


def stream_packets(spark: SparkSession, path: str, form: str = "parquet", schema: str = FLAT, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def layer_ports(tcp: str = "tcp", udp: str = "udp") -> tuple[Column, Column]:
    """Ports of the TCP layer, else of the UDP layer, else 0."""
    return tuple(F.coalesce(F.col(f"{tcp}.{p}"), F.col(f"{udp}.{p}"), F.lit(0)) for p in ("sport", "dport"))


def flatten(nested: DataFrame) -> DataFrame:
    """Nested layers to flat packets; rows without an IP layer are dropped."""
    source, target = layer_ports()
    return nested.where(F.col("ip").isNotNull()).select(
        "packet_id", F.col("ip.src").alias("src_ip"), F.col("ip.dst").alias("dst_ip"), F.col("ip.proto").alias("protocol"), source.alias("src_port"), target.alias("dst_port"),
        F.col("length").alias("packet_length"), "timestamp", *(c for c in nested.columns if c not in ("packet_id", "ip", "tcp", "udp", "length", "timestamp")),
    )


def ingest(packets: DataFrame) -> DataFrame:
    """Rows with an IP layer, numbers and addresses made safe, ``t_us`` added. Other columns pass through."""
    has_ip = F.col("src_ip").isNotNull() | F.col("dst_ip").isNotNull() | F.col("protocol").isNotNull()
    named = ("src_ip", "dst_ip", "protocol", "src_port", "dst_port", "packet_length")
    return packets.where(has_ip).select(
        ip_or_unknown(F.col("src_ip")).alias("source_ip"), ip_or_unknown(F.col("dst_ip")).alias("destination_ip"),
        *(safe_int(F.col(c)).alias(c) for c in named[2:]), F.unix_micros("timestamp").alias("t_us"),
        *(c for c in packets.columns if c not in (*named, "t_us")),
    )

"""Packets, host names and locations derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetrisk.sources.packets import ingest

EPOCH_US = 1704067200000000


def mapped_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw packet per event; the time axis is compressed ten-thousand-fold."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    host = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    octet = uid % 250
    src = (
        F.when(eid % 5 == 0, "203.0.113.7").when(eid % 20 == 1, "142.250.0.9").when(uid % 10 == 0, host("10.0.0.", octet)).when(uid % 10 == 1, host("192.168.1.", octet))
        .when(uid % 10 == 2, host("172.217.3.", octet)).when(eid % 97 == 3, F.lit(None))
        .otherwise(F.concat(F.lit("45.33."), F.floor(uid / 250).cast("string"), F.lit("."), octet.cast("string")))
    )
    dst = host("100.64.0.", F.when(eid % 50 == 0, 2).when(eid % 5 == 0, 1).otherwise(uid % 3))
    ports = F.when(k % 5 == 0, 80).when(k % 5 == 1, 443).when(k % 5 == 2, 22).when(k % 5 == 3, 53).otherwise(8000 + k)
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 10000).cast("long")
    return e.select(
        eid.alias("packet_id"), src.alias("src_ip"), dst.alias("dst_ip"), F.when(kind == "error", 17).when(kind == "signup", 1).otherwise(6).alias("protocol"),
        F.when(kind == "signup", 0).otherwise(1024 + eid % 50000).cast("int").alias("src_port"),
        F.when(kind == "signup", 0).when(eid % 5 == 0, 1 + 10 * k).otherwise(ports).alias("dst_port"), (40 + F.floor("value")).cast("int").alias("packet_length"),
        F.timestamp_micros(t + EPOCH_US).alias("timestamp"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("value") > 150).alias("anomaly_detected"), "value",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingested packets; ``t_us`` counts from the start of the axis."""
    return ingest(mapped_packets(spark, sf_dir)).withColumn("t_us", F.col("t_us") - EPOCH_US)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as JSON texts of a message source, some of them broken: (key, value)."""
    p = packets(spark, sf_dir)
    number = lambda c: F.when(F.col("packet_id") % 7 == 0, F.concat(F.lit('"'), F.col(c), F.lit('"'))).otherwise(F.col(c).cast("string"))
    address = F.when(F.col("packet_id") % 23 == 0, F.lit("")).otherwise(F.concat(F.lit('"src_ip": "'), "source_ip", F.lit('", "dst_ip": "'), "destination_ip", F.lit('", "protocol": '), number("protocol"), F.lit(", ")))
    time = F.when(F.col("packet_id") % 29 == 0, F.lit("soon")).otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    text = F.concat(F.lit('{"packet_id": '), "packet_id", F.lit(", "), address, F.lit('"src_port": '), number("src_port"), F.lit(', "dst_port": '), number("dst_port"), F.lit(', "packet_length": '), "packet_length", F.lit(', "timestamp": "'), time, F.lit('"}'))
    broken = F.when(F.col("packet_id") % 17 == 0, F.substring(text, 1, 20)).when(F.col("packet_id") % 19 == 0, F.lit("[1, 2]")).when(F.col("packet_id") % 31 == 0, F.lit(None))
    whole = (F.col("packet_id") % 17 != 0) & (F.col("packet_id") % 19 != 0) & (F.col("packet_id") % 31 != 0)
    return p.select(F.col("packet_id").cast("string").alias("key"), F.when(whole, text).otherwise(broken).alias("value"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.col("src_ip")
    return mapped_packets(spark, sf_dir).where(ip.isNotNull()).select(ip.alias("ip")).distinct().withColumn("o", F.element_at(F.split("ip", r"\."), 4).cast("int"))


def rdns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip, hostname)."""
    isp = F.col("ip").startswith("45.33.")
    name = (
        F.when(F.col("ip") == "142.250.0.9", "edge-9.GOOGLE.example").when(isp & (F.col("o") % 50 == 3), "cdn.cloudflare.amazonaws.example")
        .when(isp & (F.col("o") % 7 != 0), F.concat(F.lit("host-"), F.col("o").cast("string"), F.lit(".isp.example")))
    )
    return _sources(spark, sf_dir).select("ip", name.alias("hostname")).where("hostname is not null")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ip, lat, lon, country)."""
    nation = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"))  # 25 rows by definition
    at = _sources(spark, sf_dir).where("ip <> '203.0.113.7'").join(nation, F.col("o") % 25 == F.col("n_nationkey"))
    key = F.col("n_nationkey")
    return at.select("ip", (3 * key - 36).cast("double").alias("lat"), (10 * key - 120).cast("double").alias("lon"), F.col("n_name").alias("country"))

"""Event projections of scored packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetrisk.functions.numbers import ip_or_unknown


def _or(name: str, default) -> object:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def stored_events(scored: DataFrame) -> DataFrame:
    """The stored form: 16 fields with defaults (and the order key packet_id)."""
    return scored.select(
        "packet_id", "timestamp", ip_or_unknown(F.col("source_ip")).alias("source_ip"), ip_or_unknown(F.col("destination_ip")).alias("destination_ip"), _or("protocol", 0), _or("src_port", 0), _or("dst_port", 0),
        F.coalesce("packet_count", F.lit(0).cast("long")).alias("packet_count"), _or("signature_score", 0), F.coalesce("matched_rules", F.array().cast("array<string>")).alias("matched_rules"), _or("anomaly_detected", False),
        _or("risk_score", 0.0), _or("threat_level", "LOW"), F.coalesce("packet_rate", F.lit(0).cast("long")).alias("packet_rate"), _or("behavioral_drift", 0.0), _or("trust_score", 0.0), _or("response_action", "Monitored"),
    )


def wide_events(scored: DataFrame) -> DataFrame:
    """The alternative form: 13 fields with alerts, unique ports and density."""
    empty = F.array().cast("array<struct<type:string,source_ip:string,description:string>>")
    return scored.select(
        "packet_id", "timestamp", ip_or_unknown(F.col("source_ip")).alias("source_ip"), F.coalesce("packet_count", F.lit(0).cast("long")).alias("packet_count"), F.coalesce("unique_ports", F.lit(0).cast("long")).alias("unique_ports"),
        _or("protocol", 0), _or("signature_score", 0), _or("anomaly_detected", False), _or("risk_score", 0.0), _or("threat_level", "LOW"), F.coalesce("temporal_attack_density", F.lit(0).cast("long")).alias("temporal_attack_density"),
        _or("behavioral_drift", 0.0), F.coalesce("alerts", empty).alias("alerts"), _or("response_action", "None"),
    )

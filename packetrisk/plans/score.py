"""The scoring job: packets to scored rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetrisk.config import DEFAULTS, RiskConfig
from packetrisk.functions.addresses import is_local_source
from packetrisk.functions.features import normalised_features
from packetrisk.functions.numbers import cents
from packetrisk.functions.scores import damped, matched_rules, rule_score, signal_strength, signature_alerts, signature_score, threat_level, weighted_risk
from packetrisk.operators.drift import behavioral_drift
from packetrisk.operators import isolation_forest
from packetrisk.operators.chunks import busy, chunk_of
from packetrisk.operators.flows import FLOW, by_source, flow_snapshots
from packetrisk.operators.isolation_forest import Forest
from packetrisk.operators.trailing import trailing_counts
from packetrisk.operators.trust import with_trust


def activity(packets: DataFrame, config: RiskConfig = DEFAULTS, bucket_s: int | None = None, task_rows: int | None = None) -> DataFrame:
    """Packets with flow counters, trailing counts and drift. One exchange, on the source.

    With ``bucket_s``, for sources and flows too busy for one task, flows are counted in chunks of that length, and drift
    and trailing counts on (source, time bucket) with copied context: the same values, no task with a whole source or flow.
    With ``task_rows`` rows are counted first, and a task gets about so many of them: sources with more than half of that are cut into
    chunks of equal size, all others stay whole.
    """
    if task_rows and (total := packets.count()) > task_rows:
        return _spread(packets, config, task_rows, total)
    return _limited(_whole(packets, config) if not bucket_s else _bucketed(packets, config, bucket_s), config)


def _windows(config: RiskConfig) -> dict[str, int]:
    return {"rate_10s": config.rate_limit_window_s, "rate_30s": config.packet_rate_window_s, "density_60s": config.density_window_s}


def _whole(packets: DataFrame, config: RiskConfig, parts: int | None = None) -> DataFrame:
    return behavioral_drift(trailing_counts(flow_snapshots(by_source(packets, parts), config), _windows(config), peers=True), config)


def _bucketed(packets: DataFrame, config: RiskConfig, bucket_s: int) -> DataFrame:
    df = behavioral_drift(flow_snapshots(packets, config, chunk_s=bucket_s), config, bucket_s=bucket_s)
    return trailing_counts(df, _windows(config), bucket_s=bucket_s, peers=True)


def _spread(packets: DataFrame, config: RiskConfig, task_rows: int, total: int) -> DataFrame:
    """Quiet sources whole, busy ones in chunks; ``task_rows`` rows a task."""
    parts = max(math.ceil(total / task_rows), packets.sparkSession.sparkContext.defaultParallelism)
    bounds = F.broadcast(busy(packets, task_rows // 2))  # one entry for each chunk
    same = F.col("source_ip").eqNullSafe(F.col("key"))
    quiet = _whole(packets.join(bounds, same, "left_anti"), config, parts)
    rows = packets.join(bounds, same).drop("key")
    parts = 4 * parts  # few large chunks meet in a task
    counted = trailing_counts(rows, _windows(config), peers=True, bounds="bounds", parts=parts, end="end")
    light = rows.select("t_us", "packet_id", "dst_port", *FLOW, chunk_of(F.col("bounds"), F.col("t_us")).alias("__c"))
    df = behavioral_drift(flow_snapshots(counted, config, chunked=light, parts=parts), config, chunk="__c", parts=parts)
    return _limited(quiet.unionByName(df), config)


def _limited(df: DataFrame, config: RiskConfig) -> DataFrame:
    return df.withColumn("rate_limited", F.col("rate_10s") > config.rate_limit_packets)


def flagged(df: DataFrame, forest: Forest | None) -> DataFrame:
    """``df`` with ``anomaly_detected`` from the isolation forest; unchanged without one."""
    if forest is None:
        return df
    judged = isolation_forest.score(df, forest, normalised_features())
    return judged.withColumn("anomaly_detected", F.col("is_anomaly")).drop("anomaly_score", "decision", "is_anomaly")


def detect(df: DataFrame, config: RiskConfig = DEFAULTS) -> DataFrame:
    """Signature score and alerts, rule names and score."""
    rate = F.col("rate_30s") if config.wire_packet_rate else F.lit(0).cast("long")
    df = df.withColumn("packet_rate", rate)
    return df.withColumns({"signature_score": signature_score(config), "alerts": signature_alerts(config), "matched_rules": matched_rules(), "rule_score": rule_score()})


def assess(df: DataFrame, config: RiskConfig = DEFAULTS) -> DataFrame:
    """Risk (to two decimals), level and action (both by the unrounded risk); local sources are ignored."""
    local = is_local_source(F.col("source_ip"))
    df = df.withColumns({"base_risk": weighted_risk(config), "signal_strength": signal_strength(), "is_local": local})
    df = df.withColumn("__risk", damped(F.col("base_risk"), F.col("signal_strength"), F.col("trust_score")))
    act = F.when((F.col("__risk") >= 90) & (F.col("signal_strength") >= 3), F.concat(F.lit("Would Block (Simulation): "), "source_ip")).otherwise("Monitored")
    quiet = lambda other, own: F.when(F.col("is_local"), other).otherwise(own)
    out = df.withColumns({
        "domain": quiet(F.lit("local"), F.col("domain")), "trust_score": quiet(F.lit(1.0), F.col("trust_score")), "risk_score": quiet(F.lit(0.0), cents(F.col("__risk"))),
        "packet_rate": quiet(F.lit(0).cast("long"), F.col("rate_30s")), "temporal_attack_density": quiet(F.lit(0).cast("long"), F.col("density_60s")), "behavioral_drift": quiet(F.lit(0.0), F.col("drift")),
        "response_action": quiet(F.lit("Ignored (Local Traffic)"), act),
    })
    return out.withColumn("threat_level", quiet(F.lit("LOW"), threat_level(F.col("__risk")))).drop("__risk")


def score_packets(packets: DataFrame, rdns: DataFrame, config: RiskConfig = DEFAULTS, bucket_s: int | None = None, forest: Forest | None = None, task_rows: int | None = None) -> DataFrame:
    """Packets to scored rows; the anomaly flag is a column of the packets, or that of ``forest`` where one is given."""
    return assess(with_trust(detect(flagged(activity(packets, config, bucket_s, task_rows), forest), config), rdns), config)

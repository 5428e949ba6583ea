"""Scores as column expressions: signatures, rules, risk, trust, fusion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetrisk.config import ALERT_TEXTS, DEFAULTS, RULE_CATALOGUE, TRUSTED_PROVIDERS, RiskConfig
from packetrisk.functions.numbers import capped_ratio


def total(parts: Iterable[tuple[Column, float]], zero=0) -> Column:
    """Sum of the points of the conditions that hold."""
    out = F.lit(zero)
    for condition, points in parts:
        out = out + F.when(condition, F.lit(points)).otherwise(F.lit(zero))
    return out


def threshold_conditions(config: RiskConfig = DEFAULTS) -> list[tuple[str, Column, int]]:
    ports, rate, count = (F.coalesce(F.col(c), F.lit(0)) for c in ("unique_ports", "packet_rate", "packet_count"))
    tcp = F.col("protocol").cast("string") == "TCP"
    if config.tcp_number is not None:
        tcp = tcp | (F.col("protocol").cast("string") == str(config.tcp_number))
    skip = F.coalesce(tcp & (ports <= 2), F.lit(False))
    return [
        ("PORT_SCAN", ~skip & (ports > 20), 40),
        ("TRAFFIC_FLOOD", ~skip & (rate > 50) & (ports > 3), 30),
        ("HIGH_TRAFFIC_SOURCE", ~skip & (count > 500) & (ports > 2), 20),
    ]


def signature_score(config: RiskConfig = DEFAULTS) -> Column:
    return total((c, p) for _, c, p in threshold_conditions(config)).cast("int")


def signature_alerts(config: RiskConfig = DEFAULTS) -> Column:
    """array<struct<type, source_ip, description>> of the thresholds passed, in their order."""
    found = [F.when(c, F.struct(F.lit(t).alias("type"), F.col("source_ip"), F.lit(ALERT_TEXTS[t]).alias("description"))) for t, c, _ in threshold_conditions(config)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def catalogue_conditions(rules=RULE_CATALOGUE) -> list[tuple[str, Column, int]]:
    protocol, port, count = (F.coalesce(F.col(c), F.lit(0)) for c in ("protocol", "dst_port", "packet_count"))
    out = []
    for name, score, number, ports, above in rules:
        condition = count > above
        if number is not None:
            condition = condition & (protocol == number)
        if ports is not None:
            condition = condition & port.between(*ports)
        out.append((name, condition, score))
    return out


def matched_rules(rules: list[tuple[str, Column, int]] | None = None) -> Column:
    """Names of the rules that hold; ``rules`` may be any (name, Column, score) list."""
    rules = catalogue_conditions() if rules is None else rules
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c, _ in rules)), lambda x: x.isNotNull())


def rule_score(rules: list[tuple[str, Column, int]] | None = None) -> Column:
    return total((c, p) for _, c, p in (catalogue_conditions() if rules is None else rules)).cast("int")


def risk_parts() -> dict[str, Column]:
    flag = F.coalesce(F.col("anomaly_detected"), F.lit(False))
    return {
        "s": capped_ratio(F.coalesce(F.col("signature_score"), F.lit(0)).cast("double"), 100),
        "a": F.when(flag, 1.0).otherwise(0.0),
        "t": capped_ratio(F.col("density_60s").cast("double"), 50),
        "b": capped_ratio(F.col("drift"), 500),
        "r": capped_ratio(F.col("rate_30s").cast("double"), 50),
    }


def weighted_risk(config: RiskConfig = DEFAULTS) -> Column:
    p = risk_parts()
    ws, wa, wt, wb = (F.lit(w) for w in config.weights)
    return (ws * p["s"] + wa * p["a"] + wt * p["t"] + wb * (p["b"] + p["r"])) * F.lit(100.0)


def signal_strength() -> Column:
    return total([
        (F.col("signature_score") > 30, 1), (F.coalesce(F.col("anomaly_detected"), F.lit(False)), 1), (F.col("density_60s") > 20, 1),
        (F.col("drift") > 50, 1), (F.col("rate_30s") > 10, 1),
    ])


def damped(risk: Column, strength: Column, trust: Column) -> Column:
    """Few signals and a trusted source lower the risk; at most 100."""
    by_strength = F.when(strength <= 1, risk * F.lit(0.4)).when(strength == 2, risk * F.lit(0.7)).otherwise(risk)
    by_trust = F.when((trust > 0.5) & (strength < 3), by_strength * F.lit(0.3)).otherwise(by_strength)
    return F.least(by_trust, F.lit(100.0))


def threat_level(score: Column) -> Column:
    return F.when(score >= 90, "CRITICAL").when(score >= 75, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def trust_of(hostname: Column, ip: Column) -> tuple[Column, Column]:
    """(trust score, domain) of a looked-up hostname: no name, a known provider (first in their order), any other."""
    known = F.coalesce(*(F.when(F.lower(hostname).contains(p), F.lit(p)) for p in TRUSTED_PROVIDERS))
    no_name = hostname.isNull() | F.coalesce(ip, F.lit("")).eqNullSafe("")
    score = F.when(no_name, 0.1).when(known.isNotNull(), 0.8).otherwise(0.4)
    return score, F.when(no_name, "unknown").otherwise(F.coalesce(known, hostname))


def fused(base: Column, density: Column, drift: Column, anomaly: Column) -> Column:
    """The additive alternative to the weighted risk."""
    base, density, drift = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (base, density, drift))
    spike = F.when(density > 100, 30.0).when(density > 50, 15.0).otherwise(0.0)
    change = F.when(drift > 50, 20.0).when(drift > 20, 10.0).otherwise(0.0)
    flag = F.when(F.coalesce(anomaly, F.lit(False)), 30.0).otherwise(0.0)
    return F.least(base + spike + change + flag, F.lit(100.0))


def badge(level: Column) -> Column:
    return F.when(level.isin("CRITICAL", "HIGH"), "high").when(level == "MEDIUM", "medium").otherwise("low")

"""Thresholds of the risk jobs; the defaults are the values the jobs are defined with."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RiskConfig:
    flow_timeout_s: int = 10
    rate_limit_window_s: int = 10
    rate_limit_packets: int = 50
    packet_rate_window_s: int = 30
    density_window_s: int = 60
    drift_history: int = 20
    drift_least: int = 5
    alert_cooldown_s: int = 30
    block_hold_s: int = 120
    weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)
    wire_packet_rate: bool = True
    tcp_number: int | None = None


#: Provider names in order of precedence.
TRUSTED_PROVIDERS = ["google", "amazonaws", "cloudflare", "microsoft", "facebook", "akamai", "fastly"]
#: Address prefixes of the three "private" tests.
LOCAL_SOURCE_PREFIXES = ["192.", "10.", "172."]
PRIVATE_PREFIXES = ["10.", "192.168", "127."]
#: Threshold alerts (type, description).
ALERT_TEXTS = {
    "PORT_SCAN": "Multiple ports accessed (possible scanning)",
    "TRAFFIC_FLOOD": "High packet rate with multiple ports",
    "HIGH_TRAFFIC_SOURCE": "Unusually high packet volume",
}
#: The rule catalogue: name, score, protocol, destination ports (from, to), packet count above.
RULE_CATALOGUE = [
    ("Port Scan", 40, None, (1, 1023), 20),
    ("Possible DDoS", 60, None, None, 100),
    ("Suspicious UDP Flood", 50, 17, None, 80),
    ("SSH Brute Force", 45, None, (22, 22), 15),
    ("HTTP Flood", 50, None, (80, 80), 60),
    ("DNS Amplification", 55, None, (53, 53), 70),
]
SERIOUS = ["HIGH", "CRITICAL"]
DEFAULTS = RiskConfig()

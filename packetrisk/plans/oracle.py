"""The same answers in DuckDB SQL, written from the definitions over the driver's tables."""

from __future__ import annotations

LOCAL = "(source_ip LIKE '192.%' OR source_ip LIKE '10.%' OR source_ip LIKE '172.%')"
PRIVATE = "(source_ip LIKE '10.%' OR source_ip LIKE '192.168%' OR source_ip LIKE '127.%')"
SHAPE = r"regexp_matches(source_ip, '^\d{1,3}(\.\d{1,3}){3}$')"

_STEPS = {
    "raw": r"""SELECT event_id AS packet_id, (epoch_us(ts) - 1704067200000000) // 10000 AS t_us, ts,
  CASE WHEN event_id % 5 = 0 THEN '203.0.113.7' WHEN event_id % 20 = 1 THEN '142.250.0.9' WHEN user_id % 10 = 0 THEN '10.0.0.' || (user_id % 250) WHEN user_id % 10 = 1 THEN '192.168.1.' || (user_id % 250)
    WHEN user_id % 10 = 2 THEN '172.217.3.' || (user_id % 250) WHEN event_id % 97 = 3 THEN NULL ELSE '45.33.' || (user_id // 250) || '.' || (user_id % 250) END AS src_ip,
  '100.64.0.' || (CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE user_id % 3 END) AS destination_ip,
  CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 1 ELSE 6 END AS protocol, CASE WHEN event_type = 'signup' THEN 0 ELSE (1024 + event_id % 50000)::INT END AS src_port,
  CASE WHEN event_type = 'signup' THEN 0 WHEN event_id % 5 = 0 THEN 1 + 10 * k WHEN k % 5 = 0 THEN 80 WHEN k % 5 = 1 THEN 443 WHEN k % 5 = 2 THEN 22 WHEN k % 5 = 3 THEN 53 ELSE 8000 + k END AS dst_port,
  (40 + floor(value))::INT AS packet_length, value > 150 AS anomaly_detected, value
  FROM (SELECT *, regexp_extract(props, ':\s*(-?\d+)', 1)::INT AS k FROM events)""",
    "pk": "SELECT * EXCLUDE (src_ip), coalesce(src_ip, 'unknown') AS source_ip FROM raw",
    "f1": "SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY source_ip, destination_ip ORDER BY t_us, packet_id) > 10000000 THEN 1 ELSE 0 END AS brk FROM pk",
    "f2": "SELECT *, (sum(brk) OVER (PARTITION BY source_ip, destination_ip ORDER BY t_us, packet_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM f1",
    "f3": "SELECT *, row_number() OVER (PARTITION BY source_ip, destination_ip, session ORDER BY t_us, packet_id) AS packet_count, CASE WHEN dst_port <> 0 AND row_number() OVER (PARTITION BY source_ip, destination_ip, session, dst_port ORDER BY t_us, packet_id) = 1 THEN 1 ELSE 0 END AS newport FROM f2",
    "fl": "SELECT *, (sum(newport) OVER (PARTITION BY source_ip, destination_ip, session ORDER BY t_us, packet_id ROWS UNBOUNDED PRECEDING))::BIGINT AS unique_ports FROM f3",
    "tr": """SELECT *, count(*) OVER (PARTITION BY source_ip ORDER BY t_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS c10, count(*) OVER (PARTITION BY source_ip ORDER BY t_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW) AS c30,
  count(*) OVER (PARTITION BY source_ip ORDER BY t_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS c60, count(*) OVER p AS seen, avg(packet_count) OVER p AS mean FROM fl WINDOW p AS (PARTITION BY source_ip ORDER BY t_us, packet_id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)""",
    "ac": "SELECT *, CASE WHEN seen >= 4 THEN abs(packet_count - mean) ELSE 0.0::DOUBLE END AS drift FROM tr",
    "de": """SELECT *, CASE WHEN unique_ports > 20 THEN 40 ELSE 0 END + CASE WHEN c30 > 50 AND unique_ports > 3 THEN 30 ELSE 0 END + CASE WHEN packet_count > 500 AND unique_ports > 2 THEN 20 ELSE 0 END AS signature_score,
  concat_ws(',', CASE WHEN unique_ports > 20 THEN 'PORT_SCAN' END, CASE WHEN c30 > 50 AND unique_ports > 3 THEN 'TRAFFIC_FLOOD' END, CASE WHEN packet_count > 500 AND unique_ports > 2 THEN 'HIGH_TRAFFIC_SOURCE' END) AS alert_types,
  concat_ws(',', CASE WHEN dst_port BETWEEN 1 AND 1023 AND packet_count > 20 THEN 'Port Scan' END, CASE WHEN packet_count > 100 THEN 'Possible DDoS' END, CASE WHEN protocol = 17 AND packet_count > 80 THEN 'Suspicious UDP Flood' END,
    CASE WHEN dst_port = 22 AND packet_count > 15 THEN 'SSH Brute Force' END, CASE WHEN dst_port = 80 AND packet_count > 60 THEN 'HTTP Flood' END, CASE WHEN dst_port = 53 AND packet_count > 70 THEN 'DNS Amplification' END) AS matched_rules,
  CASE WHEN dst_port BETWEEN 1 AND 1023 AND packet_count > 20 THEN 40 ELSE 0 END + CASE WHEN packet_count > 100 THEN 60 ELSE 0 END + CASE WHEN protocol = 17 AND packet_count > 80 THEN 50 ELSE 0 END
    + CASE WHEN dst_port = 22 AND packet_count > 15 THEN 45 ELSE 0 END + CASE WHEN dst_port = 80 AND packet_count > 60 THEN 50 ELSE 0 END + CASE WHEN dst_port = 53 AND packet_count > 70 THEN 55 ELSE 0 END AS rule_score FROM ac""",
    "src": "SELECT DISTINCT src_ip AS ip, split_part(src_ip, '.', 4)::INT AS o FROM raw WHERE src_ip IS NOT NULL",
    "dns": "SELECT * FROM (SELECT ip, CASE WHEN ip = '142.250.0.9' THEN 'edge-9.GOOGLE.example' WHEN ip LIKE '45.33.%' AND o % 50 = 3 THEN 'cdn.cloudflare.amazonaws.example' WHEN ip LIKE '45.33.%' AND o % 7 <> 0 THEN 'host-' || o || '.isp.example' END AS hostname FROM src) WHERE hostname IS NOT NULL",
    "geo": "SELECT ip, (3 * n_nationkey - 36)::DOUBLE AS lat, (10 * n_nationkey - 120)::DOUBLE AS lon, n_name AS country FROM src JOIN nation ON o % 25 = n_nationkey WHERE ip <> '203.0.113.7'",
    "tu": """SELECT de.*, CASE WHEN hostname IS NULL THEN 0.1::DOUBLE WHEN known IS NOT NULL THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS trust, CASE WHEN hostname IS NULL THEN 'unknown' ELSE coalesce(known, hostname) END AS dom
  FROM de LEFT JOIN (SELECT *, CASE WHEN lower(hostname) LIKE '%google%' THEN 'google' WHEN lower(hostname) LIKE '%amazonaws%' THEN 'amazonaws' WHEN lower(hostname) LIKE '%cloudflare%' THEN 'cloudflare' END AS known FROM dns) n ON source_ip = ip""",
    "co": """SELECT *, least(signature_score / 100.0::DOUBLE, 1.0::DOUBLE) AS s, CASE WHEN anomaly_detected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a, least(c60 / 50.0::DOUBLE, 1.0::DOUBLE) AS t, least(drift / 500.0::DOUBLE, 1.0::DOUBLE) AS b, least(c30 / 50.0::DOUBLE, 1.0::DOUBLE) AS r,
  (CASE WHEN signature_score > 30 THEN 1 ELSE 0 END + CASE WHEN anomaly_detected THEN 1 ELSE 0 END + CASE WHEN c60 > 20 THEN 1 ELSE 0 END + CASE WHEN drift > 50 THEN 1 ELSE 0 END + CASE WHEN c30 > 10 THEN 1 ELSE 0 END)::BIGINT AS signal_strength FROM tu""",
    "ba": "SELECT *, (0.4::DOUBLE * s + 0.3::DOUBLE * a + 0.2::DOUBLE * t + 0.1::DOUBLE * (b + r)) * 100.0::DOUBLE AS base_risk FROM co",
    "da": "SELECT *, CASE WHEN signal_strength <= 1 THEN base_risk * 0.4::DOUBLE WHEN signal_strength = 2 THEN base_risk * 0.7::DOUBLE ELSE base_risk END AS d1 FROM ba",
    "ri": "SELECT *, least(CASE WHEN trust > 0.5::DOUBLE AND signal_strength < 3 THEN d1 * 0.3::DOUBLE ELSE d1 END, 100.0::DOUBLE) AS risk FROM da",
    "rp": "SELECT *, risk * 100.0::DOUBLE AS p, risk * 134217729.0::DOUBLE - (risk * 134217729.0::DOUBLE - risk) AS hi FROM ri",
    "re": "SELECT *, (hi * 100.0::DOUBLE - p) + (risk - hi) * 100.0::DOUBLE AS err, p - floor(p) = 0.5::DOUBLE AS half FROM rp",
    "rr": "SELECT *, CASE WHEN half AND err > 0 THEN ceil(p) WHEN half AND err < 0 THEN floor(p) ELSE round_even(p, 0) END / 100.0::DOUBLE AS rounded FROM re",
    "sc": f"""SELECT packet_id, t_us, ts, value, source_ip, destination_ip, protocol, src_port, dst_port, packet_length, packet_count, unique_ports, signature_score, alert_types, matched_rules, rule_score, anomaly_detected, signal_strength, c10 > 50 AS rate_limited,
  {LOCAL} AS is_local, CASE WHEN {LOCAL} THEN 'local' ELSE dom END AS domain, CASE WHEN {LOCAL} THEN 1.0::DOUBLE ELSE trust END AS trust_score, CASE WHEN {LOCAL} THEN 0.0::DOUBLE ELSE rounded END AS risk_score,
  CASE WHEN {LOCAL} THEN 0 ELSE c30 END AS packet_rate, CASE WHEN {LOCAL} THEN 0 ELSE c60 END AS temporal_attack_density, CASE WHEN {LOCAL} THEN 0.0::DOUBLE ELSE drift END AS behavioral_drift,
  CASE WHEN {LOCAL} THEN 'LOW' WHEN risk >= 90 THEN 'CRITICAL' WHEN risk >= 75 THEN 'HIGH' WHEN risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
  CASE WHEN {LOCAL} THEN 'Ignored (Local Traffic)' WHEN risk >= 90 AND signal_strength >= 3 THEN 'Would Block (Simulation): ' || source_ip ELSE 'Monitored' END AS response_action FROM rr""",
    "lo": f"SELECT * FROM sc WHERE threat_level IN ('MEDIUM', 'HIGH', 'CRITICAL') AND source_ip <> '' AND NOT {PRIVATE}",
    "se": "SELECT * FROM lo WHERE threat_level IN ('HIGH', 'CRITICAL')",
    "pr": """SELECT source_ip, count(*) AS n, sum(risk_score) AS total_risk, greatest(0.0::DOUBLE, max(risk_score)) AS max_risk, sum(risk_score) / count(*) AS avg_risk, arg_max(threat_level, t_us * 1000000 + packet_id) AS latest_threat, max(t_us) AS last_us,
  min(t_us * 1000000 + packet_id) AS first_seen FROM sc GROUP BY source_ip""",
    "tp": "SELECT *, max_risk::DECIMAL(20, 9) AS m FROM pr ORDER BY max_risk DESC, first_seen LIMIT 5",
}


def _with(last: str, body: str, recursive: str = "") -> str:
    """``body`` after the steps up to ``last`` (and extra steps)."""
    steps, needed = list(_STEPS), []
    for name in steps[: steps.index(last) + 1]:
        needed.append(f"{name} AS ({_STEPS[name]})")
    extra = f", {recursive}" if recursive else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(needed)}{extra} {body}"


def _held(rows: str, hold_us: int, compare: str) -> str:
    """Recursive steps: c (candidates numbered per source), h (with the emitted flag)."""
    return (
        f"c AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY t_us, packet_id) AS rn FROM {rows}), "
        "h AS (SELECT packet_id, source_ip, t_us, rn, t_us AS last, true AS emitted FROM c WHERE rn = 1 UNION ALL "
        f"SELECT c.packet_id, c.source_ip, c.t_us, c.rn, CASE WHEN c.t_us - h.last {compare} {hold_us} THEN c.t_us ELSE h.last END, c.t_us - h.last {compare} {hold_us} FROM h JOIN c ON c.source_ip = h.source_ip AND c.rn = h.rn + 1)"
    )


_HIGH_VALUE = "(SELECT * FROM pk WHERE value > 100)"
_BLOCKABLE = f"(SELECT * FROM pk WHERE value > 100 AND {SHAPE} AND NOT {PRIVATE})"
_LEDGER = f"""l AS (SELECT p.packet_id, p.t_us, p.source_ip, CASE WHEN NOT {SHAPE.replace('source_ip', 'p.source_ip')} THEN 'Invalid IP' WHEN {PRIVATE.replace('source_ip', 'p.source_ip')} THEN 'Skipped (Local/Private IP)' WHEN h.emitted THEN 'Blocked IP: ' || p.source_ip ELSE 'Already Blocked' END AS status,
  CASE WHEN h.emitted THEN p.t_us + 120000000 END AS expires_us FROM pk p LEFT JOIN h USING (packet_id) WHERE p.value > 100)"""
_RELEASES = "SELECT packet_id, t_us, source_ip, status, expires_us FROM l UNION ALL SELECT packet_id, expires_us + 1, source_ip, 'Released IP: ' || source_ip, NULL FROM l{}"
_MESSAGES = """, texts AS (SELECT *, '{"packet_id": ' || packet_id || ', ' || CASE WHEN packet_id % 23 = 0 THEN '' ELSE '"src_ip": "' || source_ip || '", "dst_ip": "' || destination_ip || '", "protocol": ' || q || protocol || q || ', ' END || '"src_port": ' || q || src_port || q
  || ', "dst_port": ' || q || dst_port || q || ', "packet_length": ' || packet_length || ', "timestamp": "' || CASE WHEN packet_id % 29 = 0 THEN 'soon' ELSE strftime(make_timestamp(t_us + 1704067200000000), '%Y-%m-%dT%H:%M:%S.%f') END || '"}' AS whole
  FROM (SELECT *, CASE WHEN packet_id % 7 = 0 THEN '"' ELSE '' END AS q FROM pk)),
broken AS (SELECT *, packet_id::VARCHAR AS key, CASE WHEN packet_id % 17 = 0 THEN whole[1:20] WHEN packet_id % 19 = 0 THEN '[1, 2]' WHEN packet_id % 31 = 0 THEN NULL ELSE whole END AS text FROM texts),
parsed AS (SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM broken),
judged AS (SELECT *, CASE WHEN text IS NULL THEN 'no text' WHEN j IS NULL THEN 'not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' WHEN j->>'$.src_ip' IS NULL AND j->>'$.dst_ip' IS NULL AND j->>'$.protocol' IS NULL THEN 'no IP layer'
  WHEN try_cast(j->>'$.timestamp' AS TIMESTAMP) IS NULL THEN 'no time' END AS reason FROM parsed)"""
_SCORED = "packet_id, source_ip, destination_ip, packet_count, unique_ports, packet_rate, temporal_attack_density, round(behavioral_drift, 6) AS behavioral_drift, signature_score, rate_limited, trust_score, domain, round(risk_score, 6) AS risk_score, threat_level, response_action"
_TOP = "SELECT source_ip AS key, count(*) AS n FROM {} GROUP BY source_ip ORDER BY n DESC, min(t_us * 1000000 + packet_id) LIMIT {}"
_TYPES = "SELECT key, count(*) AS n, min(t_us * 1000000 + packet_id) AS f FROM (SELECT unnest(string_split(alert_types, ',')) AS key, t_us, packet_id FROM {} WHERE alert_types <> '') GROUP BY key"
_HOURS = "SELECT hour(ts)::VARCHAR AS key, count(*) AS n, min(t_us * 1000000 + packet_id) AS f FROM {} GROUP BY key"

ORACLE: dict[str, str] = {
    "packets_ingest": _with("pk", "SELECT packet_id, t_us, source_ip, destination_ip, protocol, src_port, dst_port, packet_length FROM pk"),
    "packets_ports": _with("pk", "SELECT packet_id, source_ip, CASE WHEN protocol IN (6, 17) THEN src_port ELSE 0 END AS src_port, CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port FROM pk WHERE packet_id % 11 <> 0"),
    "safe_numbers": _with("pk", "SELECT packet_id, CASE WHEN packet_id % 4 = 1 THEN dst_port ELSE 0 END AS as_int, CASE WHEN packet_id % 4 = 1 THEN dst_port ELSE 0 END::DOUBLE AS as_number, CASE packet_id % 4 WHEN 1 THEN dst_port::DOUBLE WHEN 2 THEN dst_port + 0.5::DOUBLE ELSE 0 END AS as_float, trunc(value)::INT AS cut FROM pk"),
    "ip_classes": _with("pk", f"SELECT source_ip AS ip, count(*) AS n, {LOCAL} AS local_source, {PRIVATE} AS private, {SHAPE} AS ipv4 FROM pk GROUP BY source_ip"),
    "port_classes": _with("pk", "SELECT dst_port, count(*) AS n, dst_port BETWEEN 1 AND 65535 AS valid FROM pk GROUP BY dst_port"),
    "features": _with("fl", "SELECT packet_id, packet_count::DOUBLE AS packet_count, protocol::DOUBLE AS protocol, src_port::DOUBLE AS src_port, dst_port::DOUBLE AS dst_port, round(least(packet_count / 100.0::DOUBLE, 1.0::DOUBLE), 6) AS n_packet_count, round(protocol / 255.0::DOUBLE, 6) AS n_protocol, round(src_port / 65535.0::DOUBLE, 6) AS n_src_port, round(dst_port / 65535.0::DOUBLE, 6) AS n_dst_port FROM fl"),
    "flow_snapshots": _with("fl", "SELECT packet_id, source_ip, destination_ip, protocol, src_port, dst_port, packet_count, unique_ports FROM fl"),
    "flow_sessions": _with("fl", "SELECT source_ip, destination_ip, session, max(packet_count) AS packet_count, max(unique_ports) AS unique_ports, min(t_us) AS first_us, max(t_us) AS last_us, (SELECT max(t_us) FROM fl) - max(t_us) <= 10000000 AS active FROM fl GROUP BY source_ip, destination_ip, session"),
    "packet_rate": _with("tr", f"SELECT packet_id, source_ip, CASE WHEN {LOCAL} THEN 0 ELSE c30 END AS packet_rate FROM tr"),
    "temporal_density": _with("tr", f"SELECT packet_id, CASE WHEN {LOCAL} THEN 0 ELSE c60 END AS scorer_density, c60 AS density FROM tr"),
    "rate_limited": _with("tr", "SELECT packet_id, source_ip, c10 AS rate, c10 > 50 AS limited FROM tr"),
    "behavioral_drift": _with("ac", "SELECT packet_id, round(drift, 6) AS drift FROM ac"),
    "ema_drift": _with("fl", "SELECT packet_id, round(CASE WHEN len(seen) = 0 OR seen IS NULL THEN 0.0::DOUBLE ELSE abs(packet_count - list_reduce(seen, lambda b, v: (b + v) / 2.0::DOUBLE)) END, 6) AS ema_drift FROM (SELECT packet_id, packet_count, list(packet_count::DOUBLE) OVER (PARTITION BY source_ip ORDER BY t_us, packet_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS seen FROM fl)"),
    "signatures": _with("de", "SELECT packet_id, signature_score, alert_types FROM de"),
    "rule_catalogue": _with("de", "SELECT packet_id, rule_score, matched_rules FROM de"),
    "hybrid": _with("de", "SELECT packet_id, signature_score, matched_rules, anomaly_detected, unique_ports, packet_count, protocol FROM de"),
    "trust_scores": _with("tu", "SELECT source_ip, count(*) AS n, any_value(trust) AS trust_score, any_value(dom) AS domain FROM tu GROUP BY source_ip"),
    "risk_components": _with("ba", "SELECT packet_id, round(s, 6) AS s, round(a, 6) AS a, round(t, 6) AS t, round(b, 6) AS b, round(r, 6) AS r, round(base_risk, 6) AS base_risk FROM ba"),
    "risk_score": _with("sc", "SELECT packet_id, signal_strength, domain, trust_score, round(risk_score, 6) AS risk_score, response_action FROM sc"),
    "threat_levels": _with("sc", "SELECT threat_level, is_local, count(*) AS n FROM sc GROUP BY threat_level, is_local"),
    "fused_risk": _with("de", "SELECT packet_id, round(least(rule_score::DOUBLE + CASE WHEN c60 > 100 THEN 30 WHEN c60 > 50 THEN 15 ELSE 0 END + CASE WHEN drift > 50 THEN 20 WHEN drift > 20 THEN 10 ELSE 0 END + CASE WHEN anomaly_detected THEN 30 ELSE 0 END, 100.0::DOUBLE), 6) AS fused FROM de"),
    "events_stored": _with("sc", "SELECT packet_id, t_us + 1704067200000000 AS timestamp, source_ip, destination_ip, protocol, src_port, dst_port, packet_count, signature_score, matched_rules, anomaly_detected, round(risk_score, 6) AS risk_score, threat_level, packet_rate, round(behavioral_drift, 6) AS behavioral_drift, trust_score, response_action FROM sc"),
    "events_wide": _with("sc", """SELECT packet_id, t_us + 1704067200000000 AS timestamp, source_ip, packet_count, unique_ports, protocol, signature_score, anomaly_detected, round(risk_score, 6) AS risk_score, threat_level, temporal_attack_density, round(behavioral_drift, 6) AS behavioral_drift, response_action,
  concat_ws(';', CASE WHEN alert_types LIKE '%PORT_SCAN%' THEN 'PORT_SCAN|' || source_ip || '|Multiple ports accessed (possible scanning)' END, CASE WHEN alert_types LIKE '%TRAFFIC_FLOOD%' THEN 'TRAFFIC_FLOOD|' || source_ip || '|High packet rate with multiple ports' END,
    CASE WHEN alert_types LIKE '%HIGH_TRAFFIC_SOURCE%' THEN 'HIGH_TRAFFIC_SOURCE|' || source_ip || '|Unusually high packet volume' END) AS alerts FROM sc"""),
    "events_roundtrip": _with("sc", "SELECT packet_id, source_ip, packet_count, round(risk_score, 6) AS risk_score, threat_level FROM sc"),
    "events_count": "SELECT count(*) AS n FROM events",
    "events_clear": "SELECT count(*) AS before, 0::BIGINT AS after FROM events",
    "alerts": _with("sc", "SELECT packet_id, 'SECURITY_ALERT' AS alert_type, source_ip, threat_level, round(risk_score, 6) AS risk_score, 'Threat detected from ' || source_ip || ' with risk ' || risk_score AS message FROM sc WHERE packet_id IN (SELECT packet_id FROM h WHERE emitted)", _held("(SELECT * FROM sc WHERE threat_level IN ('HIGH', 'CRITICAL'))", 30000000, ">=")),
    "cooldown": _with("pk", "SELECT packet_id, source_ip, emitted FROM h", _held(_HIGH_VALUE, 30000000, ">=")),
    "block_ledger": _with("pk", "SELECT packet_id, source_ip, status, expires_us FROM l", _held(_BLOCKABLE, 120000000, ">") + ", " + _LEDGER),
    "block_status": _with("pk", "SELECT (SELECT count(*) FROM l WHERE expires_us >= (SELECT max(t_us) FROM l)) AS total_blocked, (SELECT string_agg(source_ip, ',' ORDER BY t_us DESC, packet_id DESC) FROM (SELECT * FROM l WHERE expires_us IS NOT NULL ORDER BY t_us DESC, packet_id DESC LIMIT 10)) AS recent_blocks", _held(_BLOCKABLE, 120000000, ">") + ", " + _LEDGER),
    "attackers": _with("lo", _TOP.format("lo", 5)),
    "attack_types": _with("lo", f"SELECT key, n FROM ({_TYPES.format('lo')})"),
    "attack_hours": _with("lo", f"SELECT key, n FROM ({_HOURS.format('lo')})"),
    "trend_summary": _with("se", f"""SELECT 'unique_attackers' AS metric, NULL::VARCHAR AS key, count(DISTINCT source_ip) AS n FROM se UNION ALL SELECT 'top_attacker', * FROM ({_TOP.format('se', 1)}) UNION ALL SELECT 'most_common_attack', key, n FROM (SELECT * FROM ({_TYPES.format('se')}) ORDER BY n DESC, f LIMIT 1)
  UNION ALL SELECT 'peak_attack_hour', key, n FROM (SELECT * FROM ({_HOURS.format('se')}) ORDER BY n DESC, f LIMIT 1) UNION ALL SELECT 'top_5_attackers', * FROM ({_TOP.format('se', 5)})"""),
    "ip_risk_profile": _with("pr", 'SELECT source_ip, n AS count, round(total_risk, 4) AS total_risk, round(max_risk, 6) AS max_risk, round(avg_risk, 4) AS avg_risk, latest_threat, last_us + 1704067200000000 AS last_seen FROM pr'),
    "ip_risk_top": _with("tp", "SELECT source_ip, n AS count, trunc(max_risk)::INT AS risk, CASE WHEN latest_threat IN ('CRITICAL', 'HIGH') THEN 'high' WHEN latest_threat = 'MEDIUM' THEN 'medium' ELSE 'low' END AS badge FROM tp"),
    "threat_table": _with("tp", "SELECT source_ip AS ip, coalesce(hostname, 'Unknown') AS domain, coalesce(country, 'Unknown') AS country, n AS count, trunc(max_risk)::INT AS risk, latest_threat AS severity, CASE WHEN latest_threat IN ('CRITICAL', 'HIGH') THEN 'high' WHEN latest_threat = 'MEDIUM' THEN 'medium' ELSE 'low' END AS badge FROM tp LEFT JOIN dns ON source_ip = dns.ip LEFT JOIN geo ON source_ip = geo.ip"),
    "geo_points": _with("tp", "SELECT source_ip AS ip, lat, lon FROM tp JOIN geo ON source_ip = geo.ip WHERE lat <> 0"),
    "training_clean": _with("fl", "SELECT packet_id, CASE WHEN packet_id % 13 = 0 THEN 0 ELSE packet_count END::DOUBLE AS packet_count, CASE WHEN packet_id % 13 = 1 THEN 0 ELSE protocol END::DOUBLE AS protocol, CASE WHEN packet_id % 13 = 2 THEN 0 ELSE src_port END::DOUBLE AS src_port, CASE WHEN packet_id % 13 = 3 THEN 0 ELSE dst_port END::DOUBLE AS dst_port FROM fl"),
    "score_packets": _with("sc", f"SELECT {_SCORED} FROM sc"),
    "score_hot_sources": _with("sc", f"SELECT {_SCORED} FROM sc"),
    "stream_scores": _with("sc", f"SELECT {_SCORED} FROM sc"),
    "stream_alerts": _with("sc", "SELECT packet_id, source_ip, threat_level, round(risk_score, 6) AS risk_score FROM sc WHERE packet_id IN (SELECT packet_id FROM h WHERE emitted)", _held("(SELECT * FROM sc WHERE threat_level IN ('HIGH', 'CRITICAL'))", 30000000, ">=")),
    "stream_stored_alerts": _with("sc", "SELECT packet_id, source_ip, threat_level, round(risk_score, 6) AS risk_score FROM sc WHERE packet_id IN (SELECT packet_id FROM h WHERE emitted)", _held("(SELECT * FROM sc WHERE threat_level IN ('HIGH', 'CRITICAL'))", 30000000, ">=")),
    "stream_sessions": _with("fl", "SELECT source_ip, destination_ip, max(packet_count) AS packet_count, max(unique_ports) AS unique_ports, min(t_us) AS first_us, max(t_us) AS last_us FROM fl GROUP BY source_ip, destination_ip, session"),
    "stream_trends": _with("sc", "SELECT source_ip, count(*) AS n, round(max(risk_score), 6) AS max_risk, round(sum(risk_score), 4) AS total_risk FROM sc GROUP BY source_ip"),
    "stream_attackers": _with("lo", _TOP.format("lo", 5)),
    "messages_packets": _with("pk", _MESSAGES + " SELECT packet_id, CASE WHEN packet_id % 23 = 0 THEN 'unknown' ELSE coalesce(nullif(j->>'$.src_ip', ''), 'unknown') END AS source_ip, coalesce(j->>'$.dst_ip', 'unknown') AS destination_ip, coalesce((j->>'$.protocol')::INT, 0) AS protocol, (j->>'$.src_port')::INT AS src_port, (j->>'$.dst_port')::INT AS dst_port, (j->>'$.packet_length')::INT AS packet_length, t_us FROM judged WHERE reason IS NULL"),
    "messages_rejected": _with("pk", _MESSAGES + " SELECT key, text, reason FROM judged WHERE reason IS NOT NULL"),
    "stream_messages": _with("pk", _MESSAGES + " SELECT packet_id, CASE WHEN reason IS NULL THEN source_ip END AS source_ip, CASE WHEN reason IS NULL THEN dst_port END AS dst_port, reason FROM judged"),
    "block_events": _with("pk", _RELEASES.format(" WHERE expires_us < (SELECT max(t_us) FROM l)"), _held(_BLOCKABLE, 120000000, ">") + ", " + _LEDGER),
    "stream_blocks": _with("pk", _RELEASES.format(" WHERE expires_us IS NOT NULL"), _held(_BLOCKABLE, 120000000, ">") + ", " + _LEDGER),
    "stream_block_table": _with("pk", "SELECT source_ip, arg_max(packet_id, t_us) AS packet_id, max(t_us) + 120000001 AS t_us, false AS blocked FROM l WHERE expires_us IS NOT NULL GROUP BY source_ip", _held(_BLOCKABLE, 120000000, ">") + ", " + _LEDGER),
    "stream_events": _with("sc", "SELECT packet_id, source_ip, packet_count, round(risk_score, 6) AS risk_score, threat_level FROM sc"),
}

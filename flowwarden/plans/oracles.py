"""Independent DuckDB SQL for every query that SQL can express, on the whole tables."""

from __future__ import annotations

from flowwarden.operators.augment import beta_quantiles
from flowwarden.plans.oracle_tables import (
    BUSY_FLOWS,
    BUSY_MATCHES,
    CONNECTIONS,
    FLOW_MATCHES,
    FLOWS,
    LINKS,
    MESSAGES,
)

FEATURES = (
    "flow_duration pkt_count byte_count bytes_per_pkt src_port dst_port protocol_id "
    "function_code unique_fc_count req_resp_ratio inter_arrival_mean inter_arrival_std "
    "is_broadcast direction burst_count error_rate"
).split()

SQL: dict[str, str] = {}


def rnd(expr: str, places: int, name: str) -> str:
    """Rounded like the queries do: a small nudge keeps exact halves on one side."""
    return f"round({expr} + 1e-{places + 3}::double, {places}) + 0.0 AS {name}"


def over(source: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{source} {body}"


# ---- sources and sinks ----

_LOG = (
    FLOWS
    + """
, lines AS (
SELECT uid, src_port % 50 AS c, ts_us / 1000000.0::double AS ts, src_ip, dst_ip, src_port, dst_port, flow_duration, function_code,
  pkt_count - pkt_count // 3 AS op, pkt_count // 3 AS rp, byte_count - byte_count // 3 AS ob, byte_count // 3 AS rb
FROM flows)
"""
)

SQL["src1_json_scan"] = over(
    _LOG,
    """
SELECT uid, ts, src_ip AS orig_h, CASE WHEN c = 8 THEN NULL ELSE dst_ip END AS resp_h, src_port::varchar AS orig_p,
  CASE WHEN c = 5 THEN NULL ELSE flow_duration END AS duration, CASE WHEN c = 7 THEN 'many' ELSE op::varchar END AS orig_pkts FROM lines
UNION ALL
SELECT uid, ts, src_ip, dst_ip, src_port::varchar, flow_duration, '999999' FROM lines WHERE c = 4
""",
)
SQL["src2_optional_scan"] = over(
    _LOG,
    """
SELECT uid, CASE WHEN c = 9 THEN 'abc' ELSE function_code::varchar END AS fc_request FROM lines WHERE dst_port = 20000
UNION ALL
SELECT uid, '99' FROM lines WHERE dst_port = 20000 AND c = 10
""",
)
SQL["src3_last_wins"] = over(
    _LOG, "SELECT uid, CASE WHEN c = 7 THEN 'many' ELSE op::varchar END AS orig_pkts FROM lines"
)
SQL["src4_conn_flows"] = over(
    _LOG,
    """
SELECT uid, (ts * 1000000)::bigint AS ts_us, src_ip, CASE WHEN c = 8 THEN '0.0.0.0' ELSE dst_ip END AS dst_ip,
  CASE WHEN c = 5 THEN 0.0 ELSE flow_duration END AS flow_duration, (op + rp)::int AS pkt_count, ob + rb AS byte_count,
  round((ob + rb)::double / (op + rp) + 1e-9::double, 6) AS bytes_per_pkt, src_port, dst_port,
  CASE WHEN dst_port IN (20000, 19999) THEN 1 ELSE 0 END AS protocol_id,
  CASE WHEN dst_port = 20000 THEN function_code ELSE 0 END AS function_code, 1 AS unique_fc_count,
  round(op::double / (op + rp) + 1e-9::double, 6) AS req_resp_ratio, 0.0::double AS inter_arrival_mean, 0.0::double AS inter_arrival_std,
  CASE WHEN c <> 8 AND dst_ip LIKE '%.255' THEN 1 ELSE 0 END AS is_broadcast, 0 AS direction, 0 AS burst_count,
  0.0::double AS error_rate, 'normal' AS label
FROM lines WHERE c <> 7 AND NOT (c = 9 AND dst_port = 20000)
""",
)
SQL["src5_dnp3_flows"] = over(
    LINKS,
    """
, logged AS (SELECT s.*, f.function_code, f.dst_port FROM summaries s JOIN flows f USING (uid))
SELECT uid, t_us AS ts_us, orig_h AS src_ip, resp_h AS dst_ip, duration AS flow_duration,
  (orig_pkts + resp_pkts)::int AS pkt_count, orig_bytes + resp_bytes AS byte_count,
  round((orig_bytes + resp_bytes)::double / (orig_pkts + resp_pkts) + 1e-9::double, 6) AS bytes_per_pkt,
  0 AS src_port, dst_port, CASE WHEN dst_port IN (20000, 19999) THEN 1 ELSE 0 END AS protocol_id, function_code,
  unique_fc_count::int AS unique_fc_count,
  CASE WHEN request_count + response_count > 0 THEN round(request_count::double / (request_count + response_count) + 1e-9::double, 6) ELSE 0.5 END AS req_resp_ratio,
  round(inter_arrival_mean * 1000 + 1e-9::double, 6) AS inter_arrival_mean, round(inter_arrival_std * 1000 + 1e-9::double, 6) AS inter_arrival_std,
  is_broadcast::int AS is_broadcast, 2 AS direction, burst_count::int AS burst_count,
  round(error_count::double / (orig_pkts + resp_pkts) + 1e-9::double, 6) AS error_rate, 'normal' AS label,
  0.0::double AS anomaly_score, 'normal' AS anomaly_label
FROM logged
""",
)
SQL["src6_csv"] = over(
    FLOWS,
    "SELECT "
    + ", ".join(
        f"round({f} + 1e-9::double, 6) AS {f}" if f == "bytes_per_pkt" else f"{f}::double AS {f}" for f in FEATURES
    )
    + ", label FROM flows",
)
SQL["snk1_dataset"] = over(
    FLOWS,
    "SELECT label, count(*) AS n, sum(pkt_count)::double AS packets, sum(byte_count)::double AS bytes FROM flows GROUP BY label",
)
SQL["snk2_alert_log"] = over(
    BUSY_MATCHES,
    """
SELECT uid, rule_attack AS attack_type, rule_severity AS severity, rule_score AS confidence,
  strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day FROM best WHERE rule_score > 0
""",
)

_BASE = (
    ", base AS (SELECT count(*) AS n, "
    + ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in FEATURES)
    + " FROM flows WHERE label = 'normal')"
)
_BASE_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, n, {rnd(f'm_{f}', 4, 'mean')}, {rnd(f'v_{f}', 4, 'variance')} FROM base"
    for f in FEATURES
)
SQL["snk3_artifacts"] = over(
    FLOWS + _BASE, f"SELECT *, true AS forest_kept, true AS classifier_kept FROM ({_BASE_ROWS})"
)

_OUTCOMES = (
    BUSY_MATCHES
    + ", outcomes AS (SELECT *, rule_score > 0 AS fired, label <> 'normal' AS truth FROM best)"
)
_CONFUSION = (
    _OUTCOMES
    + """
, cm AS (SELECT count(*) AS total, count(*) FILTER (fired) AS alerts, count(*) FILTER (truth AND fired) AS tp,
  count(*) FILTER (NOT truth AND fired) AS fp, count(*) FILTER (truth AND NOT fired) AS fn,
  count(*) FILTER (NOT truth AND NOT fired) AS tn FROM outcomes)
, rates AS (SELECT *, tp / greatest(tp + fn, 1) AS tpr, fp / greatest(fp + tn, 1) AS fpr,
  tp / greatest(tp + fp, 1) AS precision, (tp + tn) / greatest(tp + fp + fn + tn, 1) AS accuracy FROM cm)
, full_rates AS (SELECT *, 2 * precision * tpr / greatest(precision + tpr, 1e-9) AS f1 FROM rates)
"""
)
_ACTION = "CASE severity WHEN 4 THEN 'ISOLATE' WHEN 3 THEN 'RATE_LIMIT' WHEN 2 THEN 'SEGMENT' ELSE 'MONITOR' END"
_ALERTS = (
    ", alerts AS (SELECT uid, ts_us, src_ip, dst_ip, rule_attack AS attack_type, rule_severity AS severity, "
    "rule_score AS confidence, rule_score AS score, label, "
    + _ACTION.replace("severity", "rule_severity")
    + " AS action FROM best WHERE rule_score > 0)"
)


def _pairs(column: str) -> str:
    return (
        "(SELECT '{' || string_agg('\"' || v || '\":' || n, ',' ORDER BY v) || '}' FROM "
        f"(SELECT {column}::varchar AS v, count(*) AS n FROM alerts GROUP BY 1))"
    )


_TICK_TABLES = """
, ticks AS (SELECT ts_us // 1000000 * 1000000 AS tick_us, count(*) AS total, count(*) FILTER (fired) AS alerts,
  count(*) FILTER (truth AND fired) AS tp, count(*) FILTER (truth AND NOT fired) AS fn FROM outcomes GROUP BY 1)
, cumulated AS (SELECT tick_us, sum(total) OVER w AS total, sum(alerts) OVER w AS alerts, sum(tp) OVER w AS tp, sum(fn) OVER w AS fn
  FROM ticks WINDOW w AS (ORDER BY tick_us))
, line AS (SELECT tick_us, alerts::bigint AS alerts, total::bigint AS total, round(tp / greatest(tp + fn, 1), 3) + 0.0 AS tpr FROM cumulated ORDER BY tick_us DESC LIMIT 60)
"""
_TICKS = _OUTCOMES + _TICK_TABLES

SQL["snk4_metrics_json"] = over(
    _CONFUSION + _ALERTS + _TICK_TABLES,
    f"""
SELECT concat('{{"total":', total, ',"alerts":', alerts, ',"tp":', tp, ',"fp":', fp, ',"fn":', fn, ',"tn":', tn,
  ',"tpr":', round(tpr, 4), ',"fpr":', round(fpr, 4), ',"precision":', round(precision, 4), ',"f1":', round(f1, 4),
  ',"by_severity":', {_pairs('severity')}, ',"by_attack":', {_pairs('attack_type')}, ',"by_action":', {_pairs('action')},
  ',"timeline":', (SELECT '[' || string_agg(concat('{{"tick_us":', tick_us, ',"alerts":', alerts, ',"total":', total, ',"tpr":', tpr, '}}'), ',' ORDER BY tick_us) || ']' FROM line),
  ',"flows_per_sec":', (SELECT (total::double)::varchar FROM ticks ORDER BY tick_us DESC LIMIT 1), '}}') AS snapshot
FROM full_rates
""",
)

# ---- messages to connections ----

_CODES = "array_to_string(function_codes, ',')"
_MEAN = rnd("inter_arrival_mean", 6, "inter_arrival_mean")
_STD = rnd("inter_arrival_std", 6, "inter_arrival_std")
SQL["agg1_connections"] = over(
    CONNECTIONS,
    f"SELECT * REPLACE ({_CODES} AS function_codes, round(inter_arrival_mean + 1e-9::double, 6) AS inter_arrival_mean, round(inter_arrival_std + 1e-9::double, 6) AS inter_arrival_std) FROM connections",
)
SQL["agg2_req_resp"] = over(CONNECTIONS, "SELECT uid, request_count, response_count FROM connections")
SQL["agg3_fc_sets"] = over(
    CONNECTIONS,
    f"""
, codes AS (SELECT uid, fc, count(*) AS n FROM messages GROUP BY uid, fc)
, histograms AS (SELECT uid, string_agg(concat(fc, ':', n), ',' ORDER BY fc) AS histogram FROM codes GROUP BY uid)
SELECT uid, {_CODES} AS function_codes, unique_fc_count, histogram FROM connections JOIN histograms USING (uid)
""",
)
SQL["agg4_interarrival"] = over(CONNECTIONS, f"SELECT uid, {_MEAN}, {_STD} FROM connections")
SQL["agg5_bursts"] = over(CONNECTIONS, "SELECT uid, burst_count FROM connections")
SQL["agg6_errors"] = over(CONNECTIONS, "SELECT uid, error_count FROM connections")
SQL["agg7_broadcast"] = over(CONNECTIONS, "SELECT uid, is_broadcast FROM connections")
SQL["agg8_volume"] = over(
    CONNECTIONS, "SELECT uid, duration, orig_pkts, resp_pkts, orig_bytes, resp_bytes FROM connections"
)
SQL["not1_suspicious_fc"] = over(
    MESSAGES,
    """
SELECT printf('%s-fc-%d', uid, fc) AS identifier, min(t_us) AS t_us,
  printf('Suspicious DNP3 function code 0x%02x from %s', fc, min(orig_h)) AS message
FROM messages WHERE fc IN (32, 33, 129, 130) GROUP BY uid, fc
""",
)
SQL["not2_broadcast_write"] = over(
    MESSAGES,
    """
SELECT uid || '-bcast' AS identifier, min(t_us) AS t_us, 'DNP3 broadcast WRITE from ' || min(orig_h) AS message
FROM messages WHERE resp_p = 20000 AND resp_h = '255.255.255.255' AND fc IN (2, 3) GROUP BY uid
""",
)
SQL["not3_flood"] = over(
    LINKS,
    """
SELECT uid || '-flood' AS identifier, t_us, orig_h, round((orig_pkts + resp_pkts) / duration + 1e-7::double, 4) AS rate
FROM links WHERE duration > 0 AND (orig_pkts + resp_pkts) / duration > 100
""",
)

# ---- link rules ----

_LINK_HITS = [
    ("broadcast_write", "critical", 0.95, "is_broadcast", "'DNP3 WRITE to broadcast address'"),
    ("high_fc_diversity", "medium", 0.55, "unique_fc_count > 6",
     "printf('%d unique function codes (max 6)', unique_fc_count)"),
    ("flooding", "high", 0.80, "duration > 0 AND (orig_pkts + resp_pkts) / duration > 50",
     "printf('%.1f pps exceeds threshold 50.0', (orig_pkts + resp_pkts) / duration)"),
    ("error_storm", "medium", 0.60,
     "orig_pkts + resp_pkts > 10 AND error_count > 0 AND error_count / (orig_pkts + resp_pkts) > 0.10::double",
     "printf('Error rate %.1f%%', error_count / (orig_pkts + resp_pkts) * 100)"),
    ("req_resp_imbalance", "low", 0.40,
     "response_count > 0 AND (request_count / response_count > 3 OR request_count / response_count < 1.0::double / 3)",
     "printf('Request/response ratio %.2f', request_count / response_count)"),
    ("burst_traffic", "medium", 0.50, "burst_count > 10",
     "printf('%d burst intervals detected', burst_count)"),
    ("machine_speed_pacing", "high", 0.75, "inter_arrival_mean > 0 AND inter_arrival_mean < 0.001",
     "printf('Inter-arrival mean %.4fms', inter_arrival_mean * 1000)"),
]
for _key, (_name, _sev, _score, _cond, _) in zip(
    ("zr1_broadcast_write", "zr2_fc_diversity", "zr3_flooding", "zr4_error_storm",
     "zr5_rr_imbalance", "zr6_burst", "zr7_machine_speed"),
    _LINK_HITS,
):
    SQL[_key] = over(
        LINKS,
        f"SELECT uid, '{_name}' AS rule_id, '{_sev}' AS severity, {_score}::double AS score FROM links WHERE {_cond}",
    )
_TOTAL = " + ".join(f"CASE WHEN {c} THEN {s}::double ELSE 0.0 END" for _, _, s, c, _ in _LINK_HITS)
_FIRED = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, _, c, _ in _LINK_HITS) + ")"
_LABEL = (
    "CASE WHEN s >= 0.80 THEN 'critical' WHEN s >= 0.60 THEN 'high' WHEN s >= 0.40 THEN 'medium' "
    "WHEN s >= 0.20 THEN 'low' ELSE 'normal' END"
)
_SCORED_LINKS = LINKS + f", summed AS (SELECT *, least({_TOTAL}, 1.0) AS s, {_FIRED} AS rules_fired FROM links)"
SQL["zr8_scores"] = over(
    _SCORED_LINKS,
    f"SELECT uid, t_us, orig_h, resp_h, rules_fired, round(s + 1e-9::double, 6) AS total_score, {_LABEL} AS severity FROM summed WHERE s > 0",
)
SQL["zr9_annotate"] = over(
    _SCORED_LINKS, f"SELECT uid, round(s + 1e-9::double, 6) AS anomaly_score, {_LABEL} AS anomaly_label FROM summed"
)
SQL["zr10_hits"] = over(
    LINKS,
    " UNION ALL ".join(
        f"SELECT uid, '{n}' AS rule_id, '{v}' AS severity, {d} AS description, {s}::double AS score FROM links WHERE {c}"
        for n, v, s, c, d in _LINK_HITS
    ),
)
SQL["not4_anomaly"] = over(
    _SCORED_LINKS,
    """
SELECT uid AS identifier, t_us, orig_h, resp_h, printf('ICS Anomaly score=%.2f rules=%s', s, rules_fired) AS message
FROM summed WHERE s >= 0.60
""",
)

# ---- scalar functions ----


def _flow(body: str) -> str:
    return over(FLOWS, f"SELECT uid, {body} FROM flows")


SQL["sc1_fc_class"] = _flow(
    "CASE WHEN function_code IN (19,129,130,131,132) THEN 'dangerous' WHEN function_code IN (14,15,22,23,24,25) THEN 'config' "
    "WHEN function_code IN (3,4,65,66,67) THEN 'control' WHEN function_code BETWEEN 0 AND 33 THEN 'safe' ELSE 'unknown' END AS fc_class"
)
SQL["sc2_safe_ratio"] = _flow(
    "CASE WHEN pkt_count - 10 > 0 THEN round(byte_count::double / (pkt_count - 10) + 1e-9::double, 6) ELSE -1.0 END AS ratio"
)
SQL["sc3_protocol"] = _flow("CASE WHEN dst_port IN (20000, 19999) THEN 1 ELSE 0 END AS protocol")
SQL["sc4_broadcast"] = _flow("CASE WHEN dst_ip LIKE '%.255' THEN 1 ELSE 0 END AS broadcast")
SQL["sc5_enrich"] = _flow(rnd("bytes_per_pkt", 6, "bytes_per_pkt"))
SQL["sc6_pps"] = _flow(
    "CASE WHEN pkt_count > 0 AND flow_duration > 0 THEN round(pkt_count / flow_duration + 1e-9::double, 6) END AS pps"
)
SQL["sc7_vector"] = _flow(
    "16 AS width, "
    + ", ".join(
        f"round({f} + 1e-9::double, 6) AS v{i:02d}" if i == 3 else f"{f}::double AS v{i:02d}"
        for i, f in enumerate(FEATURES)
    )
)

# bounds as the data model states them, in feature order
_BOUNDS = [
    (0, 3600), (1, 100000), (1, 10000000), (1, 65535), (0, 65535), (0, 65535), (0, 4), (0, 255),
    (1, 50), (0, 1), (0, 10000), (0, 10000), (0, 1), (0, 2), (0, 10000), (0, 1),
]
_WHOLE = {1, 2, 4, 5, 6, 7, 8, 12, 13, 14}


def _constrained(i: int, expr: str) -> str:
    low, high = _BOUNDS[i]
    clipped = f"greatest({low}.0::double, least({high}.0::double, {expr}))"
    return f"round_even({clipped}, 0)" if i in _WHOLE else clipped


SQL["sc8_clip_round"] = _flow(
    ", ".join(
        rnd(_constrained(i, f"({f}::double * 1.25::double - 0.5::double)"), 6, f)
        for i, f in enumerate(FEATURES)
    )
)
_SC10 = "CASE WHEN src_port % 7 = 0 THEN 'unheard' ELSE label END"
_IDS = "CASE {} WHEN 'scan' THEN 1 WHEN 'replay' THEN 2 WHEN 'command_injection' THEN 3 WHEN 'flooding' THEN 4 WHEN 'mitm' THEN 5 ELSE 0 END"
SQL["sc10_label_ids"] = _flow(
    _IDS.format(_SC10) + " AS label_id, CASE WHEN src_port % 7 = 0 THEN 'normal' ELSE label END AS label_name"
)
SQL["sc11_severity"] = _flow(
    "CASE WHEN req_resp_ratio >= 0.9 THEN 4 WHEN req_resp_ratio >= 0.75 THEN 3 WHEN req_resp_ratio >= 0.6 THEN 2 ELSE 1 END AS rule, "
    "CASE WHEN req_resp_ratio >= 0.75 THEN 3 WHEN req_resp_ratio >= 0.55 THEN 2 ELSE 1 END AS statistical, "
    "CASE WHEN req_resp_ratio >= 0.9 THEN 4 WHEN req_resp_ratio >= 0.75 THEN 3 WHEN req_resp_ratio >= 0.55 THEN 2 ELSE 1 END AS learned, "
    + _LABEL.replace("s >=", "req_resp_ratio >=") + " AS link"
)
SQL["sc12_escalation"] = _flow(
    "CASE WHEN req_resp_ratio < 0.3 THEN 'ignore' WHEN req_resp_ratio < 0.5 THEN 'monitor' WHEN req_resp_ratio <= 0.7 THEN 'alert' ELSE 'high_alert' END AS band"
)
SQL["sc13_split_label"] = _flow("CASE WHEN label = 'normal' THEN 'normal' ELSE 'attack' END AS side")

# ---- signature rules ----

_ATTACKS = {
    "broadcast_write": "command_injection", "unknown_function_code": "scan", "high_rate_scan": "scan",
    "config_change_fc": "command_injection", "timing_attack": "replay", "flooding": "flooding",
    "unusual_port": "mitm", "error_storm": "command_injection", "duplicate_unsolicited": "replay",
}
for _key, _name in (
    ("r1_broadcast_write", "broadcast_write"), ("r2_unknown_fc", "unknown_function_code"),
    ("r3_high_rate_scan", "high_rate_scan"), ("r4_config_change", "config_change_fc"),
    ("r5_timing", "timing_attack"), ("r6_flooding", "flooding"), ("r7_unusual_port", "unusual_port"),
    ("r8_error_storm", "error_storm"), ("r9_dup_unsolicited", "duplicate_unsolicited"),
):
    SQL[_key] = over(
        FLOW_MATCHES,
        f"SELECT uid, '{_name}' AS rule, {_name} AS confidence, '{_ATTACKS[_name]}' AS attack_type FROM hits WHERE {_name} IS NOT NULL",
    )
SQL["rd1_best_match"] = over(
    FLOW_MATCHES,
    """
SELECT uid, src_ip, dst_ip, rule_attack AS attack_type, rule_severity AS severity, rule_score AS confidence,
  rule_score AS score, 'rule:' || rule_name AS detector FROM best WHERE rule_score > 0
""",
)
SQL["rd2_score"] = over(FLOW_MATCHES, "SELECT uid, rule_score AS score FROM best")
SQL["rd3_hit_counts"] = over(
    FLOW_MATCHES,
    " UNION ALL ".join(f"SELECT '{n}' AS rule, count({n}) AS hits FROM hits" for n in _ATTACKS),
)
SQL["rd4_custom_rules"] = over(
    FLOW_MATCHES,
    """
, mine AS (
SELECT uid, CASE WHEN byte_count / pkt_count > 4000 THEN 0.55::double END AS large_packets,
  CASE WHEN try_cast(replace(src_ip, '10.0.0.', '') AS int) = 1 THEN 0.95::double END AS last_octet,
  broadcast_write, unknown_function_code FROM hits)
, top AS (SELECT *, greatest(large_packets, last_octet, broadcast_write, unknown_function_code) AS c FROM mine)
SELECT uid, CASE WHEN large_packets = c THEN 'mitm' WHEN last_octet = c THEN 'scan' WHEN broadcast_write = c THEN 'command_injection' ELSE 'scan' END AS attack_type,
  CASE WHEN c >= 0.9 THEN 4 WHEN c >= 0.75 THEN 3 WHEN c >= 0.6 THEN 2 ELSE 1 END AS severity, c AS confidence,
  'rule:' || CASE WHEN large_packets = c THEN 'large_packets' WHEN last_octet = c THEN 'last_octet' WHEN broadcast_write = c THEN 'broadcast_write' ELSE 'unknown_function_code' END AS detector
FROM top WHERE c IS NOT NULL
""",
)

# ---- statistics ----


def _prior(source: str, based: bool, key: str = "") -> str:
    """CTE `prior`: moments over the baseline and all earlier rows, merged as two sets."""
    part = f"PARTITION BY {key} " if key else ""
    frame = f"OVER ({part}ORDER BY ts_us, md5(uid), uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    n0 = "n" if based else "0"
    seen = ", ".join(
        f"coalesce(avg({f}::double) {frame}, 0.0) AS a_{f}, coalesce(var_pop({f}::double) {frame}, 0.0) AS b_{f}"
        for f in FEATURES
    )

    def moments(f: str) -> str:
        m0, v0 = (f"m_{f}", f"v_{f}") if based else ("0.0::double", "0.0::double")
        mean = f"CASE WHEN c = 0 THEN {m0} WHEN {n0} = 0 THEN a_{f} ELSE {m0} + (a_{f} - {m0}) * c / k END"
        m2 = f"({n0} * {v0} + c * b_{f} + CASE WHEN k > 0 THEN (a_{f} - {m0}) * (a_{f} - {m0}) * {n0} * c / k ELSE 0.0 END)"
        return (
            f"{mean} AS prior_mean_{f}, "
            f"CASE WHEN k > 1 THEN sqrt({m2} / k) ELSE 0.0 END AS prior_std_{f}"
        )

    base = (", n, " + ", ".join(f"m_{f}, v_{f}" for f in FEATURES)) if based else ""
    joined = f"{source}, base" if based else source
    return f"""
, seen AS (SELECT {source}.*{base}, (count(*) {frame})::double AS c, {seen} FROM {joined})
, sums AS (SELECT *, c + {n0} AS k FROM seen)
, prior AS (SELECT *, k AS prior_n, {', '.join(moments(f) for f in FEATURES)} FROM sums)
"""


_Z = (
    ", z AS (SELECT *, "
    + ", ".join(
        f"CASE WHEN prior_n >= 5 THEN ({f} - prior_mean_{f}) / (prior_std_{f} + 1e-9) ELSE 0.0 END AS z_{f}"
        for f in FEATURES
    )
    + " FROM prior)"
)
_COUNT = " + ".join(f"(abs(z_{f}) > 3.5)::int" for f in FEATURES)
_LARGEST = "greatest(" + ", ".join(f"abs(z_{f})" for f in FEATURES) + ")"
_OUTLYING = "concat_ws(',', " + ", ".join(f"CASE WHEN abs(z_{f}) > 3.5 THEN '{f}' END" for f in FEATURES) + ")"
_STAT = (
    _Z
    + f""", stat AS (
SELECT *, CASE WHEN big > 3.5 THEN 0.5 * (odd / 16) + 0.5 * least(big / 7.0, 1.0) ELSE 0.0 END AS z_score
FROM (SELECT *, {_COUNT} AS odd, {_LARGEST} AS big, {_OUTLYING} AS features FROM z))
, judged AS (
SELECT *, z_score AS stat_score, z_score >= 0.40 AS stat_fires,
  CASE WHEN z_score >= 0.40 THEN CASE WHEN abs(z_burst_count) > 3.5 THEN 'flooding'
    WHEN abs(z_function_code) > 3.5 OR abs(z_unique_fc_count) > 3.5 THEN 'command_injection'
    WHEN abs(z_inter_arrival_mean) > 3.5 THEN 'replay' ELSE 'scan' END END AS stat_attack,
  CASE WHEN z_score >= 0.75 THEN 3 WHEN z_score >= 0.55 THEN 2 WHEN z_score >= 0.40 THEN 1 END AS stat_severity
FROM stat)
"""
)
_PRIOR_LIST = ", ".join(
    rnd(f"prior_{kind}_{f}", 4, f"prior_{kind}_{f}") for kind in ("mean", "std") for f in FEATURES
)
_RUN = FLOWS + _BASE + _prior("flows", True)
_JUDGED = _RUN + _STAT

SQL["st1_running_moments"] = over(FLOWS + _prior("flows", False), f"SELECT uid, prior_n, {_PRIOR_LIST} FROM prior")
SQL["st2_zscore"] = over(
    _RUN + _Z, "SELECT uid, " + ", ".join(rnd(f"z_{f}", 4, f"z_{f}") for f in FEATURES) + " FROM z"
)
SQL["st3_baseline"] = over(FLOWS + _BASE, _BASE_ROWS)
SQL["st4_global_running"] = over(_RUN, f"SELECT uid, prior_n, {_PRIOR_LIST} FROM prior")
SQL["st5_zscore_score"] = over(_JUDGED, f"SELECT uid, {rnd('z_score', 6, 'z_score')}, features FROM stat")
SQL["st8_combined"] = over(
    _JUDGED, f"SELECT uid, {rnd('stat_score', 6, 'stat_score')}, stat_fires, stat_severity FROM judged"
)
# isolation forest: the same draws, level by level

_TREES, _SAMPLE, _DEPTH, _SEED = 100, 256, 8, 42
_PRIME = 2147483647
_X = "[" + ", ".join(f"{f}::double" for f in FEATURES) + "]"


def _hex(text: str, at: int = 1) -> str:
    return f"('0x' || substr(md5({text}), {at}, 7))::bigint"


def _drawn(what: str) -> str:
    return f"({_hex(f"concat('{_SEED}|', tree, '|', node, '|{what}')")} / 268435456.0::double)"


def _forest_tables() -> str:
    """CTEs `nodes`, `raw` (minus two to the minus mean path) and `placed` (the offset)."""
    factor = ", ".join(f"{_hex(f"concat('{_SEED}|', tree, '|{part}')")} + 1 AS f{part}" for part in "abcd")
    extremes = ", ".join(f"[{', '.join(f'{fn}(x[{i + 1}])' for i in range(16))}] AS {name}" for fn, name in (("min", "lo"), ("max", "hi")))
    sql = f"""
, vectors AS MATERIALIZED (SELECT uid, label, {_hex('uid')} AS ha, {_hex('uid', 8)} AS hb, {_X} AS x FROM flows)
, factors AS (SELECT tree, {factor} FROM range({_TREES}) t(tree))
, picks AS (SELECT tree, x, row_number() OVER (PARTITION BY tree
  ORDER BY (ha * fa + fb) % {_PRIME} * 2147483648 + (hb * fc + fd) % {_PRIME}, uid) AS place FROM vectors, factors WHERE label = 'normal')
, members0 AS MATERIALIZED (SELECT tree, 0::bigint AS node, x FROM picks WHERE place <= {_SAMPLE})
, used AS (SELECT max(n) AS sample, greatest(ceil(log2(greatest(max(n), 2))), 1)::int AS most FROM (SELECT count(*) AS n FROM members0 GROUP BY tree))
"""
    for d in range(_DEPTH + 1):
        sql += f"""
, boxes{d} AS (SELECT tree, node, count(*) AS size, {extremes} FROM members{d} GROUP BY tree, node)
, open{d} AS (SELECT *, list_filter(range(16), lambda i: hi[i + 1] > lo[i + 1]) AS usable FROM boxes{d})
, chosen{d} AS (SELECT *, CASE WHEN {d} < most AND size >= 2 AND len(usable) > 0
  THEN usable[floor({_drawn('feature')} * len(usable))::int + 1]::int ELSE -1 END AS feature FROM open{d}, used)
, nodes{d} AS MATERIALIZED (SELECT tree::int AS tree, node::int AS node, feature, {d} AS depth, size::int AS size,
  CASE WHEN feature >= 0 THEN lo[feature + 1] + {_drawn('split')} * (hi[feature + 1] - lo[feature + 1]) ELSE 0.0 END AS split FROM chosen{d})
"""
        if d < _DEPTH:
            sql += f"""
, members{d + 1} AS MATERIALIZED (SELECT m.tree, 2 * m.node + 1 + (x[feature + 1] > split)::int AS node, x
  FROM members{d} m JOIN nodes{d} n ON m.tree = n.tree AND m.node = n.node WHERE feature >= 0)
"""
    length = """
depth + CASE WHEN size > 2 THEN 2.0::double * (ln(size - 1.0::double) + 0.5772156649::double) - 2.0::double * (size - 1.0::double) / size
  WHEN size = 2 THEN 1.0 ELSE 0.0 END"""
    sql += ", nodes AS (" + " UNION ALL ".join(f"SELECT * FROM nodes{d}" for d in range(_DEPTH + 1)) + ")"
    sql += ", walk0 AS (SELECT uid, x, tree::int AS tree, 0 AS node FROM vectors, factors)"
    for d in range(_DEPTH):
        sql += f"""
, walk{d + 1} AS (SELECT uid, x, w.tree, CASE WHEN feature >= 0 THEN 2 * w.node + 1 + (x[feature + 1] > split)::int ELSE w.node END AS node
  FROM walk{d} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)
"""
    return sql + f"""
, norm AS (SELECT 2.0::double * (ln(sample - 1.0::double) + 0.5772156649::double) - 2.0::double * (sample - 1.0::double) / sample AS c FROM used)
, paths AS (SELECT uid, sum({length}) AS total FROM walk{_DEPTH} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY uid)
, raw AS MATERIALIZED (SELECT uid, -pow(2.0::double, -total / {_TREES}.0::double / c) AS s FROM paths, norm)
, placed AS (SELECT s AS edge FROM (SELECT s, row_number() OVER (ORDER BY s) AS place, count(*) OVER () AS n
  FROM raw JOIN vectors USING (uid) WHERE label = 'normal') WHERE place = ceil(n * 0.05::double))
, iforest AS (SELECT uid, greatest(0.0, least(1.0, 0.5 - (s - edge))) AS if_score FROM raw, placed)
"""


_FOREST = _forest_tables()
SQL["st6_iforest_fit"] = over(
    FLOWS + _FOREST,
    f"SELECT tree, node, feature, {rnd('split', 6, 'split')}, depth, size, sample::int AS sample, {rnd('edge', 6, 'offset')} FROM nodes, used, placed",
)
SQL["st7_iforest_score"] = over(FLOWS + _FOREST, f"SELECT uid, {rnd('if_score', 6, 'if_score')} FROM iforest")
SQL["st8_combined_forest"] = over(
    _JUDGED + _FOREST,
    f"""
, both_ AS (SELECT uid, 0.4::double * z_score + 0.6::double * if_score AS c FROM judged JOIN iforest USING (uid))
SELECT uid, {rnd('c', 6, 'stat_score')}, c >= 0.40 AS stat_fires,
  CASE WHEN c >= 0.75 THEN 3 WHEN c >= 0.55 THEN 2 WHEN c >= 0.40 THEN 1 END AS stat_severity FROM both_
""",
)

# z-scores and forest together
_MIXED_STAT = (
    _FOREST
    + """
, both_stat AS (SELECT stat.*, if_score, 0.4::double * z_score + 0.6::double * if_score AS combined FROM stat JOIN iforest USING (uid))
, judged3 AS (
SELECT * EXCLUDE (combined), combined AS stat_score, combined >= 0.40 AS stat_fires,
  CASE WHEN combined >= 0.40 THEN CASE WHEN abs(z_burst_count) > 3.5 THEN 'flooding'
    WHEN abs(z_function_code) > 3.5 OR abs(z_unique_fc_count) > 3.5 THEN 'command_injection'
    WHEN abs(z_inter_arrival_mean) > 3.5 THEN 'replay' ELSE 'scan' END END AS stat_attack,
  CASE WHEN combined >= 0.75 THEN 3 WHEN combined >= 0.55 THEN 2 WHEN combined >= 0.40 THEN 1 END AS stat_severity
FROM both_stat)
"""
)
SQL["st9_attack"] = over(
    _JUDGED + _MIXED_STAT,
    f"""
SELECT uid, ts_us, src_ip, dst_ip, stat_attack AS attack_type, stat_severity AS severity,
  {rnd('least(stat_score, 1.0)', 6, 'confidence')}, {rnd('stat_score', 6, 'score')}, 'statistical' AS detector, features,
  {rnd('z_score', 6, 'zscore')}, {rnd('if_score', 6, 'iforest')}, {rnd('stat_score', 6, 'combined')}
FROM judged3 WHERE stat_fires
""",
)

# ---- machine learning ----

_ALL = (
    ", whole AS (SELECT "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    + " FROM flows)"
)
SQL["ml1_scaler"] = over(
    FLOWS + _ALL,
    "SELECT uid, "
    + ", ".join(rnd(f"({f} - m_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END", 5, f) for f in FEATURES)
    + " FROM flows, whole",
)
_SHARES = FLOWS + ", shares AS (SELECT label, count(*) AS n FROM flows GROUP BY label)"
SQL["ml2_class_weights"] = over(
    _SHARES,
    "SELECT label, n, round((SELECT sum(n) FROM shares)::double / ((SELECT count(*) FROM shares) * n) + 1e-9::double, 6) AS weight FROM shares",
)
SQL["ml4_kfold"] = over(
    FLOWS,
    "SELECT uid, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(uid), uid) - 1) % 3)::int AS fold FROM flows",
)
# isotonic curves as the lower convex hull of the running sums: from each corner the hull goes
# on to the point of least slope, the furthest of several
SQL["ml5_pooling"] = over(
    FLOWS
    + """
, folded AS (SELECT ((row_number() OVER (PARTITION BY label ORDER BY md5(uid), uid) - 1) % 3)::int AS fold, label, (byte_count // 64) / 2048.0::double AS p FROM flows)
, classes AS (SELECT unnest(['normal', 'scan', 'replay', 'command_injection', 'flooding', 'mitm']) AS class)
, steps AS (SELECT fold, class, p, count(*) FILTER (label = class) AS hits, count(*) AS n FROM folded, classes GROUP BY ALL)
, sums AS MATERIALIZED (SELECT *, row_number() OVER w AS i, (sum(hits) OVER w)::bigint AS y, (sum(n) OVER w)::bigint AS x FROM steps
  WINDOW w AS (PARTITION BY fold, class ORDER BY p))
, hull AS (
SELECT DISTINCT fold, class, 0::bigint AS i, 0::bigint AS x, 0::bigint AS y FROM steps
UNION ALL
SELECT fold, class, best.i, best.x, best.y FROM (
  SELECT h.fold, h.class, arg_min({'i': s.i, 'x': s.x, 'y': s.y}, {'slope': (s.y - h.y) / (s.x - h.x), 'far': -s.i}) AS best
  FROM hull h JOIN sums s ON s.fold = h.fold AND s.class = h.class AND s.i > h.i GROUP BY h.fold, h.class))
, pools AS (SELECT *, lag(i) OVER w AS before, y - lag(y) OVER w AS hits, x - lag(x) OVER w AS n FROM hull WINDOW w AS (PARTITION BY fold, class ORDER BY i))
""",
    f"""
SELECT p.fold, p.class, {rnd('a.p', 9, 'low')}, {rnd('b.p', 9, 'high')}, p.hits, p.n, {rnd('p.hits / p.n', 9, 'share')}
FROM pools p JOIN sums a ON a.fold = p.fold AND a.class = p.class AND a.i = p.before + 1
  JOIN sums b ON b.fold = p.fold AND b.class = p.class AND b.i = p.i WHERE p.i > 0
""",
    recursive=True,
)
_REPORT = (
    BUSY_MATCHES
    + """
, preds AS (SELECT label, coalesce(rule_attack, 'normal') AS predicted FROM best)
, classes AS (SELECT label AS class FROM preds UNION SELECT predicted FROM preds)
, cells AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (predicted = class) AS guessed,
  count(*) FILTER (label = class AND predicted = class) AS tp FROM preds, classes GROUP BY class)
, pr AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cells)
, report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)
, lines AS (
SELECT class, precision, recall, f1, support FROM report
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM report
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM report
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM report)
"""
)
SQL["ml9_report"] = over(
    _REPORT,
    f"SELECT class, {rnd('precision', 6, 'precision')}, {rnd('recall', 6, 'recall')}, {rnd('f1', 6, 'f1')}, support::bigint AS support FROM lines",
)
SQL["ml10_split"] = over(
    FLOWS,
    """
SELECT uid, CASE WHEN row_number() OVER (ORDER BY md5(uid), uid) <= floor((SELECT count(*) FROM flows) * (1 - 0.2::double)) THEN 'train' ELSE 'test' END AS part FROM flows
""",
)
SQL["ml11_warmup"] = over(
    FLOWS,
    "SELECT uid, ts_us, label FROM flows ORDER BY ts_us, uid LIMIT (SELECT least(200, count(*) // 2) FROM flows)",
)
SQL["ml12_class_distribution"] = over(
    _SHARES, "SELECT label, n, round(100.0 * n / (SELECT sum(n) FROM shares) + 1e-7::double, 4) AS percent FROM shares"
)

# what must hold of learned models, whatever the trees: counts from the tables, the rest true
_FOLDS = FLOWS + ", dealt AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(uid), uid) - 1) % 3 AS fold FROM flows)"
SQL["ml3_training"] = over(
    _FOLDS,
    """
SELECT f::int AS fold, 200 AS trees, (SELECT count(DISTINCT label) FROM flows)::int AS classes,
  (SELECT count(*) FROM dealt WHERE fold <> f) AS training_rows, true AS grown FROM range(3) t(f)
""",
)
SQL["ml6_totals"] = over(
    FLOWS,
    """
SELECT label, count(*) AS n, count(*) AS sums_to_one, count(*) AS best_is_predicted, count(*) AS alert_fields_fit, true AS mostly_right
FROM flows GROUP BY label
""",
)
SQL["ml7_totals"] = over(
    FLOWS,
    """
SELECT count(*) AS n, count(*) AS in_range, count(*) AS without_a_model, true AS attacks_above_normal FROM flows
""",
)
SQL["ml8_top"] = "SELECT unnest(range(1, 6))::int AS place, true AS falling, true AS a_feature, true AS sums_to_one"
SQL["en5_totals"] = over(
    FLOWS,
    """
SELECT count(*) AS total, count(*) FILTER (label <> 'normal') AS attacks, count(*) FILTER (label = 'normal') AS normal,
  true AS detects, true AS few_false FROM flows
""",
)
SQL["ml9_holdout"] = over(
    FLOWS
    + """
, held AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY md5(uid), uid) AS place FROM flows)
  WHERE place > floor((SELECT count(*) FROM flows) * (1 - 0.2::double)))
""",
    """
SELECT label AS class, count(*) AS support, true AS accurate FROM held GROUP BY label
UNION ALL SELECT 'accuracy', count(*), true FROM held
UNION ALL SELECT 'macro avg', count(*), true FROM held
UNION ALL SELECT 'weighted avg', count(*), true FROM held
""",
)

# ---- ensemble ----

_P = "least(1.0::double, 0.1::double + error_rate * 0.6::double + burst_count / 2500.0::double)"
_THREE = (
    _STAT
    + _MIXED_STAT
    + f"""
, taught AS (SELECT *, {_P} AS ml_score, CASE WHEN burst_count > 500 THEN 'flooding' WHEN function_code >= 129 THEN 'scan'
  WHEN function_code IN (14, 19) THEN 'command_injection' ELSE 'normal' END AS learned FROM judged3)
, mixed AS (SELECT *, rule_score * 0.4::double + stat_score * 0.3::double + ml_score * 0.3::double AS ensemble_score,
  CASE WHEN rule_score >= stat_score AND rule_score >= ml_score THEN 'rule_based' WHEN stat_score >= ml_score THEN 'statistical' ELSE 'ml' END AS best_detector,
  CASE WHEN learned <> 'normal' AND ml_score >= 0.35 THEN learned END AS ml_attack,
  CASE WHEN ml_score >= 0.9 THEN 4 WHEN ml_score >= 0.75 THEN 3 WHEN ml_score >= 0.55 THEN 2 ELSE 1 END AS ml_severity FROM taught)
"""
)
_ENSEMBLE = FLOW_MATCHES + _BASE + _prior("best", True) + _THREE
SQL["en1_weights"] = over(
    _ENSEMBLE,
    """
SELECT 'rule_based' AS detector, round(avg(rule_score) + 1e-9::double, 6) AS mean_score, 0.5::double AS weight FROM mixed
UNION ALL SELECT 'statistical', round(avg(stat_score) + 1e-9::double, 6), 0.25 FROM mixed
UNION ALL SELECT 'ml', round(avg(ml_score) + 1e-9::double, 6), 0.25 FROM mixed
""",
)
SQL["en2_score"] = over(
    _ENSEMBLE, f"SELECT uid, {rnd('ensemble_score', 6, 'ensemble_score')}, ensemble_score >= 0.5 AS fired FROM mixed"
)
SQL["en3_best_detector"] = over(_ENSEMBLE, "SELECT uid, best_detector FROM mixed")
_OWN = """
  CASE WHEN best_detector = 'rule_based' AND rule_score > 0 THEN {0} WHEN best_detector = 'statistical' AND stat_fires THEN {1}
    WHEN best_detector = 'ml' AND ml_attack IS NOT NULL THEN {2} ELSE {3} END"""
_OWN_ATTACK = _OWN.format("rule_attack", "stat_attack", "ml_attack", "'scan'")
_OWN_SEVERITY = _OWN.format("rule_severity", "stat_severity", "ml_severity", "2")
_OWN_NAME = _OWN.format("'rule:' || rule_name", "'statistical'", "'ml:random_forest'", "'ensemble'")
SQL["en4_alerts"] = over(
    _ENSEMBLE,
    f"""
SELECT uid, ts_us, src_ip, dst_ip, {_OWN_ATTACK} AS attack_type, {_OWN_SEVERITY} AS severity, {_OWN_NAME} AS detector,
  {rnd('ensemble_score', 6, 'score')}, {rnd('least(ensemble_score * 1.1, 1.0)', 6, 'confidence')},
  least(ensemble_score * 1.1, 1.0) >= 0.7 AS high_confidence, rule_score AS rule_based, {rnd('stat_score', 6, 'statistical')},
  {rnd('ml_score', 6, 'ml')}
FROM mixed WHERE ensemble_score >= 0.5
""",
)
SQL["en6_batch"] = over(
    _ENSEMBLE,
    "SELECT uid, ensemble_score >= 0.5 AS alerted, CASE WHEN ensemble_score >= 0.5 THEN round(ensemble_score + 1e-9::double, 6) END AS score FROM mixed",
)
SQL["en7_stats"] = over(
    _ENSEMBLE,
    "SELECT count(*) AS total_flows, count(*) FILTER (ensemble_score >= 0.5) AS alerts, round(count(*) FILTER (ensemble_score >= 0.5) / count(*) + 1e-9::double, 6) AS alert_rate FROM mixed",
)

# ---- response ----

_BUSY_ALERTS = BUSY_MATCHES + _ALERTS


def _decided(safe: str) -> str:
    """CTE `decided` by walking each host's alerts in order."""
    return f"""{_BUSY_ALERTS}
, queue AS (SELECT *, {safe} AS safe, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, uid) AS rn FROM alerts)
, walk AS (
SELECT src_ip, rn, uid, CASE WHEN safe THEN ts_us END AS last, CASE WHEN safe THEN 'taken' ELSE 'unsafe' END AS status FROM queue WHERE rn = 1
UNION ALL
SELECT q.src_ip, q.rn, q.uid,
  CASE WHEN (w.last IS NULL OR q.ts_us - w.last >= 5000000) AND q.safe THEN q.ts_us ELSE w.last END,
  CASE WHEN w.last IS NOT NULL AND q.ts_us - w.last < 5000000 THEN 'cooldown' WHEN q.safe THEN 'taken' ELSE 'unsafe' END
FROM walk w JOIN queue q ON q.src_ip = w.src_ip AND q.rn = w.rn + 1)
, decided AS (
SELECT a.*, status = 'taken' AS success,
  CASE WHEN status = 'unsafe' THEN 'safety_constraint' WHEN status = 'cooldown' THEN 'cooldown' WHEN action = 'MONITOR' THEN 'log_only' ELSE '' END AS notes
FROM alerts a JOIN walk USING (uid))
"""


_SAFE = "NOT (action IN ('ISOLATE', 'BLOCK') AND (src_ip IN ('10.0.0.1', '10.0.0.10') OR dst_ip IN ('10.0.0.1', '10.0.0.10')))"
_DECIDED = _decided(_SAFE)
_RULE_ID = "CASE action WHEN 'RATE_LIMIT' THEN 'rl-' WHEN 'SEGMENT' THEN 'seg-' WHEN 'ISOLATE' THEN 'iso-' ELSE 'blk-' END || md5(uid)"
_LEDGER = (
    _DECIDED
    + f"""
, ledger AS (
SELECT {_RULE_ID} AS rule_id, src_ip AS match_src, CASE WHEN action IN ('SEGMENT', 'BLOCK') THEN dst_ip END AS match_dst,
  CASE action WHEN 'RATE_LIMIT' THEN 'rate_limit' WHEN 'SEGMENT' THEN 'reroute' ELSE 'drop' END AS rule,
  CASE action WHEN 'RATE_LIMIT' THEN 5000 WHEN 'SEGMENT' THEN 2000 WHEN 'ISOLATE' THEN 9000 ELSE 10000 END AS priority,
  CASE action WHEN 'BLOCK' THEN 0 ELSE 300 END AS idle_timeout,
  CASE action WHEN 'RATE_LIMIT' THEN 'rate_kbps=100' WHEN 'SEGMENT' THEN 'vlan=quarantine' ELSE '' END AS metadata,
  ts_us AS installed_us, uid
FROM decided WHERE success AND action <> 'MONITOR')
, expiring AS (SELECT *, CASE WHEN rule = 'drop' THEN installed_us + 300000000 END AS expires_us FROM ledger)
, aged AS (SELECT *, coalesce(expires_us < (SELECT max(installed_us) FROM ledger), false) AS expired FROM expiring)
"""
)
_REVOKED = (
    _LEDGER
    + """
, clears AS (SELECT src_ip AS host, ts_us AS t_us, uid FROM best WHERE rule_score = 0 AND function_code = 40)
, events_ AS (
SELECT match_src AS host, installed_us AS t_us, 0 AS kind, '0' || uid AS event, uid, rule_id, rule, priority, expires_us FROM expiring
UNION ALL SELECT host, t_us, 1, '1' || uid, uid, NULL, NULL, NULL, NULL FROM clears)
, chained AS (SELECT *, lag(kind) OVER w AS prev_kind, lag(rule_id) OVER w AS prev_rule, lag(expires_us) OVER w AS prev_end FROM events_
  WINDOW w AS (PARTITION BY host ORDER BY t_us, kind, md5(event)))
, tried AS (SELECT *, coalesce(prev_kind = 0 AND (prev_end IS NULL OR t_us <= prev_end), false) AS done FROM chained WHERE kind = 1)
, revoked AS (SELECT host, t_us, uid, done AS revoked, CASE WHEN done THEN prev_rule END AS rule_id FROM tried)
, resets AS (SELECT host, max(t_us) AS reset_us FROM revoked WHERE revoked GROUP BY host)
, live AS (SELECT match_src AS host, installed_us AS t_us, uid, rule, coalesce(installed_us > reset_us, true) AS live FROM ledger LEFT JOIN resets ON host = match_src)
, qos AS (SELECT host, 5.0::double + coalesce(sum(CASE rule WHEN 'rate_limit' THEN 2.0::double WHEN 'reroute' THEN 5.0 ELSE 0.0 END) FILTER (live), 0.0) AS latency_ms,
  0.0::double AS loss_pct,
  coalesce(arg_max(CASE rule WHEN 'drop' THEN 0 ELSE 100 END, (t_us, uid)) FILTER (live AND rule IN ('drop', 'rate_limit')), -1)::int AS rate_kbps
FROM live GROUP BY host)
"""
)
SQL["mt1_action"] = over(_BUSY_ALERTS, "SELECT uid, severity, action FROM alerts")
SQL["mt2_cooldown"] = over(
    _decided("true"), "SELECT uid, src_ip, ts_us, success, notes FROM decided", recursive=True
)
SQL["mt3_policy_rules"] = over(_LEDGER, "SELECT * FROM ledger", recursive=True)
SQL["mt4_safety"] = over(
    _DECIDED, "SELECT uid, src_ip, ts_us, action, success, notes FROM decided", recursive=True
)
SQL["mt4_ports"] = over(
    _decided(_SAFE.replace("AND (", "AND (uid IN (SELECT uid FROM best WHERE dst_port BETWEEN 49152 AND 49251) OR ")),
    "SELECT uid, src_ip, ts_us, action, success, notes FROM decided",
    recursive=True,
)
SQL["mt5_expiry"] = over(_LEDGER, "SELECT rule_id, uid, rule, expires_us, expired FROM aged", recursive=True)
SQL["mt6_active"] = over(
    _REVOKED,
    """
, clock AS (SELECT max(installed_us) AS now FROM ledger)
, newest AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t_us DESC, kind DESC, md5(event) DESC) AS place FROM events_, clock WHERE t_us <= now)
SELECT host, rule_id, rule, priority, t_us AS installed_us FROM newest
WHERE place = 1 AND kind = 0 AND (expires_us IS NULL OR now <= expires_us)
""",
    recursive=True,
)
SQL["mt7_revoke"] = over(_REVOKED, "SELECT * FROM revoked", recursive=True)
SQL["mt8_audit"] = over(
    _DECIDED,
    f"""
SELECT ts_us, action, src_ip AS target, attack_type, severity, success, CASE WHEN action <> 'MONITOR' THEN {_RULE_ID} END AS entry_id, notes, uid
FROM decided WHERE success
""",
    recursive=True,
)
SQL["mt9_host_qos"] = over(_REVOKED, "SELECT * FROM qos", recursive=True)
SQL["mt9_fleet_qos"] = over(
    _REVOKED,
    "SELECT count(*) AS hosts, round(avg(latency_ms) + 1e-9::double, 6) AS avg_latency_ms, round(avg(loss_pct) + 1e-9::double, 6) AS avg_loss_pct FROM qos",
    recursive=True,
)
_EVENT_ROWS = (
    _DECIDED
    + """
, shown AS (SELECT md5(uid) AS id, uid, ts_us, src_ip, dst_ip, attack_type, severity, round(confidence, 3) AS confidence,
  round(score, 3) AS score, CASE WHEN success THEN action ELSE 'BLOCKED' END AS action, success AS mitigated, label AS true_label FROM decided)
"""
)
SQL["mt10_alert_events"] = over(_EVENT_ROWS, "SELECT * FROM shown", recursive=True)

# ---- monitoring ----

SQL["mx1_confusion"] = over(_CONFUSION, "SELECT * FROM cm")
SQL["mx2_rates"] = over(
    _CONFUSION,
    "SELECT total, alerts, tp, fp, fn, tn, "
    + ", ".join(rnd(c, 6, c) for c in ("tpr", "fpr", "precision", "accuracy", "f1"))
    + " FROM full_rates",
)
SQL["mx3_counts"] = over(
    _BUSY_ALERTS,
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d}::varchar AS value, count(*) AS n FROM alerts GROUP BY 2"
        for d in ("severity", "attack_type", "action")
    ),
)
SQL["mx4_timeline"] = over(_TICKS, "SELECT * FROM line")
SQL["mx5_deltas"] = over(
    _TICKS,
    """
SELECT tick_us, round(coalesce(greatest(0.0, (alerts - lag(alerts) OVER w) / greatest(total - lag(total) OVER w, 1)), 0.0) + 1e-9::double, 6) AS delta
FROM line WINDOW w AS (ORDER BY tick_us)
""",
)
SQL["mx6_throughput"] = over(_TICKS, "SELECT tick_us, total::double AS flows_per_sec FROM ticks")
SQL["mx7_history"] = over(
    _EVENT_ROWS,
    """
SELECT (row_number() OVER (ORDER BY ts_us, uid))::int AS position, uid, ts_us, attack_type, action, mitigated
FROM (SELECT * FROM shown ORDER BY ts_us DESC, uid DESC LIMIT 50)
""",
    recursive=True,
)
SQL["mx8_running_rates"] = over(
    _OUTCOMES
    + """
, run AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (fired) OVER w AS a, count(*) FILTER (truth AND fired) OVER w AS tp,
  count(*) FILTER (truth AND NOT fired) OVER w AS fn, count(*) FILTER (NOT truth AND fired) OVER w AS fp,
  count(*) FILTER (NOT truth AND NOT fired) OVER w AS tn
FROM outcomes WINDOW w AS (ORDER BY ts_us, md5(uid), uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
""",
    """
SELECT uid, round(least(a / greatest(n, 1), 1.0) + 1e-9::double, 6) AS alert_rate, round(tp / greatest(tp + fn, 1) + 1e-9::double, 6) AS tpr,
  round(fp / greatest(fp + tn, 1) + 1e-9::double, 6) AS fpr, 0.9::double AS service_level, 0.0::double AS reserved,
  rule_score AS confidence, rule_score AS score, CASE WHEN rule_severity = 4 THEN 1.0::double ELSE 0.0 END AS is_critical
FROM run WHERE fired
""",
)
SQL["mx9_event_history"] = over(
    _DECIDED
    + """
, bus AS (
SELECT ts_us, uid, 'alert_generated' AS type, 'ids_pipeline' AS source, uid || '/0' AS event_id FROM decided
UNION ALL SELECT ts_us, uid, 'mitigation_applied', 'mitigation_engine', uid || '/1' FROM decided WHERE success)
""",
    """
SELECT * FROM bus WHERE type = 'mitigation_applied' AND ts_us >= (SELECT max(ts_us) FROM bus) - 30000000
ORDER BY ts_us DESC, event_id DESC LIMIT 100
""",
    recursive=True,
)
SQL["mx10_action_freq"] = over(
    _EVENT_ROWS, "SELECT action, count(*) AS n FROM shown GROUP BY action", recursive=True
)

# ---- augmentation ----


def _unit(*cells: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(cells)})), 1, 13))::bigint / 4503599627370496.0::double)"


def _normal(i: int) -> str:
    """Normal number i of a row copy: pairs from the halves of one digest per four."""
    text = f"md5(concat_ws('|', uid, copy, '{i - i % 4}'))"
    at = 1 if i % 4 < 2 else 17
    first, second = (
        f"(('0x' || substr({text}, {k}, 8))::bigint / 4294967296.0::double)" for k in (at, at + 8)
    )
    return (
        f"(sqrt(-2.0::double * ln({first} + {2.0**-33!r}::double))"
        f" * {'sin' if i % 2 else 'cos'}(6.283185307179586::double * {second}))"
    )


SQL["ga1_gaussian"] = over(
    FLOWS + _ALL,
    "SELECT uid || '#g' || copy AS id, label, "
    + ", ".join(
        rnd(
            _constrained(
                i, f"({f} + (0.08::double * (s_{f} + 1e-6::double)) * " + _normal(i) + ")"
            ),
            4,
            f,
        )
        for i, f in enumerate(FEATURES)
    )
    + " FROM flows, whole, (SELECT unnest([1, 2, 3]) AS copy)",
)
_MIX = f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(uid), uid) AS rank, count(*) OVER (PARTITION BY label) AS size FROM flows)
, drawn AS (SELECT r.*, copy, floor({_unit('uid', 'copy', "'partner'")} * size)::bigint + 1 AS partner,
  list_extract({beta_quantiles(0.4)}::double[], floor({_unit('uid', 'copy', "'mix'")} * 1024)::bigint + 1) AS share
  FROM ranked r, (SELECT unnest([1, 2]) AS copy))
"""
SQL["ga2_mixup"] = over(
    FLOWS + _MIX,
    "SELECT d.uid || '#m' || copy AS id, d.label, "
    + ", ".join(
        rnd(_constrained(i, f"(share * d.{f} + (1 - share) * o.{f})"), 5, f) for i, f in enumerate(FEATURES)
    )
    + " FROM drawn d JOIN ranked o ON o.label = d.label AND o.rank = d.partner",
)
_PROBES = """
probes AS (SELECT p_partkey AS id, p_size * p_size / 200.0::double AS flow_duration, p_size::double AS pkt_count,
  round(p_retailprice * 30) AS byte_count, round(p_retailprice * 30) / p_size AS bytes_per_pkt,
  (1024 + (p_partkey * 7919) % 64000)::double AS src_port, 20000.0::double AS dst_port, 1.0::double AS protocol_id,
  (p_partkey % 140)::double AS function_code, (p_partkey % 7 + 1)::double AS unique_fc_count, (p_partkey % 11)::double / 10 AS req_resp_ratio,
  (p_partkey % 100 * 20)::double AS inter_arrival_mean, (p_partkey % 7 * 10)::double AS inter_arrival_std,
  (p_partkey % 2)::double AS is_broadcast, (p_partkey % 3)::double AS direction, (p_partkey % 50)::double AS burst_count,
  (p_partkey % 9)::double / 10 AS error_rate FROM part)
"""
_D2 = " + ".join(f"(p.{f} - f.{f}) * (p.{f} - f.{f})" for f in FEATURES)


def _boundary() -> str:
    """Ten steps of the search over vectors x, each with its three candidates."""
    step = "[" + ", ".join(f"0.15::double * (sqrt(whole.v_{f}) + 1e-6::double)" for f in FEATURES) + "]"
    mean = "[" + ", ".join(f"base.m_{f}" for f in FEATURES) + "]"
    width = "[" + ", ".join(f"sqrt(base.v_{f}) + 1e-9::double" for f in FEATURES) + "]"
    everything = ", ".join(f"var_pop({f}::double) AS v_{f}" for f in FEATURES)
    sql = f"""
, whole AS (SELECT {everything} FROM flows)
, scale AS MATERIALIZED (SELECT {step} AS step, {mean} AS mean, {width} AS width FROM whole, base)
, at0 AS (SELECT uid, {_X} AS x FROM flows)
"""

    def score(x: str) -> str:
        z = f"list_transform(range(16), lambda i: abs(({x}[i + 1] - mean[i + 1]) / width[i + 1]))"
        return (
            f"(SELECT CASE WHEN big > 3.5 THEN 0.5 * (odd / 16) + 0.5 * least(big / 7.0, 1.0) ELSE 0.0 END + big / 100 "
            f"FROM (SELECT list_max(z) AS big, len(list_filter(z, lambda c: c > 3.5)) AS odd FROM (SELECT {z} AS z)))"
        )

    for k in range(10):
        side = lambda s: f"list_transform(range(16), lambda i: x[i + 1] + CASE WHEN i = pick THEN {s} * step[i + 1] ELSE 0.0::double END)"
        sql += f"""
, pick{k} AS (SELECT uid, x, floor({_unit('uid', f"'{k}'", "'feature'")} * 16)::int AS pick FROM at{k})
, three{k} AS (SELECT uid, x, {side('1.0::double')} AS up, {side('-1.0::double')} AS down, mean, width FROM pick{k}, scale)
, judged{k} AS (SELECT *, {score('x')} AS s, {score('up')} AS u, {score('down')} AS d FROM three{k})
, at{k + 1} AS MATERIALIZED (SELECT uid, CASE WHEN s <= u AND s <= d THEN x WHEN u <= d THEN up ELSE down END AS x FROM judged{k})
"""
    return sql


SQL["ga4_boundary"] = over(
    FLOWS + _BASE + _boundary(),
    "SELECT uid AS id, " + ", ".join(rnd(_constrained(i, f"x[{i + 1}]"), 3, f) for i, f in enumerate(FEATURES)) + " FROM at10",
)
SQL["ga5_nn_labels"] = over(
    FLOWS + ", " + _PROBES,
    f"""
, best AS (SELECT p.id, min(struct_pack(d2 := {_D2}, ref_id := f.uid, label := f.label)) AS b FROM probes p, flows f GROUP BY p.id)
SELECT id, b.ref_id AS ref_id, b.label AS label, round(b.d2 + 1e-6::double, 3) AS d2 FROM best
""",
)
SQL["ga7_upsample"] = over(_SHARES, "SELECT label, (SELECT max(n) FROM shares) AS n FROM shares")

# ---- policy evaluation ----

_EPISODES = """
decisions AS (
SELECT concat(l_suppkey, '-', l_linenumber) AS episode_id,
  (row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey))::int AS step,
  ((l_partkey + l_suppkey) % 5)::int AS action, l_partkey % 12 < 5 AS is_attack, (l_orderkey % 4 + 1)::int AS severity,
  0.5::double + (l_orderkey % 50) / 100.0::double AS confidence
FROM lineitem)
, numbered AS (SELECT *, ((step - 1) // 200)::int AS part FROM decisions)
, states AS (
SELECT episode_id, (n.part - 1)::int AS part, 0 AS step, 0 AS action, false AS is_attack, 0 AS severity, 0 AS alert_count,
  0.0::double AS avg_severity, 0.0::double AS avg_confidence, 0.0::double AS latency_ms, 0 AS isolated_hosts, 1.0::double AS qos, 1.0::double AS qos_before
FROM (SELECT DISTINCT episode_id, 0 AS part FROM numbered) n
UNION ALL
SELECT n.episode_id, n.part, n.step, n.action, n.is_attack, n.severity,
  CASE WHEN n.is_attack THEN least(c0 + 1, 100) ELSE greatest(c0 - 1, 0) END,
  CASE WHEN n.is_attack THEN 0.9::double * s0 + 0.1::double * n.severity ELSE 0.95::double * s0 END,
  CASE WHEN n.is_attack THEN 0.9::double * f0 + 0.1::double * n.confidence ELSE 0.95::double * f0 END,
  greatest(1.0, least(1000.0, CASE n.action WHEN 0 THEN greatest(5.0, l0 - 0.5) WHEN 1 THEN l0 + 2 WHEN 2 THEN l0 + 5 WHEN 3 THEN l0 + 10 ELSE l0 END))::double,
  CASE WHEN n.action = 3 THEN least(i0 + 1, 20) ELSE i0 END,
  greatest(0.0, least(1.0, q0 + CASE n.action WHEN 0 THEN 0.02::double WHEN 1 THEN -0.05 WHEN 2 THEN -0.10 WHEN 3 THEN -0.20 ELSE 0.0 END))::double, q0
FROM (SELECT n.*, fresh, CASE WHEN fresh THEN 0 ELSE s.alert_count END AS c0, CASE WHEN fresh THEN 0.0::double ELSE s.avg_severity END AS s0,
  CASE WHEN fresh THEN 0.0::double ELSE s.avg_confidence END AS f0, CASE WHEN fresh THEN 0.0::double ELSE s.latency_ms END AS l0,
  CASE WHEN fresh THEN 0 ELSE s.isolated_hosts END AS i0, CASE WHEN fresh THEN 1.0::double ELSE s.qos END AS q0
  FROM (SELECT *, part AS old FROM states) s JOIN (SELECT *, step % 200 = 1 AS fresh FROM numbered) n
  ON n.episode_id = s.episode_id AND n.step = s.step + 1) n)
, steps AS (SELECT * FROM states WHERE step > 0)
, paid AS (SELECT *, CASE WHEN is_attack AND action > 0 AND action >= severity THEN 'tp' WHEN is_attack THEN 'fn' WHEN action = 0 THEN 'tn' ELSE 'fp' END AS outcome,
  CASE WHEN is_attack AND action = 0 THEN -2.0::double WHEN is_attack AND action > severity + 1 THEN 1.7 WHEN is_attack AND action >= severity THEN 2.0
    WHEN is_attack THEN 0.5 WHEN action = 0 THEN 1.0 ELSE -1.0 END - 0.5 * (1.0 - qos_before) AS reward FROM steps)
, episodes AS (SELECT episode_id, part, count(*) AS total_steps, sum(reward) AS total_reward, avg(reward) AS mean_reward,
  count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (outcome = 'fn') AS fn,
  arg_max(qos, step) AS final_qos FROM paid GROUP BY episode_id, part)
"""
SQL["sc9_state_vector"] = over(
    _EPISODES,
    f"""
SELECT episode_id, part, step, {rnd('alert_count / 100.0::double', 6, 'v0')}, {rnd('avg_severity / 4', 6, 'v1')}, {rnd('avg_confidence', 6, 'v2')},
  {rnd('action / 4.0::double', 6, 'v3')}, {rnd('latency_ms / 1000', 6, 'v4')}, 0.0::double AS v5, {rnd('isolated_hosts / 20.0::double', 6, 'v6')}, {rnd('qos', 6, 'v7')}
FROM steps
""",
    recursive=True,
)
SQL["rl1_state"] = over(
    _EPISODES,
    f"""
SELECT episode_id, part, step, alert_count, {rnd('avg_severity', 6, 'avg_severity')}, {rnd('avg_confidence', 6, 'avg_confidence')}, action,
  {rnd('latency_ms', 6, 'latency_ms')}, isolated_hosts, {rnd('qos', 6, 'qos')} FROM steps
""",
    recursive=True,
)
SQL["rl2_reward"] = over(
    _EPISODES, f"SELECT episode_id, part, step, outcome, {rnd('reward', 6, 'reward')} FROM paid", recursive=True
)
SQL["rl3_summary"] = over(
    _EPISODES,
    f"""
SELECT episode_id, part, total_steps, {rnd('total_reward', 5, 'total_reward')}, {rnd('mean_reward', 5, 'mean_reward')}, tp, fp, tn, fn,
  {rnd('tp / greatest(tp + fp, 1)', 5, 'precision')}, {rnd('tp / greatest(tp + fn, 1)', 5, 'recall')}, {rnd('final_qos', 5, 'final_qos')} FROM episodes
""",
    recursive=True,
)
SQL["rl6_policy_eval"] = over(
    _EPISODES,
    f"""
SELECT {rnd('avg(total_reward)', 5, 'mean_reward')}, {rnd('stddev_pop(total_reward)', 5, 'std_reward')},
  {rnd('avg(tp / greatest(tp + fn, 1))', 5, 'mean_tpr')}, {rnd('avg(fp / greatest(fp + tn, 1))', 5, 'mean_fpr')} FROM episodes
""",
    recursive=True,
)
SQL["rl7_curve"] = """
SELECT (SELECT round(avg(value) + 1e-7::double, 4) FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 100)) AS mean_loss,
  (SELECT round(avg(o_totalprice) + 1e-7::double, 4) FROM (SELECT o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20)) AS mean_reward
"""

# ---- scenarios ----

_INDICATORS = [
    ("host_scan", "high_rate_scan", 2), ("host_scan", "unusual_port", 2),
    ("replay_attack", "duplicate_unsolicited", 2), ("replay_attack", "timing_attack", 2),
    ("command_injection", "broadcast_write", 3), ("command_injection", "config_change_fc", 3),
    ("command_injection", "unknown_function_code", 3), ("flooding_dos", "flooding", 2),
    ("flooding_dos", "error_storm", 2), ("mitm_manipulation", "error_storm", 1),
]
SQL["sn1_coverage"] = over(
    FLOW_MATCHES,
    ", seen AS ("
    + " UNION ".join(f"SELECT DISTINCT src_ip, '{n}' AS rule FROM hits WHERE {n} IS NOT NULL" for n in _ATTACKS)
    + ") SELECT src_ip, scenario, count(*) AS matched, round(count(*) / min(size)::double + 1e-9::double, 6) AS coverage FROM seen JOIN (VALUES "
    + ", ".join(f"('{s}', '{r}', {k})" for s, r, k in _INDICATORS)
    + ") AS i(scenario, rule, size) USING (rule) GROUP BY src_ip, scenario",
)
SQL["sn2_stages"] = """
SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',round(l_extendedprice * 100)::bigint) AS uid, (l_orderkey % 420)::int AS step, stage, attack_type
FROM lineitem JOIN (VALUES (1, 0, 100, 'scan'), (2, 80, 200, 'replay'), (3, 180, 300, 'command_injection'), (4, 280, 400, 'flooding')) AS s(stage, lo, hi, attack_type)
ON l_orderkey % 420 >= lo AND l_orderkey % 420 < hi
"""

# what must hold of drawn rows: how many there are, all within the bounds, no value missing
SQL["ga3_totals"] = over(
    FLOWS,
    "SELECT greatest(50, count(*) // 2) AS n, greatest(50, count(*) // 2) AS within_bounds, true AS means_near FROM flows",
)
SQL["ga6_totals"] = over(
    FLOWS,
    """
, n AS (SELECT count(*) AS n FROM flows)
SELECT kind, CASE kind WHEN 'noise' THEN 3 * n WHEN 'latent' THEN greatest(50, n // 2) ELSE n END AS n,
  CASE kind WHEN 'noise' THEN 3 * n WHEN 'latent' THEN greatest(50, n // 2) ELSE n END AS labelled
FROM n, (SELECT unnest(['given', 'noise', 'mixed', 'latent', 'searched']) AS kind)
""",
)

# ---- streaming ----

_FROZEN = (
    FLOW_MATCHES
    + _BASE
    + ", prior AS (SELECT best.*, n::double AS prior_n, "
    + ", ".join(f"m_{f} AS prior_mean_{f}, sqrt(v_{f}) AS prior_std_{f}" for f in FEATURES)
    + " FROM best, base)"
    + _THREE
)
SQL["str1_detect"] = over(
    _FROZEN,
    f"""
SELECT uid, {_OWN_ATTACK} AS attack_type, {_OWN_SEVERITY} AS severity, {_OWN_NAME} AS detector, {rnd('ensemble_score', 6, 'score')}
FROM mixed WHERE ensemble_score >= 0.5
""",
)
SQL["str2_moments"] = over(
    BUSY_FLOWS + _BASE + _prior("busy", True, "src_ip") + _STAT,
    f"SELECT uid, src_ip, prior_n, {rnd('z_score', 6, 'z_score')} FROM stat",
)
SQL["str3_cooldown"] = SQL["mt4_safety"]
SQL["str4_expiry"] = over(
    _LEDGER, "SELECT rule_id, match_src AS host, expires_us FROM expiring WHERE rule = 'drop'", recursive=True
)
SQL["str5_sessions"] = over(
    CONNECTIONS,
    f"SELECT uid, duration, orig_pkts, resp_pkts, unique_fc_count, burst_count, {_MEAN}, {_STD} FROM connections",
)
SQL["str6_ticks"] = over(_TICKS, "SELECT * FROM ticks")
SQL["str7_suppress"] = over(
    CONNECTIONS + f", summed AS (SELECT *, least({_TOTAL}, 1.0) AS s FROM connections)",
    """
SELECT DISTINCT printf('%s-fc-%d', uid, fc) AS identifier FROM messages WHERE fc IN (32, 33, 129, 130)
UNION ALL
SELECT DISTINCT uid || '-bcast' FROM messages WHERE resp_p = 20000 AND resp_h = '255.255.255.255' AND fc IN (2, 3)
UNION ALL
SELECT uid || '-flood' FROM connections WHERE duration > 0 AND (orig_pkts + resp_pkts) / duration > 100
UNION ALL
SELECT uid FROM summed WHERE s >= 0.60
""",
)

SQL["flagship"] = over(
    FLOW_MATCHES,
    f"""
SELECT rule_attack AS attack_type, rule_severity AS severity, {_ACTION.replace('severity', 'rule_severity')} AS action,
  count(*) AS alerts, count(DISTINCT src_ip) AS sources FROM best WHERE rule_score > 0 GROUP BY 1, 2, 3
""",
)

"""The fixture tables again, written independently in DuckDB SQL."""

FLOWS = """
flows AS (
SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey,'-',round(l_extendedprice * 100)::bigint) AS uid,
  epoch_us(l_shipdate) + (l_orderkey*37 + l_linenumber*7) % 86400 * 1000000 AS ts_us,
  CASE WHEN l_suppkey % 6 = 0 THEN '10.0.0.1' ELSE concat('10.0.', l_suppkey % 4 + 2, '.', l_suppkey % 254 + 1) END AS src_ip,
  CASE WHEN l_partkey % 11 = 0 THEN '10.0.1.255' ELSE concat('10.0.1.', l_partkey % 8 + 1) END AS dst_ip,
  l_quantity * l_quantity / 200.0::double AS flow_duration,
  cast(CASE WHEN l_partkey % 9 = 4 THEN l_quantity * 100 ELSE l_quantity END AS int) AS pkt_count,
  cast(round(l_extendedprice) AS bigint) AS byte_count,
  cast(round(l_extendedprice) AS double) / cast(CASE WHEN l_partkey % 9 = 4 THEN l_quantity * 100 ELSE l_quantity END AS double) AS bytes_per_pkt,
  cast(CASE WHEN l_partkey % 13 = 0 THEN l_orderkey % 1023 + 1 ELSE 1024 + (l_orderkey * 7919) % 64000 END AS int) AS src_port,
  cast(CASE WHEN l_linenumber % 5 = 4 THEN 49152 + l_orderkey % 1000 ELSE 20000 END AS int) AS dst_port,
  cast(CASE WHEN l_suppkey % 10 = 9 THEN 0 ELSE 1 END AS int) AS protocol_id,
  cast(CASE l_partkey % 12 WHEN 0 THEN 3 WHEN 1 THEN 19 WHEN 2 THEN 130 WHEN 3 THEN 14 WHEN 4 THEN 150 WHEN 5 THEN 129 WHEN 6 THEN 65 WHEN 7 THEN 40 ELSE 1 END AS int) AS function_code,
  cast(l_suppkey % 7 + 1 AS int) AS unique_fc_count,
  round(l_discount * 10, 4) AS req_resp_ratio,
  cast((l_orderkey % 100) * 20 AS double) AS inter_arrival_mean,
  cast(l_linenumber * 10 AS double) AS inter_arrival_std,
  cast(CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS int) AS is_broadcast,
  cast(l_suppkey % 3 AS int) AS direction,
  cast(CASE WHEN l_partkey % 9 = 4 THEN l_quantity * 25 ELSE l_linenumber END AS int) AS burst_count,
  round(l_tax * 10, 4) AS error_rate,
  CASE l_partkey % 12 WHEN 0 THEN 'command_injection' WHEN 1 THEN 'replay' WHEN 2 THEN 'replay' WHEN 3 THEN 'command_injection' WHEN 4 THEN 'scan' ELSE CASE WHEN l_partkey % 9 = 4 THEN 'flooding' WHEN l_partkey % 13 = 0 THEN 'mitm' ELSE 'normal' END END AS label
FROM lineitem)
"""

BUSY_FLOWS = FLOWS + ", busy AS (SELECT * REPLACE (ts_us // 100000 AS ts_us) FROM flows)"

MESSAGES = """
messages AS (
SELECT event_id, concat('C', user_id, '-', weekofyear(ts)) AS uid,
  epoch_us(ts) // 100000 AS t_us,
  concat('10.0.2.', user_id % 254 + 1) AS orig_h,
  CASE WHEN user_id % 7 = 0 THEN '255.255.255.255' ELSE concat('10.0.1.', user_id % 8 + 1) END AS resp_h,
  cast(CASE WHEN user_id % 10 = 9 THEN 502 ELSE 20000 END AS int) AS resp_p,
  cast(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN event_id % 40 ELSE 129 + event_id % 2 END AS int) AS fc,
  event_type <> 'signup' AS is_orig,
  event_type = 'error' AS is_error,
  cast(round(value) AS bigint) AS bytes
FROM events)
"""

# one row per connection, from the messages
CONNECTIONS = (
    MESSAGES
    + """
, gaps AS (
SELECT *, (t_us - lag(t_us) OVER (PARTITION BY uid ORDER BY t_us)) / 1000000.0::double AS gap
FROM messages)
, connections AS (
SELECT uid, min(t_us) AS t_us, min(orig_h) AS orig_h, min(resp_h) AS resp_h, min(resp_p) AS resp_p,
  (max(t_us) - min(t_us)) / 1000000.0::double AS duration,
  count(*) FILTER (is_orig) AS orig_pkts, count(*) FILTER (NOT is_orig) AS resp_pkts,
  coalesce(sum(bytes) FILTER (is_orig), 0)::bigint AS orig_bytes,
  coalesce(sum(bytes) FILTER (NOT is_orig), 0)::bigint AS resp_bytes,
  list_sort(list(DISTINCT fc)) AS function_codes, count(DISTINCT fc) AS unique_fc_count,
  count(*) FILTER (is_orig) AS request_count, count(*) FILTER (NOT is_orig) AS response_count,
  bool_or(resp_p = 20000 AND resp_h = '255.255.255.255') AS is_broadcast,
  coalesce(avg(gap), 0.0) AS inter_arrival_mean, coalesce(stddev_pop(gap), 0.0) AS inter_arrival_std,
  count(*) FILTER (gap < 0.1) AS burst_count, count(*) FILTER (is_error) AS error_count
FROM gaps GROUP BY uid)
"""
)

LINKS = (
    FLOWS
    + ", "
    + CONNECTIONS
    + """
, summaries AS (
SELECT ts_us AS t_us, uid, src_ip AS orig_h, dst_ip AS resp_h, dst_port AS resp_p, flow_duration AS duration,
  (pkt_count - pkt_count // 3)::bigint AS orig_pkts, (pkt_count // 3)::bigint AS resp_pkts,
  byte_count - byte_count // 3 AS orig_bytes, byte_count // 3 AS resp_bytes,
  unique_fc_count::bigint AS unique_fc_count, (pkt_count // 2)::bigint AS request_count,
  (pkt_count // (direction * 3 + 1))::bigint AS response_count, is_broadcast = 1 AS is_broadcast,
  inter_arrival_mean / 25000.0::double AS inter_arrival_mean, inter_arrival_std / 1000.0::double AS inter_arrival_std,
  burst_count::bigint AS burst_count, floor(round(error_rate * 10) * pkt_count / 40)::bigint AS error_count
FROM flows)
, links AS (
SELECT t_us, uid, orig_h, resp_h, duration, orig_pkts, resp_pkts, unique_fc_count, request_count, response_count,
  is_broadcast, inter_arrival_mean, inter_arrival_std, burst_count, error_count FROM connections
UNION ALL
SELECT t_us, uid, orig_h, resp_h, duration, orig_pkts, resp_pkts, unique_fc_count, request_count, response_count,
  is_broadcast, inter_arrival_mean, inter_arrival_std, burst_count, error_count FROM summaries)
"""
)

# rule hits on flows: one nullable confidence per rule, then the best of them
_RULES = """
SELECT *,
  CASE WHEN is_broadcast <> 0 AND function_code IN (3,4,65,66,67,81) THEN 0.90::double END AS broadcast_write,
  CASE WHEN protocol_id = 1 AND function_code > 131 THEN 0.80::double END AS unknown_function_code,
  CASE WHEN flow_duration < 0.5 AND pkt_count > 20 THEN 0.75::double END AS high_rate_scan,
  CASE WHEN protocol_id = 1 AND function_code IN (14,15,22,23,24,25) THEN 0.85::double END AS config_change_fc,
  CASE WHEN function_code = 19 AND pkt_count > 1 THEN 0.70::double END AS timing_attack,
  CASE WHEN burst_count > 500 THEN 0.85::double WHEN pkt_count > 0 AND flow_duration > 0 AND pkt_count / flow_duration > 1000 THEN 0.80::double END AS flooding,
  CASE WHEN dst_port IN (20000,19999) AND src_port < 1024 THEN 0.60::double END AS unusual_port,
  CASE WHEN error_rate > 0.5 AND pkt_count > 10 THEN 0.65::double END AS error_storm,
  CASE WHEN function_code = 130 AND pkt_count > 5 AND req_resp_ratio < 0.1 THEN 0.80::double END AS duplicate_unsolicited
"""


def matched(source: str) -> str:
    """CTEs `hits` and `best` over one of the flow tables."""
    names = [
        ("broadcast_write", "command_injection"),
        ("unknown_function_code", "scan"),
        ("high_rate_scan", "scan"),
        ("config_change_fc", "command_injection"),
        ("timing_attack", "replay"),
        ("flooding", "flooding"),
        ("unusual_port", "mitm"),
        ("error_storm", "command_injection"),
        ("duplicate_unsolicited", "replay"),
    ]
    top = "coalesce(greatest(" + ", ".join(n for n, _ in names) + "), 0.0)"
    pick = " ".join(f"WHEN {n} = rule_score THEN '{n}'" for n, _ in names)
    kind = " ".join(f"WHEN {n} = rule_score THEN '{a}'" for n, a in names)
    return f"""
hits AS ({_RULES} FROM {source})
, best AS (
SELECT *, CASE {pick} END AS rule_name, CASE {kind} END AS rule_attack,
  CASE WHEN rule_score >= 0.90 THEN 4 WHEN rule_score >= 0.75 THEN 3 WHEN rule_score >= 0.60 THEN 2 WHEN rule_score > 0 THEN 1 END AS rule_severity
FROM (SELECT *, {top} AS rule_score FROM hits))
"""


FLOW_MATCHES = FLOWS + ", " + matched("flows")
BUSY_MATCHES = BUSY_FLOWS + ", " + matched("busy")

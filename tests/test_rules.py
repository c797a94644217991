"""Rows just inside and just outside every rule limit."""

import re

import pytest
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators import link_rules as L
from flowwarden.operators import signatures as D
from flowwarden.plans import catalog

DATA = "/root/testdata/sf0.001"
QUIET = {
    "flow_duration": 1.0, "pkt_count": 5, "byte_count": 500, "bytes_per_pkt": 100.0,
    "src_port": 40000, "dst_port": 20000, "protocol_id": 1, "function_code": 1,
    "unique_fc_count": 1, "req_resp_ratio": 0.5, "inter_arrival_mean": 1000.0,
    "inter_arrival_std": 10.0, "is_broadcast": 0, "direction": 0, "burst_count": 1,
    "error_rate": 0.0,
}

CASES = [
    ({}, None),
    ({"is_broadcast": 1, "function_code": 81}, "broadcast_write"),
    ({"is_broadcast": 1, "function_code": 2}, None),
    ({"function_code": 132}, "unknown_function_code"),
    ({"function_code": 131}, None),
    ({"function_code": 200, "protocol_id": 2}, None),
    ({"flow_duration": 0.49, "pkt_count": 21}, "high_rate_scan"),
    ({"flow_duration": 0.5, "pkt_count": 21}, None),
    ({"flow_duration": 0.49, "pkt_count": 20}, None),
    ({"flow_duration": 0.0, "pkt_count": 21}, "high_rate_scan"),
    ({"function_code": 25}, "config_change_fc"),
    ({"function_code": 16}, None),
    ({"function_code": 19, "pkt_count": 2}, "timing_attack"),
    ({"function_code": 19, "pkt_count": 1}, None),
    ({"burst_count": 501}, "flooding"),
    ({"burst_count": 500}, None),
    ({"pkt_count": 1001}, "flooding"),
    ({"pkt_count": 1000}, None),
    ({"src_port": 1023}, "unusual_port"),
    ({"src_port": 1024}, None),
    ({"src_port": 1023, "dst_port": 502}, None),
    ({"error_rate": 0.51, "pkt_count": 11}, "error_storm"),
    ({"error_rate": 0.5, "pkt_count": 11}, None),
    ({"error_rate": 0.51, "pkt_count": 10}, None),
    ({"function_code": 130, "pkt_count": 6, "req_resp_ratio": 0.09}, "duplicate_unsolicited"),
    ({"function_code": 130, "pkt_count": 5, "req_resp_ratio": 0.09}, None),
    ({"function_code": 130, "pkt_count": 6, "req_resp_ratio": 0.1}, None),
    # equal confidence: the earlier rule wins; a stronger one wins over an earlier one
    ({"function_code": 14, "burst_count": 501}, "config_change_fc"),
    ({"src_port": 80, "burst_count": 501}, "flooding"),
]


def test_signature_limits(spark):
    rows = [
        (f"u{i}", 0, "10.0.0.2", "10.0.0.3", *[{**QUIET, **c}[f] for f in S.FEATURES], "normal")
        for i, (c, _) in enumerate(CASES)
    ]
    found = D.best_match(spark.createDataFrame(rows, S.FLOWS))
    names = {r["uid"]: r["rule_name"] for r in found.collect()}
    assert [names[f"u{i}"] for i in range(len(CASES))] == [n for _, n in CASES]


LINK = {
    "duration": 10.0, "orig_pkts": 6, "resp_pkts": 6, "unique_fc_count": 2, "request_count": 6,
    "response_count": 6, "is_broadcast": False, "inter_arrival_mean": 1.0, "burst_count": 0,
    "error_count": 0,
}
LINK_CASES = [
    ({}, ""),
    ({"is_broadcast": True}, "broadcast_write"),
    ({"unique_fc_count": 7}, "high_fc_diversity"),
    ({"unique_fc_count": 6}, ""),
    ({"orig_pkts": 501, "resp_pkts": 0}, "flooding"),
    ({"orig_pkts": 500, "resp_pkts": 0}, ""),
    ({"duration": 0.0, "orig_pkts": 501}, ""),
    ({"error_count": 2}, "error_storm"),
    ({"error_count": 1}, ""),
    ({"error_count": 9, "orig_pkts": 5, "resp_pkts": 5}, ""),
    ({"request_count": 19}, "req_resp_imbalance"),
    ({"request_count": 18}, ""),
    ({"request_count": 1, "response_count": 4}, "req_resp_imbalance"),
    ({"request_count": 2}, ""),
    ({"response_count": 0}, ""),
    ({"burst_count": 11}, "burst_traffic"),
    ({"burst_count": 10}, ""),
    ({"inter_arrival_mean": 0.0009}, "machine_speed_pacing"),
    ({"inter_arrival_mean": 0.001}, ""),
    ({"inter_arrival_mean": 0.0}, ""),
    ({"is_broadcast": True, "burst_count": 11}, "broadcast_write,burst_traffic"),
]


@pytest.fixture(scope="module")
def links(spark):
    schema = (
        "uid string, t_us bigint, orig_h string, resp_h string, duration double, orig_pkts bigint, "
        "resp_pkts bigint, unique_fc_count bigint, request_count bigint, response_count bigint, "
        "is_broadcast boolean, inter_arrival_mean double, burst_count bigint, error_count bigint"
    )
    rows = [
        (f"u{i}", 0, "a", "b", *{**LINK, **c}.values()) for i, (c, _) in enumerate(LINK_CASES)
    ]
    return spark.createDataFrame(rows, schema)


def test_link_limits(links):
    found = {r["uid"]: ",".join(r["rules_fired"]) for r in L.anomaly_records(links).collect()}
    assert [found.get(f"u{i}", "") for i in range(len(LINK_CASES))] == [n for _, n in LINK_CASES]


def test_link_score_is_capped(links):
    scores = [r["anomaly_score"] for r in L.annotate(links).collect()]
    assert max(scores) == 1.0 and min(scores) == 0.0
    assert L.annotate(links).where("anomaly_score = 0 AND anomaly_label <> 'normal'").count() == 0


def test_rule_matching_stays_within_methods_that_the_jvm_compiles(spark):
    """HotSpot leaves methods of more than 8,000 bytes of code to its interpreter."""
    show = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString
    for found in (catalog.busy_alerts(spark, DATA), catalog.outcomes(spark, DATA)):
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", show(found._jdf.queryExecution().executedPlan()))
        assert all(int(s) <= 8000 for s in sizes), sizes


def test_equal_rules_go_by_place_and_rules_that_fail_do_not_win(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 0.5), (3, None)], "uid int, x double")
    def rule(name, least, confidence):
        return D.Signature(name, name.upper(), D.when_true(lambda: F.col("x") > least, confidence))
    rules = [rule("low", 0.1, 0.4), rule("first", 1.0, 0.9), rule("second", 1.0, 0.9), rule("nothing", 0.0, 0.0)]
    found = {r["uid"]: (r["rule_score"], r["rule_name"], r["rule_attack"]) for r in D.best_match(rows, rules).collect()}
    assert found == {1: (0.9, "first", "FIRST"), 2: (0.4, "low", "LOW"), 3: (0.0, None, None)}
    assert D.best_match(rows, []).where("rule_score = 0 AND rule_name IS NULL").count() == 3

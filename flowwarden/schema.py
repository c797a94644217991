"""Enumerations, thresholds and table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the feature order and its units are part of the data model ---
FEATURES = [
    "flow_duration",  # seconds
    "pkt_count",
    "byte_count",
    "bytes_per_pkt",
    "src_port",
    "dst_port",
    "protocol_id",
    "function_code",
    "unique_fc_count",
    "req_resp_ratio",
    "inter_arrival_mean",  # milliseconds
    "inter_arrival_std",  # milliseconds
    "is_broadcast",
    "direction",
    "burst_count",
    "error_rate",
]

# --- fixed values: valid range of every feature, (low, high) ---
FEATURE_BOUNDS = {
    "flow_duration": (0.0, 3600.0),
    "pkt_count": (1.0, 100000.0),
    "byte_count": (1.0, 10000000.0),
    "bytes_per_pkt": (1.0, 65535.0),
    "src_port": (0.0, 65535.0),
    "dst_port": (0.0, 65535.0),
    "protocol_id": (0.0, 4.0),
    "function_code": (0.0, 255.0),
    "unique_fc_count": (1.0, 50.0),
    "req_resp_ratio": (0.0, 1.0),
    "inter_arrival_mean": (0.0, 10000.0),
    "inter_arrival_std": (0.0, 10000.0),
    "is_broadcast": (0.0, 1.0),
    "direction": (0.0, 2.0),
    "burst_count": (0.0, 10000.0),
    "error_rate": (0.0, 1.0),
}

# --- fixed values: features that stay whole numbers ---
INTEGER_FEATURES = [
    "pkt_count",
    "byte_count",
    "src_port",
    "dst_port",
    "protocol_id",
    "function_code",
    "unique_fc_count",
    "is_broadcast",
    "direction",
    "burst_count",
]

# --- fixed values: enumerations ---
PROTOCOLS = {"UNKNOWN": 0, "DNP3": 1, "MODBUS": 2, "IEC104": 3, "S7COMM": 4}
LABELS = ["normal", "scan", "replay", "command_injection", "flooding", "mitm"]
SEVERITIES = {"low": 1, "medium": 2, "high": 3, "critical": 4}
ACTIONS = ["MONITOR", "RATE_LIMIT", "SEGMENT", "ISOLATE", "BLOCK"]
SEVERITY_ACTION = {1: "MONITOR", 2: "SEGMENT", 3: "RATE_LIMIT", 4: "ISOLATE"}

# --- fixed values: ports and function-code groups ---
DNP3_PORTS = [20000, 19999]
FC_DANGEROUS = [19, 129, 130, 131, 132]
FC_CONFIG = [14, 15, 22, 23, 24, 25]
FC_CONTROL = [3, 4, 65, 66, 67]
FC_SAFE_MAX = 33
FC_SUSPICIOUS = [32, 33, 129, 130]

# --- fixed values: ensemble ---
ENSEMBLE_WEIGHTS = {"rule_based": 0.40, "statistical": 0.30, "ml": 0.30}
ALERT_THRESHOLD = 0.50
Z_THRESHOLD = 3.5

_FEATURE_TYPES = {
    "byte_count": T.LongType(),
    "flow_duration": T.DoubleType(),
    "bytes_per_pkt": T.DoubleType(),
    "req_resp_ratio": T.DoubleType(),
    "inter_arrival_mean": T.DoubleType(),
    "inter_arrival_std": T.DoubleType(),
    "error_rate": T.DoubleType(),
}

FEATURE_FIELDS = [
    T.StructField(f, _FEATURE_TYPES.get(f, T.IntegerType())) for f in FEATURES
]

FLOWS = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        *FEATURE_FIELDS,
        T.StructField("label", T.StringType()),
    ]
)

DATASET = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in FEATURES]
    + [T.StructField("label", T.StringType())]
)

CONNECTION_LOG = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "uid",
            "ts",
            "id.orig_h",
            "id.resp_h",
            "id.orig_p",
            "id.resp_p",
            "duration",
            "orig_pkts",
            "resp_pkts",
            "orig_bytes",
            "resp_bytes",
        )
    ]
)

PROTOCOL_LOG = T.StructType(
    [T.StructField("uid", T.StringType()), T.StructField("fc_request", T.StringType())]
)

LINK_LOG = T.StructType(
    [
        T.StructField("ts", T.DoubleType()),
        T.StructField("uid", T.StringType()),
        T.StructField("id.orig_h", T.StringType()),
        T.StructField("id.resp_h", T.StringType()),
        T.StructField("id.orig_p", T.IntegerType()),
        T.StructField("id.resp_p", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("orig_pkts", T.LongType()),
        T.StructField("resp_pkts", T.LongType()),
        T.StructField("orig_bytes", T.LongType()),
        T.StructField("resp_bytes", T.LongType()),
        T.StructField("function_codes", T.ArrayType(T.IntegerType())),
        T.StructField("unique_fc_count", T.LongType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("response_count", T.LongType()),
        T.StructField("is_broadcast", T.BooleanType()),
        T.StructField("inter_arrival_mean", T.DoubleType()),
        T.StructField("inter_arrival_std", T.DoubleType()),
        T.StructField("burst_count", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("anomaly_label", T.StringType()),
    ]
)

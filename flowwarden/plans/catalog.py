"""Every operator as a query over the provided tables: name -> (spark, sf_dir) -> rows.

Queries flatten arrays and maps to text and round doubles so that results can be
compared with independent SQL. They always read the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.functions import features as fn
from flowwarden.operators import augment as G
from flowwarden.operators import baseline as B
from flowwarden.operators import classifier as M
from flowwarden.operators import connections as C
from flowwarden.operators import ensemble as E
from flowwarden.operators import isoforest as I
from flowwarden.operators import link_rules as L
from flowwarden.operators import policy as P
from flowwarden.operators import quality as Q
from flowwarden.operators import response as R
from flowwarden.operators import scenarios as N
from flowwarden.operators import signatures as D
from flowwarden.operators.calibration import isotonic
from flowwarden.operators.neighbours import nearest
from flowwarden.plans import fixtures as X
from flowwarden.plans import logs_fixture as W
from flowwarden.session import scratch_path, stored
from flowwarden.sources import datasets, logs
from flowwarden.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_SHARED: dict[tuple, object] = {}
#: Lines of a log file; a packed file is read by one task.
LOG_LINES = 200_000


def query(fn_: Query) -> Query:
    QUERIES[fn_.__name__] = fn_
    return fn_


def shared(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], object]):
    """Fitted models and stored tables, made once per application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        _SHARED[key] = make()
    return _SHARED[key]


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Rounded for comparison; a small nudge keeps exact halves on one side."""
    return df.withColumns({n: F.round(F.col(n) + 10.0 ** -(places + 3), places) for n in names})


# ---- shared inputs ----


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return fn.enrich(X.flows(spark, sf))


def busy(spark: SparkSession, sf: str) -> DataFrame:
    return fn.enrich(X.busy_flows(spark, sf))


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the running statistics need of a flow."""
    return flows(spark, sf).select("uid", "ts_us", *S.FEATURES)


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Connection summaries from the messages and from the flows together."""
    found = C.connections(X.messages(spark, sf))
    given = X.link_summaries(spark, sf)
    return found.unionByName(given)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Busy flows with the rule detector's verdict."""
    return (
        D.best_match(busy(spark, sf))
        .withColumn("fired", F.col("rule_score") > 0)
        .withColumnsRenamed({"rule_attack": "attack_type", "rule_severity": "severity"})
        .withColumns({"confidence": F.col("rule_score"), "score": F.col("rule_score")})
    )


def busy_alerts(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["uid", "ts_us", "src_ip", "dst_ip", "attack_type", "severity", "confidence", "score", "label"]
    return D.rule_alerts(busy(spark, sf)).select(keep)


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return shared(
        "decided", spark, sf, lambda: stored(R.decide(busy_alerts(spark, sf)), "decided")
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return R.policy_rules(decided(spark, sf))


def revocations(spark: SparkSession, sf: str) -> DataFrame:
    """All-clear marks: quiet flows with function code 40."""
    quiet = D.best_match(busy(spark, sf)).where("rule_score = 0 AND function_code = 40")
    return quiet.select(F.col("src_ip").alias("host"), F.col("ts_us").alias("t_us"), "uid")


def baseline(spark: SparkSession, sf: str) -> B.Baseline:
    return shared("baseline", spark, sf, lambda: B.fit_baseline(flows(spark, sf)))


def everything(spark: SparkSession, sf: str) -> B.Baseline:
    return shared(
        "all-flows", spark, sf, lambda: B.fit_baseline(flows(spark, sf), normal_only=False)
    )


def forest(spark: SparkSession, sf: str) -> I.Forest:
    return shared(
        "forest", spark, sf,
        lambda: I.fit_forest(flows(spark, sf).where(fn.is_normal(F.col("label")))),
    )


def classifier(spark: SparkSession, sf: str) -> M.Classifier:
    return shared("classifier", spark, sf, lambda: M.train_classifier(flows(spark, sf)))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """All three detectors: rules, running statistics with the forest, and learned scores."""
    found = E.detector_scores(
        X.learned(flows(spark, sf)), baseline(spark, sf), forest_score=I.forest_score(forest(spark, sf))
    )
    return E.ensemble(found)


def log_path(name: str, spark: SparkSession, sf: str, make: Callable[[], DataFrame]) -> str:
    def write() -> str:
        path = scratch_path(spark, name)
        lines = make().write.option("compression", "gzip").option("maxRecordsPerFile", LOG_LINES)
        lines.text(path)
        return path

    return shared(name, spark, sf, write)


def connection_log(spark: SparkSession, sf: str) -> str:
    return log_path("conn", spark, sf, lambda: W.connection_lines(X.flows(spark, sf)))


def protocol_log(spark: SparkSession, sf: str) -> str:
    return log_path("proto", spark, sf, lambda: W.protocol_lines(X.flows(spark, sf)))


def link_log(spark: SparkSession, sf: str) -> str:
    return log_path("links", spark, sf, lambda: W.link_lines(X.link_summaries(spark, sf)))


# ---- sources and sinks ----


@query
def src1_json_scan(spark, sf):
    log = logs.read_json_log(spark, connection_log(spark, sf), S.CONNECTION_LOG)
    return log.select(
        "uid",
        F.col("ts").cast("double").alias("ts"),
        F.col("`id.orig_h`").alias("orig_h"),
        F.col("`id.resp_h`").alias("resp_h"),
        F.col("`id.orig_p`").alias("orig_p"),
        F.col("duration").cast("double").alias("duration"),
        "orig_pkts",
    )


@query
def src2_optional_scan(spark, sf):
    present = logs.read_optional_log(spark, protocol_log(spark, sf), S.PROTOCOL_LOG)
    absent = logs.read_optional_log(spark, scratch_path(spark, "absent"), S.PROTOCOL_LOG)
    return present.unionByName(absent).select("uid", "fc_request")


@query
def src3_last_wins(spark, sf):
    log = logs.read_json_log(spark, connection_log(spark, sf), S.CONNECTION_LOG)
    return logs.last_record(log.select("uid", "orig_pkts", "_at"))


@query
def src4_conn_flows(spark, sf):
    found = logs.log_flows(spark, connection_log(spark, sf), protocol_log(spark, sf))
    return rounded(found, 6, "bytes_per_pkt", "req_resp_ratio")


@query
def src5_dnp3_flows(spark, sf):
    found = logs.link_flows(spark, link_log(spark, sf))
    names = ["bytes_per_pkt", "req_resp_ratio", "inter_arrival_mean", "inter_arrival_std", "error_rate"]
    return rounded(found, 6, *names)


@query
def src6_csv(spark, sf):
    def write() -> str:
        path = scratch_path(spark, "csv")
        datasets.write_dataset(flows(spark, sf), path, "csv")
        return path

    path = shared("csv", spark, sf, write)
    return rounded(datasets.read_dataset(spark, path, "csv"), 6, "bytes_per_pkt")


@query
def snk1_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    datasets.write_dataset(flows(spark, sf), path)
    back = datasets.read_dataset(spark, path)
    return back.groupBy("label").agg(
        F.count("*").alias("n"),
        F.sum("pkt_count").alias("packets"),
        F.sum("byte_count").alias("bytes"),
    )


@query
def snk2_alert_log(spark, sf):
    path = scratch_path(spark, "alerts")
    found = busy_alerts(spark, sf)
    datasets.write_alert_log(found, path, "overwrite")
    back = datasets.read_alert_log(spark, path, found)
    return back.select("uid", "attack_type", "severity", "confidence", F.col("day").cast("string").alias("day"))


@query
def snk3_artifacts(spark, sf):
    """Baseline, forest and classifier written and read back: what was read is compared with
    what was fitted, the forest by its nodes and the classifier by its curves and, written once
    more, by the nodes of its trees."""
    paths = [scratch_path(spark, "artifacts") for _ in range(2)]
    fixed, trees, model = baseline(spark, sf), forest(spark, sf), classifier(spark, sf)
    datasets.save_artifacts(spark, paths[0], fixed, trees, model)
    other, again = datasets.load_forest(spark, paths[0]), datasets.load_classifier(spark, paths[0])
    datasets.save_artifacts(spark, paths[1], fixed, other, again)
    order = ["tree", "node"]
    nodes = [f.nodes.sort_values(order, ignore_index=True) for f in (trees, other)]
    same = nodes[0].equals(nodes[1][nodes[0].columns]) and (trees.sample, trees.offset) == (other.sample, other.offset)

    def content(path: str, curves: DataFrame) -> list:
        tables = [spark.read.parquet(f"{path}/classifier/forest-{i}/data") for i in range(len(model.forests))]
        return [t.agg(F.count("*"), F.bit_xor(F.xxhash64(*t.columns))).first() for t in [*tables, curves]]

    kept = content(paths[0], model.curves_frame(spark)) == content(paths[1], again.curves_frame(spark))
    back = datasets.load_baseline(spark, paths[0]).to_frame(spark)
    return rounded(back, 4, "mean", "variance").withColumns(
        {"forest_kept": F.lit(same), "classifier_kept": F.lit(kept)}
    )


@query
def snk4_metrics_json(spark, sf):
    alert_rows = R.with_action(busy_alerts(spark, sf))
    return Q.snapshot_json(outcomes(spark, sf), alert_rows)


# ---- messages to connections ----


@query
def agg1_connections(spark, sf):
    found = C.connections(X.messages(spark, sf))
    out = found.withColumn("function_codes", F.array_join(F.col("function_codes").cast("array<string>"), ","))
    return rounded(out, 6, "inter_arrival_mean", "inter_arrival_std")


@query
def agg2_req_resp(spark, sf):
    return C.connection_totals(X.messages(spark, sf)).select("uid", "request_count", "response_count")


@query
def agg3_fc_sets(spark, sf):
    m = X.messages(spark, sf)
    sets = C.connection_totals(m).select("uid", "function_codes", "unique_fc_count")
    pairs = F.transform(F.map_entries("codes"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    counts = C.code_histogram(m).select("uid", F.array_join(pairs, ",").alias("histogram"))
    return sets.join(counts, "uid").withColumn(
        "function_codes", F.array_join(F.col("function_codes").cast("array<string>"), ",")
    )


@query
def agg4_interarrival(spark, sf):
    found = C.connections(X.messages(spark, sf)).select("uid", "inter_arrival_mean", "inter_arrival_std")
    return rounded(found, 6, "inter_arrival_mean", "inter_arrival_std")


@query
def agg5_bursts(spark, sf):
    return C.connections(X.messages(spark, sf)).select("uid", "burst_count")


@query
def agg6_errors(spark, sf):
    return C.connection_totals(X.messages(spark, sf)).select("uid", "error_count")


@query
def agg7_broadcast(spark, sf):
    return C.connection_totals(X.messages(spark, sf)).select("uid", "is_broadcast")


@query
def agg8_volume(spark, sf):
    names = ["uid", "duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes"]
    return C.connection_totals(X.messages(spark, sf)).select(names)


@query
def not1_suspicious_fc(spark, sf):
    return C.suspicious_codes(X.messages(spark, sf))


@query
def not2_broadcast_write(spark, sf):
    return C.broadcast_writes(X.messages(spark, sf))


@query
def not3_flood(spark, sf):
    return rounded(C.floods(links(spark, sf)), 4, "rate")


@query
def not4_anomaly(spark, sf):
    return C.anomaly_notices(L.anomaly_records(links(spark, sf)))


# ---- link rules ----


def _link_rule(name: str, key: str) -> None:
    rule = next(r for r in L.LINK_RULES if r.name == name)
    QUERIES[key] = lambda spark, sf: L.link_hits_of(links(spark, sf), rule)


for _key, _name in (
    ("zr1_broadcast_write", "broadcast_write"),
    ("zr2_fc_diversity", "high_fc_diversity"),
    ("zr3_flooding", "flooding"),
    ("zr4_error_storm", "error_storm"),
    ("zr5_rr_imbalance", "req_resp_imbalance"),
    ("zr6_burst", "burst_traffic"),
    ("zr7_machine_speed", "machine_speed_pacing"),
):
    _link_rule(_name, _key)


@query
def zr8_scores(spark, sf):
    found = L.anomaly_records(links(spark, sf))
    out = found.withColumn("rules_fired", F.array_join("rules_fired", ","))
    return rounded(out, 6, "total_score")


@query
def zr9_annotate(spark, sf):
    out = L.annotate(links(spark, sf)).select("uid", "anomaly_score", "anomaly_label")
    return rounded(out, 6, "anomaly_score")


@query
def zr10_hits(spark, sf):
    return L.exploded_hits(links(spark, sf))


# ---- scalar functions ----


@query
def sc1_fc_class(spark, sf):
    return flows(spark, sf).select("uid", fn.function_code_class(F.col("function_code")).alias("fc_class"))


@query
def sc2_safe_ratio(spark, sf):
    share = fn.safe_ratio(F.col("byte_count"), F.col("pkt_count") - 10, -1.0)
    return rounded(flows(spark, sf).select("uid", share.alias("ratio")), 6, "ratio")


@query
def sc3_protocol(spark, sf):
    return flows(spark, sf).select("uid", fn.protocol_of_port(F.col("dst_port")).alias("protocol"))


@query
def sc4_broadcast(spark, sf):
    return flows(spark, sf).select("uid", fn.broadcast_address(F.col("dst_ip")).alias("broadcast"))


@query
def sc5_enrich(spark, sf):
    return rounded(flows(spark, sf).select("uid", "bytes_per_pkt"), 6, "bytes_per_pkt")


@query
def sc6_pps(spark, sf):
    rate = fn.packet_rate(F.col("pkt_count"), F.col("flow_duration"))
    return rounded(flows(spark, sf).select("uid", rate.alias("pps")), 6, "pps")


@query
def sc7_vector(spark, sf):
    vectors = flows(spark, sf).select("uid", fn.feature_vector().alias("v"))
    columns = [F.col("v")[i].alias(f"v{i:02d}") for i in range(len(S.FEATURES))]
    return rounded(vectors.select("uid", F.size("v").alias("width"), *columns), 6, "v03")


@query
def sc8_clip_round(spark, sf):
    wild = flows(spark, sf).withColumns(
        {f: F.col(f).cast("double") * 1.25 - 0.5 for f in S.FEATURES}
    )
    return rounded(fn.constrain_all(wild).select("uid", *S.FEATURES), 6, *S.FEATURES)


@query
def sc9_state_vector(spark, sf):
    states = P.trajectories(X.decisions(spark, sf)).select(
        "episode_id", "part", "step", fn.state_vector().alias("v")
    )
    columns = [F.col("v")[i].alias(f"v{i}") for i in range(8)]
    return rounded(
        states.select("episode_id", "part", "step", *columns), 6, *[f"v{i}" for i in range(8)]
    )


@query
def sc10_label_ids(spark, sf):
    given = F.when(F.col("src_port") % 7 == 0, F.lit("unheard")).otherwise(F.col("label"))
    out = flows(spark, sf).select("uid", fn.label_id(given).alias("label_id"))
    return out.withColumn("label_name", fn.label_name(F.col("label_id")))


@query
def sc11_severity(spark, sf):
    value = F.col("req_resp_ratio")
    return flows(spark, sf).select(
        "uid",
        fn.rule_severity(value).alias("rule"),
        fn.statistical_severity(value).alias("statistical"),
        fn.learned_severity(value).alias("learned"),
        fn.link_severity(value).alias("link"),
    )


@query
def sc12_escalation(spark, sf):
    return flows(spark, sf).select("uid", fn.escalation_band(F.col("req_resp_ratio")).alias("band"))


@query
def sc13_split_label(spark, sf):
    f = flows(spark, sf)
    normal = f.where(fn.is_normal(F.col("label"))).select("uid", F.lit("normal").alias("side"))
    attack = f.where(~fn.is_normal(F.col("label"))).select("uid", F.lit("attack").alias("side"))
    return normal.unionByName(attack)


# ---- signature rules ----

for _key, _name in (
    ("r1_broadcast_write", "broadcast_write"),
    ("r2_unknown_fc", "unknown_function_code"),
    ("r3_high_rate_scan", "high_rate_scan"),
    ("r4_config_change", "config_change_fc"),
    ("r5_timing", "timing_attack"),
    ("r6_flooding", "flooding"),
    ("r7_unusual_port", "unusual_port"),
    ("r8_error_storm", "error_storm"),
    ("r9_dup_unsolicited", "duplicate_unsolicited"),
):
    _rule = next(r for r in D.SIGNATURES if r.name == _name)
    QUERIES[_key] = lambda spark, sf, rule=_rule: D.hits_of(flows(spark, sf), rule)


@query
def rd1_best_match(spark, sf):
    names = ["uid", "src_ip", "dst_ip", "attack_type", "severity", "confidence", "score", "detector"]
    return D.rule_alerts(flows(spark, sf)).select(names)


@query
def rd2_score(spark, sf):
    return flows(spark, sf).select("uid", D.rule_score().alias("score"))


@query
def rd3_hit_counts(spark, sf):
    return D.hit_counts(flows(spark, sf))


CUSTOM_RULES = [
    D.Signature(
        "large_packets", "mitm",
        D.when_true(lambda: F.try_divide(F.col("byte_count"), F.col("pkt_count")) > 4000, 0.55),
    ),
    # fails on most rows (not a number): those rows simply do not match
    D.Signature(
        "last_octet", "scan",
        D.when_true(lambda: F.replace("src_ip", F.lit("10.0.0."), F.lit("")).try_cast("int") == 1, 0.95),
    ),
    *D.SIGNATURES[:2],
]


@query
def rd4_custom_rules(spark, sf):
    found = D.rule_alerts(flows(spark, sf), CUSTOM_RULES)
    return found.select("uid", "attack_type", "severity", "confidence", "detector")


# ---- statistics ----

PRIOR = [f"prior_mean_{f}" for f in S.FEATURES] + [f"prior_std_{f}" for f in S.FEATURES]


@query
def st1_running_moments(spark, sf):
    return rounded(B.prior_moments(flows(spark, sf)).select("uid", "prior_n", *PRIOR), 4, *PRIOR)


@query
def st2_zscore(spark, sf):
    names = [f"z_{f}" for f in S.FEATURES]
    found = B.with_zscores(B.prior_moments(flows(spark, sf), baseline(spark, sf)))
    return rounded(found.select("uid", *names), 4, *names)


@query
def st3_baseline(spark, sf):
    return rounded(B.fit_baseline(flows(spark, sf)).to_frame(spark), 4, "mean", "variance")


@query
def st4_global_running(spark, sf):
    found = B.prior_moments(flows(spark, sf), baseline(spark, sf))
    return rounded(found.select("uid", "prior_n", *PRIOR), 4, *PRIOR)


@query
def st5_zscore_score(spark, sf):
    found = B.with_zscores(B.prior_moments(flows(spark, sf), baseline(spark, sf)))
    out = found.select(
        "uid",
        B.anomaly_score().alias("z_score"),
        F.array_join(B.outlying_features(), ",").alias("features"),
    )
    return rounded(out, 6, "z_score")


@query
def st6_iforest_fit(spark, sf):
    return rounded(forest(spark, sf).to_frame(spark), 6, "split", "offset")


@query
def st7_iforest_score(spark, sf):
    found = flows(spark, sf).select("uid", I.forest_score(forest(spark, sf)).alias("if_score"))
    return rounded(found, 6, "if_score")


@query
def st8_combined(spark, sf):
    found = B.statistical_scores(B.prior_moments(feature_rows(spark, sf), baseline(spark, sf)))
    return rounded(found.select("uid", "stat_score", "stat_fires", "stat_severity"), 6, "stat_score")


@query
def st8_combined_forest(spark, sf):
    found = B.statistical_scores(
        B.prior_moments(flows(spark, sf), baseline(spark, sf)), I.forest_score(forest(spark, sf))
    )
    return rounded(found.select("uid", "stat_score", "stat_fires", "stat_severity"), 6, "stat_score")


@query
def st9_attack(spark, sf):
    found = B.statistical_scores(
        B.prior_moments(flows(spark, sf), baseline(spark, sf)), I.forest_score(forest(spark, sf))
    )
    out = B.statistical_alerts(found).withColumn("features", F.array_join("features", ","))
    raw = {n: F.col("raw_scores")[n] for n in ("zscore", "iforest", "combined")}
    return rounded(out.withColumns(raw).drop("raw_scores"), 6, "confidence", "score", *raw)


# ---- machine learning ----


@query
def ml1_scaler(spark, sf):
    out = B.scale_features(flows(spark, sf), everything(spark, sf)).select("uid", *S.FEATURES)
    return rounded(out, 5, *S.FEATURES)


@query
def ml2_class_weights(spark, sf):
    return rounded(M.class_weights(flows(spark, sf)), 6, "weight")


@query
def ml3_rf(spark, sf):
    model = classifier(spark, sf)
    rows = [
        (i, f.getNumTrees, f.totalNumNodes, len(model.classes)) for i, f in enumerate(model.forests)
    ]
    return spark.createDataFrame(rows, "fold int, trees int, nodes bigint, classes int")


@query
def ml4_kfold(spark, sf):
    return M.stratified_folds(flows(spark, sf)).select("uid", "label", "fold")


@query
def ml5_calibration(spark, sf):
    points = classifier(spark, sf).curves_frame(spark)
    return points.select(
        "fold", fn.label_name(F.col("class")).alias("label"), F.col("x").alias("probability"), F.col("y").alias("calibrated")
    )


@query
def ml5_pooling(spark, sf):
    """Calibration curves of a plain score, the flow's bytes in steps of 64, for each fold and
    class of the classifier."""
    share = F.floor(F.col("byte_count") / 64) / F.lit(2048.0)
    folded = M.stratified_folds(flows(spark, sf)).select("fold", "label", share.alias("p"))
    each = F.explode(F.array(*[F.lit(x) for x in S.LABELS]))
    points = folded.select("fold", "p", "label", each.alias("class"))
    points = points.select("fold", "class", "p", (F.col("label") == F.col("class")).cast("int").alias("hit"))
    found = isotonic(points, ["fold", "class"])
    return rounded(found.withColumn("share", F.col("hits") / F.col("n")), 9, "low", "high", "share")


@query
def ml6_predict(spark, sf):
    found = M.predict(classifier(spark, sf), flows(spark, sf))
    return found.select(
        "uid", "label", "predicted", "ml_confidence", "ml_attack", "ml_severity",
        F.to_json("class_probabilities").alias("class_probabilities"),
    )


@query
def ml7_attack_prob(spark, sf):
    return M.attack_probability(classifier(spark, sf), flows(spark, sf))


@query
def ml8_importance(spark, sf):
    return M.importances(classifier(spark, sf), spark)


# What must hold of the learned models, as counts beside those of the tables.


@query
def ml3_training(spark, sf):
    model = classifier(spark, sf)
    dealt = M.stratified_folds(flows(spark, sf)).groupBy("fold").count().collect()  # one row a fold
    total = sum(r["count"] for r in dealt)
    sizes = {r["fold"]: total - r["count"] for r in dealt}
    rows = [
        (i, f.getNumTrees, len(model.classes), sizes[i], f.totalNumNodes > f.getNumTrees)
        for i, f in enumerate(model.forests)
    ]
    return spark.createDataFrame(rows, "fold int, trees int, classes int, training_rows bigint, grown boolean")


@query
def ml6_totals(spark, sf):
    found = M.predict(classifier(spark, sf), flows(spark, sf))
    each = F.map_values("class_probabilities")
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    best = F.col("class_probabilities")[F.col("predicted")]
    sure = (F.col("predicted") != "normal") & (F.col("ml_confidence") >= M.MIN_CONFIDENCE)
    fit = (F.col("ml_attack").isNotNull() == sure) & (F.col("ml_severity").isNotNull() == sure)
    return found.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.count_if((best == F.array_max(each)) & (best == F.col("ml_confidence"))).alias("best_is_predicted"),
        F.count_if(fit).alias("alert_fields_fit"),
        (F.count_if(F.col("predicted") == F.col("label")) * 2 > F.count("*")).alias("mostly_right"),
    )


@query
def ml7_totals(spark, sf):
    found = M.attack_probability(classifier(spark, sf), flows(spark, sf))
    p, truth = F.col("ml_probability"), Q.attack_truth()
    none = M.attack_probability(None, flows(spark, sf)).agg(F.count_if(F.col("ml_probability") == 0))
    return found.join(flows(spark, sf).select("uid", "label"), "uid").agg(
        F.count("*").alias("n"),
        F.count_if((p >= 0) & (p <= 1)).alias("in_range"),
        none.scalar().alias("without_a_model"),
        (F.avg(F.when(truth, p)) > F.avg(F.when(~truth, p)) + 0.5).alias("attacks_above_normal"),
    )


@query
def ml8_top(spark, sf):
    """The five most important features: places, and what must hold of their values."""
    every = M.importances(classifier(spark, sf), spark).agg(F.sum("importance")).first()[0]
    top = M.importances(classifier(spark, sf), spark, 5).collect()
    values = [r["importance"] for r in top]
    rows = [
        (i + 1, i == 0 or values[i] <= values[i - 1], r["feature"] in S.FEATURES, abs(every - 1) < 1e-9)
        for i, r in enumerate(top)
    ]
    return spark.createDataFrame(rows, "place int, falling boolean, a_feature boolean, sums_to_one boolean")


@query
def ml9_holdout(spark, sf):
    """Trained on four fifths, reported on the rest."""
    report = shared("holdout", spark, sf, lambda: stored(M.train_and_evaluate(flows(spark, sf))[1], "holdout"))
    accuracy = report.where("class = 'accuracy'").select("f1").scalar()
    return report.select("class", "support", (accuracy > 0.5).alias("accurate"))


@query
def ml9_holdout_report(spark, sf):
    return shared("holdout", spark, sf, lambda: stored(M.train_and_evaluate(flows(spark, sf))[1], "holdout"))


@query
def ml9_report(spark, sf):
    found = outcomes(spark, sf).select("label", F.coalesce("attack_type", F.lit("normal")).alias("predicted"))
    return rounded(Q.classification_report(found), 6, "precision", "recall", "f1")


@query
def ml10_split(spark, sf):
    return Q.shuffled_split(flows(spark, sf), 0.2).select("uid", "part")


@query
def ml11_warmup(spark, sf):
    return Q.warm_up(flows(spark, sf)).select("uid", "ts_us", "label")


@query
def ml12_class_distribution(spark, sf):
    return rounded(Q.class_distribution(flows(spark, sf)), 4, "percent")


# ---- ensemble ----


@query
def en1_weights(spark, sf):
    mixed = {"rule_based": 2.0, "statistical": 1.0, "ml": 1.0}
    found = E.weights_frame(scored(spark, sf), mixed)
    return rounded(found, 6, "mean_score", "weight")


@query
def en2_score(spark, sf):
    return rounded(scored(spark, sf).select("uid", "ensemble_score", "fired"), 6, "ensemble_score")


@query
def en3_best_detector(spark, sf):
    return scored(spark, sf).select("uid", "best_detector")


@query
def en4_alerts(spark, sf):
    found = E.alerts(scored(spark, sf))
    out = found.select(
        "uid", "ts_us", "src_ip", "dst_ip", "attack_type", "severity", "detector", "score",
        "confidence", "high_confidence",
        F.col("raw_scores")["rule_based"].alias("rule_based"),
        F.col("raw_scores")["statistical"].alias("statistical"),
        F.col("raw_scores")["ml"].alias("ml"),
    )
    return rounded(out, 6, "score", "confidence", "statistical", "ml")


@query
def en5_train(spark, sf):
    """Both learners and all three detectors together, as a quality summary."""
    ready = M.predict(classifier(spark, sf), flows(spark, sf))
    full = E.ensemble(
        E.detector_scores(ready, baseline(spark, sf), forest_score=I.forest_score(forest(spark, sf)))
    )
    return Q.rates(Q.confusion(full))


@query
def en5_totals(spark, sf):
    found = en5_train(spark, sf)
    return found.select(
        "total",
        (F.col("tp") + F.col("fn")).alias("attacks"),
        (F.col("fp") + F.col("tn")).alias("normal"),
        (F.col("tpr") > 0.4).alias("detects"),
        (F.col("fpr") < 0.35).alias("few_false"),
    )


@query
def en6_batch(spark, sf):
    out = E.batch_analysis(scored(spark, sf)).select(
        "uid", F.col("alert").isNotNull().alias("alerted"), F.col("alert.score").alias("score")
    )
    return rounded(out, 6, "score")


@query
def en7_stats(spark, sf):
    return rounded(E.run_stats(scored(spark, sf)), 6, "alert_rate")


# ---- response ----


@query
def mt1_action(spark, sf):
    return R.with_action(busy_alerts(spark, sf)).select("uid", "severity", "action")


@query
def mt2_cooldown(spark, sf):
    found = R.decide(busy_alerts(spark, sf), critical_hosts=())
    return found.select("uid", "src_ip", "ts_us", "success", "notes")


@query
def mt3_policy_rules(spark, sf):
    out = ledger(spark, sf)
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("metadata", F.array_join(pairs, ","))


@query
def mt4_safety(spark, sf):
    found = R.decide(busy_alerts(spark, sf))
    return found.select("uid", "src_ip", "ts_us", "action", "success", "notes")


@query
def mt4_ports(spark, sf):
    """The same with protected ports: nothing that drops traffic to a hundred of them."""
    rows = D.rule_alerts(busy(spark, sf)).select("uid", "ts_us", "src_ip", "dst_ip", "dst_port", "severity")
    found = R.decide(rows, protected_ports=range(49152, 49252))
    return found.select("uid", "src_ip", "ts_us", "action", "success", "notes")


@query
def mt5_expiry(spark, sf):
    rules = ledger(spark, sf)
    now = R.latest_time(rules, "installed_us")
    return R.with_expiry(rules, now).select("rule_id", "uid", "rule", "expires_us", "expired")


@query
def mt6_active(spark, sf):
    rules = ledger(spark, sf)
    return R.active_rules(rules, revocations(spark, sf), R.latest_time(rules, "installed_us"))


@query
def mt7_revoke(spark, sf):
    return R.revoke(ledger(spark, sf), revocations(spark, sf))


@query
def mt8_audit(spark, sf):
    return R.audit_log(decided(spark, sf))


@query
def mt9_host_qos(spark, sf):
    rules = ledger(spark, sf)
    return R.host_qos(rules, R.revoke(rules, revocations(spark, sf)))


@query
def mt9_fleet_qos(spark, sf):
    rules = ledger(spark, sf)
    hosts = R.host_qos(rules, R.revoke(rules, revocations(spark, sf)))
    return rounded(R.fleet_qos(hosts), 6, "avg_latency_ms", "avg_loss_pct")


@query
def mt10_alert_events(spark, sf):
    return R.alert_events(decided(spark, sf))


# ---- monitoring ----


@query
def mx1_confusion(spark, sf):
    return Q.confusion(outcomes(spark, sf))


@query
def mx2_rates(spark, sf):
    found = Q.rates(Q.confusion(outcomes(spark, sf)))
    return rounded(found, 6, "tpr", "fpr", "precision", "accuracy", "f1")


@query
def mx3_counts(spark, sf):
    return Q.breakdown(R.with_action(busy_alerts(spark, sf)))


@query
def mx4_timeline(spark, sf):
    return Q.timeline(outcomes(spark, sf))


@query
def mx5_deltas(spark, sf):
    return rounded(Q.tick_deltas(Q.timeline(outcomes(spark, sf))), 6, "delta")


@query
def mx6_throughput(spark, sf):
    return Q.throughput(outcomes(spark, sf))


@query
def mx7_history(spark, sf):
    found = Q.latest_alerts(R.alert_events(decided(spark, sf)), 50)
    return found.select("position", "uid", "ts_us", "attack_type", "action", "mitigated")


@query
def mx8_running_rates(spark, sf):
    found = Q.running_rates(outcomes(spark, sf))
    return rounded(found, 6, "alert_rate", "tpr", "fpr")


@query
def mx9_event_history(spark, sf):
    events = Q.bus_events(decided(spark, sf))
    since = R.latest_time(events, "ts_us") - 30_000_000
    return Q.event_history(events, "mitigation_applied", since, 100)


@query
def mx10_action_freq(spark, sf):
    return Q.action_frequency(R.alert_events(decided(spark, sf)))


# ---- augmentation ----


def training(spark: SparkSession, sf: str) -> DataFrame:
    return G.training_rows(flows(spark, sf))


@query
def ga1_gaussian(spark, sf):
    return rounded(G.gaussian(training(spark, sf), everything(spark, sf), 3), 4, *S.FEATURES)


@query
def ga2_mixup(spark, sf):
    return rounded(G.mixup(training(spark, sf), 2), 5, *S.FEATURES)


@query
def ga3_latent(spark, sf):
    return G.latent_samples(training(spark, sf))


@query
def ga3_totals(spark, sf):
    """What must hold of latent samples: their number, their bounds, and means within a
    deviation of the data's."""
    rows, fitted = training(spark, sf), everything(spark, sf)
    found = G.latent_samples(rows)
    fine = F.lit(True)
    for f in S.FEATURES:
        fine = fine & F.coalesce(fn.constrain(f, F.col(f)) == F.col(f), F.lit(False))
    near = F.lit(True)
    for f in S.FEATURES:
        near = near & (F.abs(F.avg(f) - fitted.mean[f]) <= fitted.variance[f] ** 0.5 + 1e-6)
    return found.agg(F.count("*").alias("n"), F.count_if(fine).alias("within_bounds"), near.alias("means_near"))


def _frozen_score(spark: SparkSession, sf: str) -> G.Score:
    fixed = baseline(spark, sf)

    def score(values: dict) -> Column:
        z = B.frozen_zscores(fixed, values)
        return B.anomaly_of(z) + F.greatest(*[F.abs(c) for c in z]) / 100

    return score


@query
def ga4_boundary(spark, sf):
    found = G.boundary_search(training(spark, sf), everything(spark, sf), _frozen_score(spark, sf))
    return rounded(found, 3, *S.FEATURES)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled feature rows from the part table."""
    return X.table(spark, sf, "part").selectExpr(
        "p_partkey AS id",
        "p_size * p_size / 200.0D AS flow_duration",
        "cast(p_size AS double) AS pkt_count",
        "cast(round(p_retailprice * 30) AS double) AS byte_count",
        "cast(round(p_retailprice * 30) AS double) / p_size AS bytes_per_pkt",
        "cast(1024 + (p_partkey * 7919) % 64000 AS double) AS src_port",
        "20000D AS dst_port",
        "1D AS protocol_id",
        "cast(p_partkey % 140 AS double) AS function_code",
        "cast(p_partkey % 7 + 1 AS double) AS unique_fc_count",
        "cast(p_partkey % 11 AS double) / 10 AS req_resp_ratio",
        "cast(p_partkey % 100 * 20 AS double) AS inter_arrival_mean",
        "cast(p_partkey % 7 * 10 AS double) AS inter_arrival_std",
        "cast(p_partkey % 2 AS double) AS is_broadcast",
        "cast(p_partkey % 3 AS double) AS direction",
        "cast(p_partkey % 50 AS double) AS burst_count",
        "cast(p_partkey % 9 AS double) / 10 AS error_rate",
    )


@query
def ga5_nn_labels(spark, sf):
    refs = training(spark, sf).withColumnsRenamed({"id": "ref_id", "label": "ref_label"})
    return rounded(nearest(probes(spark, sf), refs, S.FEATURES).drop("compared"), 3, "d2")


@query
def ga6_union(spark, sf):
    return G.augment(training(spark, sf), 3, _frozen_score(spark, sf))


@query
def ga6_totals(spark, sf):
    """Rows of the union by the way they were made, and how many bear a known label."""
    found = G.augment(training(spark, sf), 3, _frozen_score(spark, sf))
    kind = (
        F.when(F.col("id").contains("#g"), "noise").when(F.col("id").contains("#m"), "mixed")
        .when(F.col("id").contains("#b"), "searched").when(F.col("id").startswith("latent-"), "latent").otherwise("given")
    )
    return found.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label").isin(S.LABELS)).alias("labelled")
    )


@query
def ga7_upsample(spark, sf):
    rows = training(spark, sf)
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    return G.upsample(rows, largest).groupBy("label").agg(F.count("*").alias("n"))


# ---- policy evaluation ----


def rewarded(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_rewards(P.trajectories(X.decisions(spark, sf)))


@query
def rl1_state(spark, sf):
    found = P.trajectories(X.decisions(spark, sf))
    names = ["episode_id", "part", "step", "alert_count", "avg_severity", "avg_confidence",
             "action", "latency_ms", "isolated_hosts", "qos"]
    return rounded(found.select(names), 6, "avg_severity", "avg_confidence", "latency_ms", "qos")


@query
def rl2_reward(spark, sf):
    out = rewarded(spark, sf).select("episode_id", "part", "step", "outcome", "reward")
    return rounded(out, 6, "reward")


@query
def rl3_summary(spark, sf):
    out = P.episode_summaries(rewarded(spark, sf))
    return rounded(out, 5, "total_reward", "mean_reward", "precision", "recall", "final_qos")


@query
def rl4_td_targets(spark, sf):
    found = P.td_targets(rewarded(spark, sf), P.initial_weights(42))
    return found.select("episode_id", "part", "step", "reward", "done", "target")


@query
def rl5_greedy(spark, sf):
    found = P.greedy_actions(P.trajectories(X.decisions(spark, sf)), P.initial_weights(42))
    return found.select("episode_id", "part", "step", "greedy")


@query
def rl6_policy_eval(spark, sf):
    out = P.policy_evaluation(P.episode_summaries(rewarded(spark, sf)))
    return rounded(out, 5, "mean_reward", "std_reward", "mean_tpr", "mean_fpr")


@query
def rl7_curve(spark, sf):
    losses = X.table(spark, sf, "events").selectExpr("event_id AS step", "value AS loss")
    rewards = X.table(spark, sf, "orders").selectExpr("o_orderkey AS episode", "o_totalprice AS reward")
    return rounded(P.curve_stats(losses, rewards), 4, "mean_loss", "mean_reward")


# ---- scenarios ----


@query
def sn1_coverage(spark, sf):
    return rounded(N.scenario_coverage(flows(spark, sf)), 6, "coverage")


@query
def sn2_stages(spark, sf):
    return N.active_stages(X.campaign_steps(spark, sf))


# ---- streaming: every query drains its source and returns what was written ----

PARTS, DISORDER_US = 4, 30_000_000


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = X.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def _drained(table: DataFrame, column: str, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A table as a stream in four micro-batches of interleaved times, each a restart from the
    checkpoint, and then the end of the input: what the job wrote. A row arrives up to half a
    minute after its time."""
    spark = table.sparkSession
    arrives = F.col(column) + F.pmod(F.xxhash64(*table.columns), F.lit(DISORDER_US))
    rows = stored(table.withColumn("_arrives", arrives), name)
    low, high = rows.agg(F.min("_arrives"), F.max("_arrives")).first()
    part = F.floor((F.col("_arrives") - low) * PARTS / (high - low + 1))
    source = scratch_path(spark, name)
    table.limit(0).write.parquet(source)
    out, checkpoint, markers = jobs.fresh_paths(spark, name)
    stream = spark.readStream.schema(table.schema).parquet(source)
    with jobs.timer_state_store(spark):
        found = job(jobs.ended(stream, column, markers))
        for i in range(PARTS):
            rows.where(part == i).drop("_arrives").write.mode("append").parquet(source)
            jobs.run_to_files(found, out, checkpoint)
        jobs.finish(spark, column, markers)
        jobs.run_to_files(found, out, checkpoint)
    return spark.read.schema(found.schema).parquet(out)


@query
def str1_detect(spark, sf):
    out, checkpoint, _ = jobs.fresh_paths(spark, "detect")
    feed = X.learned(X.project_flows(_stream(spark, sf, "lineitem")))
    found = jobs.detect(feed, baseline(spark, sf), I.forest_score(forest(spark, sf)))
    names = ["uid", "attack_type", "severity", "detector", "score"]
    jobs.run_to_files(found.select(names), out, checkpoint)
    return rounded(spark.read.parquet(out), 6, "score")


@query
def str2_moments(spark, sf):
    fixed = baseline(spark, sf)
    found = _drained(X.busy_flows(spark, sf), "ts_us", lambda s: jobs.host_scores(s, fixed), "moments")
    return rounded(found, 6, "z_score")


@query
def str3_cooldown(spark, sf):
    alert_rows = busy_alerts(spark, sf)
    found = _drained(alert_rows, "ts_us", jobs.cooldown_decisions, "cooldown")
    return found.select("uid", "src_ip", "ts_us", "action", "success", "notes")


@query
def str4_expiry(spark, sf):
    rules = ledger(spark, sf).select("rule_id", "uid", "match_src", "rule", "installed_us")
    return _drained(rules, "installed_us", jobs.expired_rules, "expiry")


@query
def str5_sessions(spark, sf):
    found = _drained(X.messages(spark, sf), "t_us", lambda s: jobs.closed_connections(s, delay="1 minute"), "sessions")
    names = ["uid", "duration", "orig_pkts", "resp_pkts", "unique_fc_count", "burst_count",
             "inter_arrival_mean", "inter_arrival_std"]
    return rounded(found.select(names), 6, "inter_arrival_mean", "inter_arrival_std")


@query
def str6_ticks(spark, sf):
    def job(feed: DataFrame) -> DataFrame:
        judged = D.best_match(fn.enrich(feed)).withColumn("fired", F.col("rule_score") > 0)
        return jobs.ticks(judged, "1 minute")

    return _drained(X.busy_flows(spark, sf), "ts_us", job, "ticks")


@query
def str7_suppress(spark, sf):
    return _drained(X.messages(spark, sf), "t_us", jobs.suppressed_notices, "suppress").select("identifier")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts per attack class, severity and resulting action."""
    found = R.with_action(D.rule_alerts(flows(spark, sf)))
    return found.groupBy("attack_type", "severity", "action").agg(
        F.count("*").alias("alerts"), F.countDistinct("src_ip").alias("sources")
    )


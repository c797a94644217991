"""Streams in several interleaved micro-batches, with late rows and an end, against batches."""

import random

import pytest
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators import baseline as B
from flowwarden.operators import connections as C
from flowwarden.operators import response as R
from flowwarden.streaming import jobs

SECOND = 1_000_000


class Feed:
    """Rows written part by part; every part is a run of its own, restarted from the checkpoint."""

    def __init__(self, spark, schema, column, job, name):
        self.spark, self.schema, self.column = spark, schema, column
        self.out, self.checkpoint, self.markers = jobs.fresh_paths(spark, name)
        self.source = self.out + "-in"
        spark.createDataFrame([], schema).write.parquet(self.source)
        stream = spark.readStream.schema(schema).parquet(self.source)
        self.job = job(jobs.ended(stream, column, self.markers))

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.source)
        return jobs.run_to_files(self.job, self.out, self.checkpoint)

    def end(self):
        jobs.finish(self.spark, self.column, self.markers)
        jobs.run_to_files(self.job, self.out, self.checkpoint)
        return self.spark.read.schema(self.job.schema).parquet(self.out)


@pytest.fixture(autouse=True)
def timers(spark):
    with jobs.timer_state_store(spark):
        yield


def deal(rows, time, disorder, parts, seed):
    """Parts of rows that arrive up to `disorder` after their time."""
    rng = random.Random(seed)
    ordered = sorted(rows, key=lambda r: r[time] + rng.randrange(disorder))
    size = -(-len(ordered) // parts)
    return [ordered[i : i + size] for i in range(0, len(ordered), size)]


ALERTS = "uid string, ts_us bigint, src_ip string, dst_ip string, dst_port int, severity int"


def alert_rows(n=1200):
    rng = random.Random(4)
    hosts = ["10.0.2.1", "10.0.2.1", "10.0.2.2", "10.0.0.1", "10.0.2.3"]
    return [
        (f"u{i:05d}", rng.randrange(0, 400 * SECOND), rng.choice(hosts), "10.0.1.1", 20000 + i % 3, rng.randint(1, 4))
        for i in range(n)
    ]


def test_cooldown_over_batches_with_late_rows(spark):
    rows = alert_rows()
    parts = deal(rows, 1, 20 * SECOND, 4, 9)
    # the second and the fourth part bring rows from long before: too late
    late = [(f"late{i}", 1000 + i, "10.0.2.1", "10.0.1.1", 20000, 4) for i in range(7)]
    feed = Feed(spark, ALERTS, "ts_us", lambda s: jobs.cooldown_decisions(s, delay="30 seconds"), "cooldown")
    dropped = [feed.run(part + extra) for part, extra in zip(parts, ([], late[:3], [], late[3:]), strict=True)]
    assert dropped == [0, 3, 0, 4]
    found = {r["uid"]: (r["success"], r["notes"]) for r in feed.end().collect()}
    want = R.decide(spark.createDataFrame(rows, ALERTS)).collect()
    assert found == {r["uid"]: (r["success"], r["notes"]) for r in want}


def test_cooldown_of_an_earlier_alert_that_arrives_later(spark):
    rows = [("a", 10 * SECOND, "h", "d", 1, 3), ("b", 1 * SECOND, "h", "d", 1, 3), ("c", 7 * SECOND, "h", "d", 1, 3)]
    feed = Feed(spark, ALERTS, "ts_us", lambda s: jobs.cooldown_decisions(s, delay="30 seconds"), "cooldown")
    assert feed.run(rows[:1]) == feed.run(rows[1:]) == 0
    assert {r["uid"]: r["success"] for r in feed.end().collect()} == {"a": False, "b": True, "c": True}


def test_protected_ports(spark):
    rows = spark.createDataFrame(alert_rows(), ALERTS)
    found = R.decide(rows, protected_ports=(20001,))
    refused = found.where("notes = 'safety_constraint'")
    assert refused.where("dst_port = 20001 AND src_ip <> '10.0.0.1'").count() > 0
    assert found.where("success AND dst_port = 20001 AND action IN ('ISOLATE', 'BLOCK')").isEmpty()
    assert found.where("success AND dst_port <> 20001 AND action = 'ISOLATE'").count() > 0


def flow_rows(spark, n=900):
    rng = random.Random(6)
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(n)
    from flowwarden.plans import fixtures as X

    flows = X.project_flows(base).withColumn("src_ip", F.concat(F.lit("h"), F.pmod(F.hash("uid"), F.lit(4))))
    times = {r["uid"]: rng.randrange(0, 300 * SECOND) for r in flows.select("uid").collect()}
    return flows.schema, [r.asDict() | {"ts_us": times[r["uid"]]} for r in flows.collect()]


def test_moments_over_batches(spark):
    schema, rows = flow_rows(spark)
    start = B.Baseline(9, dict.fromkeys(S.FEATURES, 3.0), dict.fromkeys(S.FEATURES, 2.0))
    feed = Feed(spark, schema, "ts_us", lambda s: jobs.host_scores(s, start, "30 seconds"), "moments")
    for part in deal(rows, "ts_us", 20 * SECOND, 4, 3):
        assert feed.run([tuple(r[f] for f in schema.names) for r in part]) == 0
    found = {r["uid"]: (r["prior_n"], r["z_score"]) for r in feed.end().collect()}
    flows = spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows], schema)
    from flowwarden.functions.features import enrich

    batch = B.with_zscores(B.prior_moments(enrich(flows), start, ["src_ip"], 100))
    want = batch.select("uid", "prior_n", B.anomaly_score().alias("z")).collect()
    assert len(found) == len(want) == len(rows)
    for r in want:
        assert found[r["uid"]] == (r["prior_n"], pytest.approx(r["z"], abs=1e-9))


def test_a_silent_host_is_forgotten(spark):
    schema, rows = flow_rows(spark, 60)
    shift = lambda r, by: tuple((r | {"ts_us": r["ts_us"] + by, "src_ip": "h", "uid": f"{r['uid']}+{by}"})[f] for f in schema.names)
    feed = Feed(spark, schema, "ts_us", lambda s: jobs.host_scores(s, delay="30 seconds", forget_seconds=600), "forget")
    feed.run([shift(r, 0) for r in rows])
    feed.run([shift(r, 2000 * SECOND) for r in rows])  # moves the clock past the silence
    feed.run([shift(r, 5000 * SECOND) for r in rows])
    counts = sorted(r["prior_n"] for r in feed.end().collect())
    assert counts == sorted(3 * list(map(float, range(60))))


MESSAGES = (
    "event_id bigint, uid string, t_us bigint, orig_h string, resp_h string, resp_p int, fc int, "
    "is_orig boolean, is_error boolean, bytes bigint"
)


def message_rows(n=1500):
    rng = random.Random(12)
    rows = []
    for i in range(n):
        u = rng.randrange(40)
        t = u * 5 * SECOND + rng.randrange(4 * SECOND if u % 3 else 200_000)
        rows.append((i, f"C{u}", t, f"10.0.2.{u}", "255.255.255.255" if u % 5 == 0 else "10.0.1.1", 20000,
                     rng.choice([1, 2, 3, 129, 130, 255]), rng.random() < 0.6, rng.random() < 0.1, rng.randrange(500)))
    return rows


def test_connections_over_batches_to_the_end(spark):
    rows = message_rows()
    feed = Feed(spark, MESSAGES, "t_us", lambda s: jobs.closed_connections(s, 10.0, "30 seconds"), "sessions")
    for part in deal(rows, 2, 20 * SECOND, 4, 1):
        assert feed.run(part) == 0
    found = {r["uid"]: r for r in feed.end().drop("seen_at").collect()}
    want = C.connections(spark.createDataFrame(rows, MESSAGES)).collect()
    assert len(found) == len(want) == 40
    for r in want:
        for name, value in r.asDict().items():
            assert found[r["uid"]][name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_a_connection_that_comes_back_is_a_new_one(spark):
    row = lambda i, t: (i, "C", (1000 + t) * SECOND, "a", "b", 1, 1, True, False, 10)
    feed = Feed(spark, MESSAGES, "t_us", lambda s: jobs.closed_connections(s, 10.0, "30 seconds"), "sessions")
    feed.run([row(1, 0), row(2, 5), row(3, 30)])
    feed.run([row(4, 31), row(5, 100)])
    found = sorted((r["t_us"] // SECOND - 1000, r["orig_pkts"]) for r in feed.end().collect())
    assert found == [(0, 2), (30, 2), (100, 1)]


def test_all_kinds_of_notices(spark):
    rows = message_rows()
    feed = Feed(spark, MESSAGES, "t_us", lambda s: jobs.suppressed_notices(s, "30 seconds"), "notices")
    for part in deal(rows, 2, 20 * SECOND, 4, 2):
        feed.run(part)
    found = [r["identifier"] for r in feed.end().collect()]
    messages = spark.createDataFrame(rows, MESSAGES)
    whole = C.connections(messages)
    from flowwarden.operators import link_rules as L

    parts = [C.suspicious_codes(messages), C.broadcast_writes(messages), C.floods(whole), C.anomaly_notices(L.anomaly_records(whole))]
    names = [[r["identifier"] for r in p.select("identifier").collect()] for p in parts]
    assert all(names)
    assert sorted(found) == sorted(n for kind in names for n in kind)


def test_state_of_connections_is_kept_by_bucket(spark):
    # a state key of its own for every connection made the store's calls grow with their number
    names = "uid string, t_us long, orig_h string, resp_h string, resp_p int, fc int, is_orig boolean, is_error boolean, bytes long, event_id long"
    rows = [(f"c{i % 300}", (i + 1) * 10_000, "a", "b", 1, 3, True, False, 1, i) for i in range(900)]
    feed = Feed(spark, names, "t_us", lambda s: jobs.closed_connections(s, 2.0, "5 seconds", buckets=4), "buckets")
    assert feed.run(rows[:500]) == feed.run(rows[500:]) == 0
    keys = spark.read.format("statestore").option("stateVarName", "known").load(feed.checkpoint).count()
    assert keys <= 4
    found = feed.end()
    assert found.count() == 900 and found.agg(F.sum("orig_pkts")).first()[0] == 900

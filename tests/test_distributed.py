"""Sliced, blocked and pruned algorithms against plain loops on crowded small tables."""

import hashlib
import random
import statistics
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowwarden import schema as S
from flowwarden.operators import connections as C
from flowwarden.operators import response as R
from flowwarden.operators import slices
from flowwarden.operators.cooldown import NEVER, cooldown_status
from flowwarden.operators.neighbours import index, nearest, search
from flowwarden.plans import catalog
from flowwarden.plans import fixtures as X
from flowwarden.plans import logs_fixture as W
from flowwarden.session import scratch_root
from flowwarden.sources import logs


def walk(rows, cooldown):
    found, opens = {}, {}
    for host, t, uid, safe in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        if t < opens.get(host, NEVER):
            found[uid] = "cooldown"
        elif safe:
            found[uid], opens[host] = "taken", t + cooldown
        else:
            found[uid] = "unsafe"
    return found


ALERT = "src_ip string, ts_us bigint, uid string, safe boolean"


@pytest.mark.parametrize("cooldown", [1, 7, 90])
@pytest.mark.parametrize("slice_instants,table_rows", [(1 << 18, 1 << 21), (40, 1 << 21), (25, 30), (6, 1)])
def test_cooldown_equals_walk(spark, cooldown, slice_instants, table_rows):
    rng = random.Random(7)
    rows = [
        (f"h{min(rng.randint(0, 5), 3)}", rng.randint(-50, 400), f"u{i:04d}", rng.random() < 0.7)
        for i in range(600)
    ]
    rows += [("even", 2 * i, f"p{i:04d}", True) for i in range(200)]
    rows += [("rare", 1000 * i, f"r{i:04d}", i % 4 > 0) for i in range(60)]
    rows += [(None, rng.randint(0, 60), f"n{i:04d}", True) for i in range(50)]
    frame = spark.createDataFrame(rows, ALERT)
    found = cooldown_status(frame, cooldown, slice_instants, table_rows).collect()
    assert len(found) == len(rows)
    assert {r["uid"]: r["status"] for r in found} == walk(rows, cooldown)


def test_cooldown_of_alerts_without_time_or_rows(spark):
    frame = spark.createDataFrame([("h", None, "a", True), ("h", 5, "b", True)], ALERT)
    assert {r["uid"]: r["status"] for r in cooldown_status(frame, 7).collect()} == {"a": None, "b": "taken"}
    assert cooldown_status(frame.limit(0), 7).count() == 0


def test_cooldown_of_one_busy_host(spark):
    """Hundreds of thousands of alerts of one host in 300 s: many tasks, the walk's result."""
    n, span = 300_000, 300_000_000
    frame = spark.range(n).selectExpr(
        "'h' AS src_ip", f"pmod(xxhash64(id), {span}) AS ts_us", "lpad(id, 8, '0') AS uid", "id % 3 > 0 AS safe"
    )
    found = cooldown_status(frame, 5_000_000, 20_000).where("status = 'taken'").select("src_ip", "ts_us", "uid", "safe")
    rows = [tuple(r) for r in frame.where("safe").collect()]
    want = {u for u, s in walk(rows, 5_000_000).items() if s == "taken"}
    assert {r["uid"] for r in found.collect()} == want and 50 <= len(want) <= 60


def test_ledger_events_in_order(spark):
    second = 1_000_000
    ledger = spark.createDataFrame(
        [("iso-1", "a", "drop", 9000, 0, "u1"), ("rl-2", "b", "rate_limit", 5000, 0, "u2"), ("iso-3", "c", "drop", 9000, 0, "u3"),
         ("rl-0", "c", "rate_limit", 5000, -50 * second, "u0"), ("seg-4", "d", "reroute", 2000, 10 * second, "u4")],
        "rule_id string, match_src string, rule string, priority int, installed_us bigint, uid string",
    )
    clears = spark.createDataFrame(
        [("a", 400 * second, "x1"), ("a", 450 * second, "x2"), ("b", 400 * second, "x3"), ("b", 401 * second, "x4"),
         ("c", 300 * second, "x5"), ("d", 10 * second, "x6"), ("e", second, "x7")],
        "host string, t_us bigint, uid string",
    )
    done = {r["uid"]: (r["revoked"], r["rule_id"]) for r in R.revoke(ledger, clears).collect()}
    assert done == {
        "x1": (False, None), "x2": (False, None),  # 100 s after the expiry
        "x3": (True, "rl-2"), "x4": (False, None),  # never expires, but goes once
        "x5": (True, "iso-3"), "x6": (True, "seg-4"), "x7": (False, None),
    }
    active = lambda t: {r["host"]: r["rule_id"] for r in R.active_rules(ledger, clears, t * second).collect()}
    assert active(5) == {"a": "iso-1", "b": "rl-2", "c": "iso-3"}
    assert active(10) == {"a": "iso-1", "b": "rl-2", "c": "iso-3"}  # d is revoked at once
    assert active(299) == {"a": "iso-1", "b": "rl-2", "c": "iso-3"}
    assert active(301) == {"b": "rl-2"}  # c: neither the revoked rule nor the older one
    assert active(500) == {}


@pytest.fixture(scope="module")
def crowded(spark):
    """A third of all rows share one time and one key."""
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", 500 if i % 3 == 1 else rng.randint(0, 900), i % 7)
            for i in range(1500)]
    return spark.createDataFrame(rows, "id bigint, key string, t bigint, v int")


def test_slices_cut_a_crowded_instant(crowded):
    dealt, n = slices.add_slices(crowded, "t", "id", slice_rows=100)
    sizes = dealt.groupBy(slices.SLICE).count()
    assert n == 15 and sizes.count() > 10
    assert sizes.agg(F.max("count")).first()[0] < 300  # a third of the rows share one instant
    order = Window.orderBy("t", F.md5(F.col("id").cast("string")))
    back = dealt.withColumn("b", F.lag(slices.SLICE).over(order)).where(F.col("b") > F.col(slices.SLICE))
    assert back.isEmpty()


def test_slices_follow_the_rows(spark):
    df = spark.range(10)
    assert slices.slice_count(df, 0) == slices.slice_count(df, 10_000) == 1
    assert slices.slice_count(df, 25_000) == 3
    assert slices.slice_count(df, 10**12) == -(-(10**12) // slices.SLICE_ROWS)


def _moments(values):
    return len(values), statistics.fmean(values) if values else 0.0, statistics.pstdev(values) if len(values) > 1 else 0.0


@pytest.mark.parametrize("keys", [[], ["key"]])
@pytest.mark.parametrize("slice_rows", [None, 100])
def test_running_moments(spark, crowded, keys, slice_rows):
    found = slices.running_moments(crowded, "t", "id", ["v"], keys, slice_rows).collect()
    rows = sorted(crowded.collect(), key=lambda r: (r["t"], hashlib.md5(str(r["id"]).encode()).hexdigest()))
    seen, want = {}, {}
    for r in rows:
        before = seen.setdefault(r["key"] if keys else "", [])
        want[r["id"]] = _moments(before)
        before.append(r["v"])
    assert len(found) == len(rows)
    for r in found:
        n, mean, std = want[r["id"]]
        assert r["_n"] == n and r["_mean_v"] == pytest.approx(mean, abs=1e-12)
        assert (r["_m2_v"] / n if n else 0) ** 0.5 == pytest.approx(std, abs=1e-12)


def test_running_moments_send_a_row_once(spark, crowded):
    """Behind the slices the rows are shuffled once more, a slice to a task of its own, and not
    joined with what lies before them."""
    found = slices.running_moments(crowded, "t", "id", ["v"], slice_rows=100)
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count()
    assert sizes.count() > 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionBy") == 1


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_moments_of_gaps(spark, crowded, keys):
    """A missing value counts as a row and leaves mean and deviation as they are; what was seen
    before comes in front of every key."""
    gaps = crowded.withColumns({"v": F.when(F.col("id") % 4 > 0, F.col("v")), "key": F.when(F.col("key") != "k1", F.col("key"))})
    rows = sorted(gaps.collect(), key=lambda r: (r["t"], hashlib.md5(str(r["id"]).encode()).hexdigest()))
    for start in (None, (4.0, {"v": 10.0}, {"v": 36.0})):
        found = {r["id"]: r for r in slices.running_moments(gaps, "t", "id", ["v"], keys, 3000, start).collect()}
        seen, n = {}, {}
        for r in rows:
            key = r["key"] if keys else ""
            before, m = seen.setdefault(key, []), n.get(key, 0)
            if before:
                mean, m2 = statistics.fmean(before), statistics.pvariance(before) * m
                if start:
                    away = mean - 10
                    mean, m2 = 10 + away * m / (m + 4), 36 + m2 + away * away * 4 * m / (m + 4)
                assert found[r["id"]]["_mean_v"] == pytest.approx(mean, abs=1e-9)
                assert found[r["id"]]["_m2_v"] == pytest.approx(m2, abs=1e-7)
            assert found[r["id"]]["_n"] == m + (4 if start else 0)
            n[key] = m + 1
            if r["v"] is not None:
                before.append(r["v"])


@pytest.mark.parametrize("instant", [False, True])
def test_running_moments_far_from_zero(spark, instant):
    """Deviation 2 around 10^12, also where one instant holds all rows and where early rows lie
    far from the late ones."""
    time = "5L" if instant else "id"
    df = spark.range(20_000).selectExpr(f"{time} AS t", "id", "1000000000000D + if(id % 2 = 0, 2, -2) AS v")
    for slice_rows in (None, 1500):
        found = slices.running_moments(df, "t", "id", ["v"], slice_rows=slice_rows)
        std = found.where("_n >= 5000").select(F.sqrt(F.col("_m2_v") / F.col("_n")).alias("s"))
        low, high = std.agg(F.min("s"), F.max("s")).first()
        assert low == pytest.approx(2.0, abs=1e-3) and high == pytest.approx(2.0, abs=1e-3)
    near = spark.range(4000).selectExpr("id AS t", "id", "if(id % 2 = 0, 1D, -1D) AS v")
    far = spark.range(4000).selectExpr("id + 4000 AS t", "id + 4000 AS id", "1000000000000D AS v")
    found = slices.running_moments(near.union(far), "t", "id", ["v"], slice_rows=700)
    early = found.where("_n BETWEEN 100 AND 4000 AND _n % 2 = 0").agg(F.max(F.abs(F.col("_m2_v") / F.col("_n") - 1)))
    assert early.first()[0] < 1e-3


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_totals(spark, crowded, keys):
    found = slices.running_totals(crowded, "t", "id", {"total": F.col("v")}, keys, slice_rows=100)
    crowded.createOrReplaceTempView("crowded")
    part = "PARTITION BY key" if keys else ""
    want = spark.sql(
        f"""SELECT id, cast(coalesce(sum(v) OVER ({part} ORDER BY t, md5(cast(id AS string)), id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double) AS total FROM crowded"""
    )
    assert sorted(found.select("id", "total").collect()) == sorted(want.collect())


def test_previous_row(spark, crowded):
    found = slices.previous_row(crowded, ["key"], "t", "id", ["id", "v"], slice_rows=100)
    crowded.createOrReplaceTempView("crowded")
    want = spark.sql(
        """SELECT id, lag(id) OVER (PARTITION BY key ORDER BY t, md5(cast(id AS string)), id) AS prev_id
        FROM crowded"""
    )
    assert set(map(tuple, found.select("id", "prev_id").collect())) == set(map(tuple, want.collect()))


@pytest.mark.parametrize("slice_rows", [None, 100, 3])
@pytest.mark.parametrize("groups", [[], ["key"]])
def test_hash_rank(spark, crowded, groups, slice_rows):
    found = slices.hash_rank(crowded, "id", groups, slice_rows=slice_rows)
    crowded.createOrReplaceTempView("crowded")
    part = "PARTITION BY key" if groups else ""
    want = spark.sql(
        f"SELECT id, cast(row_number() OVER ({part} ORDER BY md5(cast(id AS string)), id) AS bigint) AS rank FROM crowded"
    )
    assert set(map(tuple, found.select("id", "rank").collect())) == set(map(tuple, want.collect()))


def test_connection_gaps_across_slices(spark):
    rng = random.Random(5)
    times = {u: sorted(rng.randint(0, 3_000_000) for _ in range(n)) for u, n in (("a", 400), ("b", 1), ("c", 9))}
    rows = [(i, u, t) for i, (u, t) in enumerate((u, t) for u, ts in times.items() for t in ts)]
    frame = spark.createDataFrame(rows, "event_id bigint, uid string, t_us bigint").selectExpr(
        "*", "'x' AS orig_h", "'y' AS resp_h", "20000 AS resp_p", "cast(t_us % 5 AS int) AS fc",
        "true AS is_orig", "false AS is_error", "1L AS bytes",
    )
    for slice_rows in (None, 40):
        for r in C.connections(frame, slice_rows).collect():
            gaps = [b - a for a, b in zip(times[r["uid"]], times[r["uid"]][1:])]
            assert r["burst_count"] == sum(g < 100_000 for g in gaps)
            assert r["inter_arrival_mean"] == pytest.approx(statistics.mean(gaps) / 1e6 if gaps else 0)
            assert r["inter_arrival_std"] == pytest.approx(statistics.pstdev(gaps) / 1e6 if gaps else 0)


def test_code_sets_hold_every_byte(spark):
    codes = {"a": list(range(256)), "b": [0, 63, 64, 127, 128, 255], "c": []}
    rows = [(u, c) for u, cs in codes.items() for c in [*cs, None]]
    found = spark.createDataFrame(rows, "uid string, fc int").groupBy("uid").agg(C.code_set().alias("codes"))
    assert {r[0]: r[1] for r in found.select("uid", C.codes_of(F.col("codes"))).collect()} == codes


@pytest.mark.parametrize("leaf", [1, 10, 1024])
def test_nearest_equals_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr("flowwarden.operators.neighbours.BLOCK", 40)
    rng = np.random.default_rng(11)
    refs = np.round(np.vstack([rng.normal(0, 1, (200, 3)), np.tile([5.0, 5.0, 5.0], (120, 1))]), 2)
    queries = np.round(rng.normal(1, 3, (150, 3)), 2)
    ref_rows = [(f"r{i:03d}", f"l{i % 4}", *map(float, v)) for i, v in enumerate(refs)]
    names = ["x", "y", "z"]
    ref_frame = spark.createDataFrame(ref_rows, "ref_id string, ref_label string, x double, y double, z double")
    query_frame = spark.createDataFrame(
        [(i, *map(float, v)) for i, v in enumerate(queries)], "id bigint, x double, y double, z double"
    )
    found = {r["id"]: (r["ref_id"], r["label"]) for r in nearest(query_frame, ref_frame, names, leaf).collect()}
    for i, q in enumerate(queries):
        d2 = ((refs - q) ** 2).sum(axis=1)
        best = int(np.flatnonzero(d2 <= d2.min() + 1e-12)[0])
        assert found[i] == (f"r{best:03d}", f"l{best % 4}")


def test_nearest_compares_few(spark):
    """Ten times the references, about as many comparisons per query."""
    means = []
    for n in (4_000, 40_000):
        refs = spark.range(n).selectExpr("id AS ref_id", "'l' AS ref_label", *[f"(pmod(xxhash64(id, {i}), 1000000)) / 1e6 AS f{i}" for i in range(3)])
        asked = spark.range(300).selectExpr("id", *[f"(pmod(xxhash64(id, {i + 7}), 1000000)) / 1e6 AS f{i}" for i in range(3)])
        found = nearest(asked, refs, ["f0", "f1", "f2"], leaf=64)
        assert found.count() == 300
        means.append(found.agg(F.avg("compared")).first()[0])
    assert means[1] < 1.5 * means[0] < 1000


def test_nearest_of_nothing(spark):
    schema = "ref_id bigint, ref_label string, x double"
    asked = spark.createDataFrame([(1, 0.5)], "id bigint, x double")
    assert nearest(asked, spark.createDataFrame([], schema), ["x"]).count() == 0
    one = spark.createDataFrame([(3, "l", 9.0), (2, "m", 9.0)], schema)
    assert nearest(asked, one, ["x"]).first()[:4] == (1, 2, "m", 72.25)


def test_rows_without_a_time_keep_their_place(spark):
    from pyspark.sql import functions as F

    from flowwarden.operators.slices import previous_row, running_totals

    rows = [(None, "a", 1.0), (5, "b", 2.0), (7, "c", 4.0)]
    df = spark.createDataFrame(rows, "t long, uid string, x double")
    sums = running_totals(df, "t", "uid", {"s": F.col("x")})
    assert {r.uid: r.s for r in sums.collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}
    before = previous_row(df, [], "t", "uid", ["uid"])
    assert {r.uid: r.prev_uid for r in before.collect()} == {"a": None, "b": "a", "c": "b"}


def test_history_filters_before_it_cuts(spark):
    from flowwarden.operators import quality

    events = spark.range(2000).selectExpr("id AS ts_us", "if(id < 900, 'x', 'y') AS type", "cast(id AS string) AS event_id")
    assert quality.event_history(events, "x", limit=700).count() == 700
    assert quality.event_history(events, "x", limit=700, keep=500).count() == 0
    alerts = events.withColumnRenamed("event_id", "uid")
    assert quality.latest_alerts(alerts, 1000).count() == 1000
    assert quality.warm_up(alerts, 600).count() == 600


def test_rows_without_a_start_of_their_own_bear_an_empty_list():
    """Null lists make Arrow's writer fill all offsets of a batch again after every row."""
    batch = pa.RecordBatch.from_pydict(
        {
            "x": pa.array([None, 1.0, 3.0, 8.0]),
            slices.SLICE: pa.array([0] * 4, pa.int32()),
            "_before": pa.array([[2.0, 5.0, 2.0], [], [], []], pa.list_(pa.float64())),
            "_group": [""] * 4,
        }
    )
    (out,) = slices._walk_moments(["x"], ["x"], [0.0], None)(iter([batch]))
    assert out["x"].to_pylist() == [1.0, 3.0, 8.0]
    assert out["_n"].to_pylist() == [2.0, 3.0, 4.0]
    assert out["_mean_x"].to_pylist() == pytest.approx([5.0, 11 / 3, 3.5])


def test_cooldown_finds_its_alerts_once(spark):
    rows = spark.createDataFrame([("h", 1, "u"), ("h", 2, "v")], "src_ip string, ts_us bigint, uid string")
    judged = cooldown_status(rows.withColumn("safe", F.expr("uid <> 'costly'")), 5)
    assert "costly" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert {r["uid"]: r["status"] for r in judged.collect()} == {"u": "taken", "v": "cooldown"}


def test_nearest_compares_few_where_queries_lie_off_the_data(spark):
    """Queries between two crowds, just past the cut that ends the nearer one."""
    place = [f"pmod(xxhash64(id, {i}), 30000) / 1e3 AS {c}" for i, c in enumerate("yz")]
    refs = spark.range(20_000).selectExpr("id AS ref_id", "'l' AS ref_label", "if(id % 5 < 3, 1000, id / 2e4) AS x", *place)
    asked = spark.range(20_000, 20_200).selectExpr("id", "id / 1e4 AS x", *place)
    found = {r["id"]: r for r in nearest(asked, refs, ["x", "y", "z"], leaf=64).collect()}
    known = refs.toPandas()[["x", "y", "z"]].to_numpy(float)
    for r in asked.collect():
        d2 = ((known - np.array([float(r["x"]), float(r["y"]), float(r["z"])])) ** 2).sum(axis=1)
        assert abs(found[r["id"]]["d2"] - d2.min()) <= 1e-9
    assert np.mean([r["compared"] for r in found.values()]) < 2_000


def test_logs_are_packed_and_the_last_record_still_wins(spark, monkeypatch, tmp_path):
    """A log of many packed files reads like the same lines in one plain file."""
    monkeypatch.setattr(catalog, "LOG_LINES", 500)
    monkeypatch.setattr(catalog, "_SHARED", {})
    packed = catalog.connection_log(spark, "/root/testdata/sf0.001")
    files = spark.read.text(packed).select("_metadata.file_name").distinct().collect()
    assert len(files) > 5 and all(f.file_name.endswith(".gz") for f in files)
    lines = W.connection_lines(X.flows(spark, "/root/testdata/sf0.001"))
    lines.coalesce(1).write.text(str(tmp_path / "plain"))

    def last(path):
        log = logs.read_json_log(spark, path, S.CONNECTION_LOG)
        return sorted(logs.last_record(log.select("uid", "orig_pkts", "_at")).collect())

    assert last(packed) == last(str(tmp_path / "plain"))


def test_searches_share_an_index_and_leave_no_copies(spark):
    """Labels of two searches over one index; what only led to a stored table is deleted."""
    rows = spark.createDataFrame([(f"r{i}", "ab"[i % 2], float(i), float(i * i % 7)) for i in range(300)],
                                 "ref_id string, ref_label string, x double, y double")
    queries = [spark.createDataFrame([(f"q{i}", i + 0.2, 1.0) for i in part], "id string, x double, y double")
               for part in (range(0, 40), range(200, 240))]
    before = set(Path(scratch_root(spark)).iterdir())
    refs = index(rows, ["x", "y"], leaf=32)
    for part in queries:
        kept, found = search(part, refs, ["x", "y"])
        assert sorted(kept.collect()) == sorted(part.collect())
        wanted = {q.id: min(((q.x - r.x) ** 2 + (q.y - r.y) ** 2, r.ref_id) for r in rows.collect()) for q in part.collect()}
        got = {r.id: (r.d2, r.ref_id) for r in found.collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in wanted.items()}
    names = [p.name.split("-")[0] for p in set(Path(scratch_root(spark)).iterdir()) - before]
    assert names.count("placed") == 1 and names.count("reached") == 2
    assert "unique" not in names and "homes" not in names

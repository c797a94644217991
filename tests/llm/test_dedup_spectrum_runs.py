"""Exact dedup, whitening and periodic runs: against plain loops and dense algebra."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import queries, recipes, runs, spectrum

DATA = "/root/testdata/sf0.001"


# ---- exact dedup ----


def long_text(seed, n):
    draw = random.Random(seed)
    return " ".join(f"word{draw.randrange(5000)}é" for _ in range(n))


def test_cuts_depend_on_the_text_alone():
    texts = [long_text(i, 4000) for i in range(3)] + ["", "short", "a" * 200_000, "é" * 50_000]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    ends, counts = recipes.cuts(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, one in enumerate(data):
        alone, n = recipes.cuts(np.frombuffer(one, np.uint8), np.array([0, len(one)]))
        own = ends[counts[i] : counts[i + 1] + 1]
        assert n[1] == counts[i + 1] - counts[i]
        assert (own - offsets[i])[1:].tolist() == alone[1:].tolist()
        sizes = np.diff(alone)
        assert sizes.sum() == len(one) and (sizes <= recipes.MOST).all()
        assert (sizes[:-1] >= recipes.LEAST).all()


def test_an_insertion_moves_few_cuts():
    text = long_text(7, 30_000)
    cut = lambda t: recipes.cuts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    chunks = lambda t, e: {t.encode()[a:b] for a, b in zip(e, e[1:], strict=False)}
    changed = text[:1000] + "inserted " + text[1000:]
    one, other = chunks(text, cut(text)), chunks(changed, cut(changed))
    assert len(one - other) <= 3 and len(one) > 50


def dedup_rows():
    hot = long_text(1, 3000)
    rows = [(i, hot) for i in range(0, 900, 3)]
    rows += [(1, hot + "x"), (4, hot[:-1]), (7, None), (10, ""), (13, None), (None, hot), (None, "alone"), (None, "alone")]
    rows += [(2, "twice"), (2, "twice"), (5, "twice"), (5, "twice"), (8, "Twice"), (11, "twice ")]
    return rows


def expected(rows):
    last, size = {}, {}
    for i, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        last[t] = i if last.get(t) is None or (i is not None and i > last[t]) else last[t]
    return [(i, last[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]


@pytest.mark.parametrize("width", [16, 3])
def test_duplicates_equal_plain_grouping(spark, width):
    rows = dedup_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    extra = df.selectExpr("doc_id", "text", "1 AS id", "2 AS row", "3 AS recipe", "4 AS keep_id", "5 AS name")
    got = recipes.duplicates(extra, width=width).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=key) == sorted(expected(rows), key=key)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_colliding_identifiers_are_drawn_anew(spark):
    by_name = {}
    for i in range(100_000):
        text = f"text {i}"
        name = recipes.xxhash.xxh3_128_digest(text.encode(), 0)[:2]
        if name in by_name:
            break
        by_name[name] = text
    df = spark.createDataFrame([(1, text), (2, by_name[name])], "doc_id long, text string")
    assert recipes.verified_seed(df, width=2) > 0
    assert {r["group_size"] for r in recipes.duplicates(df, width=2).collect()} == {1}
    many = spark.range(600).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    with pytest.raises(ValueError, match="too short"):
        recipes.duplicates(many, width=1)


def test_deduplicated_keeps_columns(spark):
    df = spark.createDataFrame(dedup_rows(), "doc_id long, text string").selectExpr("*", "7 AS id", "8 AS digest")
    found = recipes.deduplicated(df)
    assert found.columns == df.columns
    texts = [r["text"] or "" for r in found.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in dedup_rows()})
    assert recipes.deduplicated(df.limit(0)).count() == 0


def test_dedup_of_nothing(spark):
    assert recipes.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- whitening ----


@pytest.mark.parametrize("kind", ["spread", "equal", "fours", "few", "falling", "near"])
def test_leading_equals_dense_solver(kind):
    draw, d = np.random.default_rng(3), 48
    values = {
        "spread": np.sort(draw.random(d) * 100)[::-1],
        "equal": np.full(d, 3.0),
        "fours": np.repeat(np.sort(draw.random(d // 4))[::-1], 4),
        "few": np.concatenate([np.sort(draw.random(7))[::-1], np.zeros(d - 7)]),
        "falling": 2.0 ** -np.arange(d),
        "near": 1 + np.arange(d)[::-1] * 1e-9,
    }[kind]
    turn = np.linalg.qr(draw.normal(size=(d, d)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, want = spectrum.leading(matrix), np.sort(np.linalg.eigvalsh(matrix))[::-1]
    k = len(found.values)
    assert k == (7 if kind == "few" else 32)
    assert np.abs(found.values - want[:k]).max() < 1e-13 * want[0]
    assert np.abs(matrix @ found.vectors.T - found.vectors.T * found.values).max() < 1e-13 * want[0]
    assert np.abs(found.vectors @ found.vectors.T - np.eye(k)).max() < 1e-10
    for shift in draw.random(30) * want[0]:
        assert spectrum.inertia(matrix, shift) == (want > shift).sum()


def test_inertia_needs_two_by_two_pivots():
    matrix = np.array([[0.0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, -2], [0, 0, -2, 0]])
    assert [spectrum.inertia(matrix, s) for s in (-3, -1.5, 0, 1.5, 3)] == [4, 3, 2, 1, 0]


def vectors(n, d, seed=5):
    draw = np.random.default_rng(seed)
    found = (draw.normal(size=(n, d)) @ draw.normal(size=(d, d)) / 4).astype(np.float32).tolist()
    return [(i, v) for i, v in enumerate(found)]


def dense(rows):
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, found = np.linalg.eigh(y.T @ y / n)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    return values[::-1], (y @ found / np.sqrt(values))[:, ::-1], deviation


def test_whitening_equals_dense_algebra(spark):
    rows = vectors(700, 40)
    bad = [(900, None), (901, []), (902, [None] + [0.5] * 39), (903, [float("nan")] * 40), (904, [float("inf")] * 40)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(9)
    extra = df.selectExpr("*", "1 AS id", "2 AS v", "3 AS component", "4 AS n")
    values, whitened, deviation = dense(rows)
    got = spectrum.whiten(extra).collect()
    assert len(got) == 700 * 32
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == 700 and int(r["deviation"]) == deviation[i]
        assert abs(abs(r["whitened"]) - abs(whitened[i, c])) < 1e-8
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-9
        assert r["identity_error"] < 1e-9
    signs = {(r["component"], np.sign(r["whitened"] * whitened[r["vec_id"], r["component"] - 1])) for r in got if abs(r["whitened"]) > 1e-6}
    assert len(signs) == 32


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert spectrum.whiten(make([])).count() == 0
    assert spectrum.whiten(make([(1, None), (2, [])])).count() == 0
    assert spectrum.whiten(make([(1, [0.5, 2.0]), (2, [0.5, 2.0])])).count() == 0  # no spread
    flat = spectrum.whiten(make([(1, [0.0, 7.0]), (None, [1.0, 7.0]), (None, [1.0, 7.0])])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 3
    assert all(r["explained"] == 1.0 and r["identity_error"] < 1e-12 for r in flat)
    with pytest.raises(ValueError, match="1 and of 2"):
        spectrum.whiten(make([(1, [0.5, 2.0]), (2, [0.5])]))
    with pytest.raises(Exception, match="does not fit a long"):
        spectrum.whiten(make([(1, [3e38, 2.0]), (2, [0.5, 1.0])])).collect()


def test_deviation_beyond_a_long_is_exact(spark):
    df = spark.createDataFrame([(1, [1e9, 2.0]), (2, [-1e9, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    x = [[int(64 * a) + 10**6, int(64 * b) + 10**6] for a, b in ([1e9, 2.0], [-1e9, 1.0], [5.0, 5.0])]
    sums = [sum(v[i] for v in x) for i in range(2)]
    want = {i + 1: sum((3 * v[k] - sums[k]) ** 2 for k in range(2)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in spectrum.whiten(df).collect()} == want


def test_sums_are_added_in_levels(spark):
    parts = spark.range(0, 10_000, 1, 200).selectExpr("array(cast(id AS double), 1D) AS v")
    total = spectrum._products(parts, lambda c: c.flatten().to_numpy().reshape(-1, 2))
    ids = np.arange(10_000.0)
    assert total.tolist() == [(ids * ids).sum(), ids.sum(), ids.sum(), 10_000, ids.sum(), 10_000]


# ---- periodic runs ----


def plain_runs(w, least=12):
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q):
                s = w[i : i + size]
                if all(any(s[k] != s[k + p] for k in range(size - p)) for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_all_periods():
    draw = random.Random(2)
    for _ in range(1500):
        n, kinds = draw.randint(0, 80), draw.randint(1, 4)
        w = [draw.randrange(kinds) for _ in range(n)]
        if n and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(2, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            assert runs.find_runs(np.array(w, np.int64), least) == plain_runs(w, least)


def test_runs_of_nested_repeats():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == plain_runs(b)
    line = [1, 2, 3, 4, 5, 6, 7] * 3
    page = line + [8] + line + [8] + line + [9, 9, 9] + list(range(20, 60)) * 2
    assert runs.find_runs(np.array(page)) == plain_runs(page)
    assert runs.find_runs(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]


def plain_row(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    text = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_run_query_equals_plain_loops(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(["one", "two", "é", "Two\x1cx"]) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (None, "la " * 40), (303, " la  " * 30), (303, "la " * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS words", "2 AS id", "3 AS runs")
    got = runs.digests(runs.runs(runs.with_repeats(docs))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_run_query_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 3000)
    want = {r["doc_id"]: plain_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_runs(spark, DATA).collect()}
    assert len(got) >= len(want) and all(got[i] == row for i, row in want.items())


def test_runs_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert runs.digests(runs.runs(runs.with_repeats(nothing))).count() == 0


def test_batches_are_cut_alike():
    column = pa.array(["a" * 5000, None, long_text(3, 900)])
    data, _, ends, chunks, lists, names = recipes._identified(column, 0, 16)
    assert len(ends) == len(chunks) + 1 and ends[-1] == len(data) and lists[1] == b"" and len(names) == 3

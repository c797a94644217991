"""URL filters, mixing, top-k, chat, embeddings, near-dedup and WARC: against plain loops, on
small tables with nulls, ties, repeated rows, empty tables and clashing column names."""

import datetime as dt
import hashlib
import io
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowwarden.llm import bpe, chat, components, encode, langid, minhash, mixing, pigeonhole, urls, vafile, warc


def groups_of(nodes, links):
    lowest = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(lowest[a], lowest[b])
            if lowest[a] != low or lowest[b] != low:
                lowest[a] = lowest[b] = low
                changed = True
    return lowest


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    want = groups_of({n for link in links for n in link}, links)
    assert got == want
    empty = spark.createDataFrame([], "a long, b long")
    assert components.components(empty).count() == 0


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def corpus(seed=1):
    draw = random.Random(seed)
    base = [" ".join(draw.choice("abcdefghij") + str(draw.randint(0, 300)) for _ in range(n)) for n in (3, 5, 30, 80, 400, 400)]
    rows = []
    for text in base:
        for _ in range(8):
            w = text.split(" ")
            for _ in range(draw.randint(0, 1 + len(w) // 40)):
                w[draw.randrange(len(w))] = "new" + str(draw.randint(0, 99))
            rows.append(draw.choice([" ", "\n", "\t "]).join(w))
    passage = base[4]
    rows += [passage + " " + " ".join(f"own{i}x{k}" for k in range(150)) for i in range(20)]
    rows += [None, "", " \n", "One", "one", "É É", "é é", "x " * 70_000, "y" * (1 << 20) + "z ü", "y" * (1 << 20) + "z ü"]
    return list(enumerate(rows))


def test_near_duplicates_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("x"))
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    sets = {i: shingles(text) for i, text in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = groups_of(sets, links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    left = minhash.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_near_duplicates_of_one_crowd(spark):
    """Many copies about as far from each other as a link reaches: all meet in the same
    buckets, and most links are not to the smallest id."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in draw.sample(range(90), draw.choice([1, 2, 3, 4])):
            text[at] = draw.choice(["x", "y", f"u{i}"])
        rows.append((1000 - i, " ".join(text)))
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    want = groups_of(list(sets), links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: want[i] for i in sets}
    assert len(set(got.values())) > 20


def test_near_duplicates_edge_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (5, "A B\tc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True), (None, 0, None, True), (5, 1, 1, False)], key=str
    )
    assert minhash.deduplicated(df).count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_mixing_water_levels(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(300)] + [(1000 + i, "v " * 5, "sm") for i in range(9)]
    rows += [(2000, None, "empty"), (2001, "a b", None), (2001, "a b", None), (None, "c", "sm")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    decided = mixing.decide(df)
    got = mixing.report(decided).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not above:
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        open_ -= above
    target |= {s: share * weight[s] for s in open_}
    source_of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert math.isclose(r.target, target[source_of[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[source_of[r.doc_id]]
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 7 for s in order)
    assert mixing.mixed(df, decided).columns == df.columns
    assert mixing.mixed(df, decided).where("source = 'big'").agg(F.sum(F.size(F.split("text", " ")) - 1)).first()[0] == taken["big"]
    assert mixing.report(mixing.decide(df.limit(0))).count() == 0


def vectors(seed=2):
    draw = random.Random(seed)
    rows = [[draw.gauss(0, 1) for _ in range(24)] for _ in range(120)]
    rows += [[x + draw.gauss(0, 0.25) for x in rows[0]] for _ in range(40)] + [list(rows[3])] * 30
    rows += [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0] * 7, [2.0] * 7, [1e30] * 24]
    return [(i, v) for i, v in enumerate(rows)]


def test_top_k_equals_all_pairs(spark):
    rows = [(i, v) for i, v in vectors()]
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    held = {r.vec_id: r.embedding for r in df.collect()}
    usable = {i: [math.floor(256 * x) for x in v] for i, v in held.items()
              if v and all(x is not None and abs(x) <= vafile.LARGEST for x in v)}
    want = []
    for q in (i for i in usable if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])]
    assert sorted(tuple(r) for r in vafile.top_k(df, every=10).collect()) == sorted(want)
    assert vafile.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,largest,wide", [("float", 1e3, False), ("float", 1e5, True), ("float", 1e16, True), ("double", 2.0**300, True)])
def test_top_k_of_long_and_large_vectors(spark, kind, largest, wide):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3_072)]) for i in range(30)]
    rows += [(30 + i, [largest * (i + 1), *[draw.gauss(0, 1) for _ in range(3_071)]]) for i in range(2)]
    rows += [(40 + i, [draw.gauss(0, 1) * 3e5 for _ in range(24)]) for i in range(11)]
    rows += [(60, [1e9 if wide else 1.0] * 24), (61, [0.0] * 24)]
    if largest > 1e30:
        rows = [(i, v) for i, v in rows if i not in (30, 31)] + [(70, [largest, 0.0]), (80, [0.0, 1.0]), (90, [2.0**-250, -1.0]), (71, [0.0, 7.5])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    whole = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in df.collect()}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:5])]
    found = vafile.top_k(df, every=10)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert found.schema["score"].dataType.simpleString() == ("decimal(38,0)" if wide else "bigint")
    assert {r[0] for r in want} >= {0, 10, 20, 40, 50, 60}


def test_top_k_of_too_large_products(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="38 digits"):
        vafile.top_k(df).collect()


def test_near_vectors_equal_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    held = {r.vec_id: r.embedding for r in df.collect()}
    usable = {i: v for i, v in held.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in usable.items()}
    links = [
        (a, b) for a, b in itertools.combinations(usable, 2)
        if len(usable[a]) == len(usable[b])
        and sum(x * y for x, y in zip(usable[a], usable[b], strict=True)) / norm[a] / norm[b] >= 0.9
    ]
    want = groups_of(held, links)
    for chunk in (pigeonhole.CHUNK, 16):
        got = {r.vec_id: r for r in pigeonhole.near_vectors(df, chunk=chunk).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_links for i, r in got.items()} == {i: sum(i in link for link in links) for i in held}
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in pigeonhole.near_vectors(twice).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert pigeonhole.near_vectors(twice.limit(0)).count() == 0


def test_near_vectors_on_the_edge_of_a_block(spark):
    """A link that lies within the slack of its first block, two cells apart by its share."""
    low, high, apart = -1e-6, math.sqrt(0.1 + 1.5e-5) - 1e-6, 0.3
    both = (low**2 - high**2) / apart
    turned = np.zeros((2, 32))
    turned[:, 0] = low, high
    turned[:, 16] = (both - apart) / 2, (both + apart) / 2
    turned[:, 17] = math.sqrt(1 - low**2 - turned[0, 16] ** 2)
    rows = (turned @ pigeonhole._rotation(32)).tolist()
    assert np.dot(*rows) > 0.9
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pigeonhole.near_vectors(df).collect())
    assert got == [(0, 1, 0, True), (1, 1, 0, False)]


def test_url_lists_as_of_the_fetch(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = [
        ("block", "host", "a.example.com", True, day(10)), ("block", "host", "a.example.com", False, day(70)),
        ("block", "domain", "example.com", True, day(90)), ("allow", "prefix", "b.example.com/ok", True, day(95)),
        ("block", "host", "a.example.com", True, day(70)), ("block", "host", None, True, day(1)),
    ]
    log = spark.createDataFrame(entries, "list string, kind string, value string, added boolean, day date")
    rows = [
        (1, "http://A.example.com:80/x", day(9)), (2, "http://a.example.com./x", day(10)), (3, "https://u@a.example.com/x", day(69)),
        (4, "http://a.example.com/x", day(70)), (5, "http://b.example.com/ok/1", day(94)), (6, "http://b.example.com/ok/1", day(95)),
        (7, None, day(100)), (8, "nonsense", day(100)), (9, "http://b.example.com/", None), (2, "http://a.example.com./x", day(10)),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("times", F.lit("x"))
    got = sorted((r.page_id, r.blocked, r.first_block, r.n_allow) for r in urls.evaluate(df, log, "page_id", "url", "fetched").collect())
    host, domain = "host:a.example.com", "domain:example.com"
    assert got == [
        (1, False, None, 0), (2, True, host, 0), (2, True, host, 0), (3, True, host, 0), (4, False, None, 0),
        (5, True, domain, 0), (6, False, domain, 1), (7, False, None, 0), (8, False, None, 0), (9, False, None, 0),
    ]
    assert urls.evaluate(df.limit(0), log, "page_id", "url", "fetched").count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|im_end|>\n", "\\<|", "<\\|", "a\\\r\nb", "<<||>"])
def test_chat_escapes_are_reversible(text):
    turns = [{"role": "assistant", "text": text}, {"role": f"x{text}", "text": text}]
    whole, spans = chat.formatted(turns)
    assert chat.parsed(whole) == [(t["role"], t["text"]) for t in turns]
    assert [chat.unescape(whole[s["begin"] : s["end"]]) for s in spans] == [text]
    assert whole.count(chat.START) == whole.count(chat.END) == 2


def test_reply_trees(spark):
    rows = [("r", None, 1.0), ("a", "r", 1.0), ("b", "r", 5.0), ("c", "a", 9.0), ("d", "b", None), ("e", "b", 0.0),
            ("lost", "gone", 2.0), ("x", "y", 1.0), ("y", "x", 1.0), (None, "r", 1.0)]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "node string, parent string, score double")
    found = {}
    for r in chat.paths(df).collect():
        found.setdefault(r.leaf, []).append((r.place, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {
        "c": ["r", "a", "c"], "lost": ["lost"], "n19": [f"n{i}" for i in range(20)]
    }
    assert chat.paths(df, branches=3).select("leaf").distinct().count() == 5
    assert chat.paths(df.limit(0)).count() == 0


def test_reply_trees_with_tailed_circles(spark):
    rows = [("x", "y", 1.0), ("y", "x", 1.0), ("a", "x", 9.0), ("b", "a", 9.0), ("c", "a", 0.0), ("s", "s", 1.0), ("t", "s", 1.0)]
    rows += [("p", "q", 1.0), ("q", "o", 1.0), ("o", "p", 1.0), ("d", "q", 1.0), ("r", None, 1.0), ("e", "r", 1.0)]
    df = spark.createDataFrame(rows, "node string, parent string, score double")
    for branches in (1, 9):
        got = sorted((r.leaf, r.place, r.node) for r in chat.paths(df, branches).collect())
        assert got == [("e", 0, "r"), ("e", 1, "e")]
    assert chat.paths(df.where("node IN ('x', 'y', 'a')")).count() == 0


def test_chat_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (1, 1, "assistant", "yo <|im_end|>"), (2, None, None, None), (None, 1, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("node", F.lit("x"))
    back = chat.summary(chat.read(chat.write(chat.conversations(chat.from_turns(df)))))
    got = {r.conv_id: r for r in back.collect()}
    said = "user\nhi\nassistant\nyo <|im_end|>\nassistant\nyo <|im_end|>\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].n_turns == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"yo <|im_end|>" * 2).hexdigest() and got[None].loss_chars == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and len(got) == 3


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 300_000
    rows = [(3, "http://x/a b\r\n", big), (1, None, big), (7, "u", None), (8, "u", "short"), (9, "u", "short"), (None, "u", "n" * 200), (4, "v", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {p: r.refers_to for p, r in got.items()} == {3: 1, 1: None, 4: 1, 7: None, 8: None, 9: None, None: None}
    assert {p for p, r in got.items() if r.record_type == "revisit"} == {3, 4}
    assert warc.round_trip(df.limit(0)).count() == 0
    chunks = warc.read(warc.write(warc.chunked(warc.records(df), 1000), str(tmp_path)), 1000)
    one = chunks.where("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in one).decode() == big
    assert one[4].digest_so_far == hashlib.sha256(big.encode()[:5000]).hexdigest()


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(cast(id % 300 AS string), 90) AS html")
    archives = warc.write(warc.chunked(warc.records(pages.repartition(8))), str(tmp_path))
    assert warc.read(archives).rdd.getNumPartitions() == archives.count() > 1


def test_warc_cut_short():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc"
    with pytest.raises(ValueError):
        list(warc.archive_chunks(io.BytesIO(record)))


def test_pipeline_stages_with_clashing_columns(spark):
    names = "lang__ SCORE__ id__ source__ size__ copies__ row__ kept__ row id text_ digest n component".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    wide = docs.selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(names)])
    plain, rows = docs, wide
    for name, stage in corpus_pipeline.STAGES:
        plain, rows = stage(spark, plain, None), stage(spark, rows, None)
        if name != "byte-level bpe":
            assert rows.columns == wide.columns
            assert rows.select([c for c in names]).distinct().count() <= 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))


def test_a_word_as_long_as_a_chunk(spark):
    word = "a" * minhash._CHUNK
    rows = [(1, word), (2, word + " "), (3, " " + word), (4, word + "a"), (5, word + "a ")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, names = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, None)
        names.append(name)
        if name != "byte-level bpe":
            assert rows.columns == docs.columns
    assert rows.count() == before.count() > 0
    decoded = {r.decoded_sha256 for r in rows.collect()}
    assert decoded == {hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}


def mix_of(rows):
    """Copies of each (id, source, size) by the rules of the mix: docstrings of mixing."""
    sizes, times = {}, {}
    for i, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
        key = (i, source, len(words(text)))
        times[key] = times.get(key, 0) + 1
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        share = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        above = {s: 2.0 * sizes[s] for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not above:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= above
        open_ -= set(above)
    copies = {}
    for s in order:
        whole = math.floor(target[s] / sizes[s])
        quota, before = target[s] - whole * sizes[s], 0
        drawn = lambda k: hashlib.md5(f"mix{'null' if k[0] is None else k[0]}".encode()).hexdigest()[:15]
        for key in sorted((k for k in times if k[1] == s), key=lambda k: (drawn(k), k[0] or 0, k[2])):
            n = key[2] * times[key]
            copies[key] = whole + (quota > 0 and 2 * before + n <= 2 * quota)
            before += n
    return copies


def test_pipeline_run_equals_plain_chain(spark, tmp_path):
    draw = random.Random(13)
    vocabulary = {"en": "the house and dog with every weather thought should", "es": "la casa y el perro con cada tiempo debería niño"}
    rows = []
    for i in range(160):
        lang = draw.choice(["en", "es"])
        text = " ".join(draw.choice(vocabulary[lang].split()) for _ in range(draw.choice([3, 12, 40, 90])))
        rows.append((i, text, draw.choice([lang, lang, None]), draw.choice(["web"] * 6 + ["books", "code", None])))
    rows += [(200 + i, rows[7][1], rows[7][2], "web") for i in range(30)]
    for i in range(40):  # copies with some words of their own, in another source
        text = rows[draw.randrange(160)][1].split(" ")
        text[draw.randrange(len(text))] = f"weather{i}"
        rows.append((300 + i, draw.choice([" ", "\n"]).join(text), None, draw.choice(["copies", None])))
    junk = [None, "", " \n", "123 !! 456", "\u2603 \u2603"]
    rows += [(400 + i, text, draw.choice(["en", None]), "web") for i, text in enumerate(junk)]
    rows += [(None, rows[3][1], "en", "books"), (None, rows[3][1], "en", "books"), (None, rows[5][1], None, None), (None, None, None, "web")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = langid.fit(df)
    said = [(row, model.classify(row[1])) for row in rows]
    known = [row for row, (lang, score) in said if lang != "und" and score >= 0.5]
    assert len(known) == len(rows) - len(junk) - 1
    sets = {row[0]: shingles(row[1]) for row in known if row[0] is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    lowest = groups_of(list(sets), links)
    left = [row for row in known if row[0] is None or lowest[row[0]] == row[0]]
    copies = mix_of(left)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(encode.vocabulary_path()), special_tokens={})
    want = []
    for i, text, _, source in left:
        ids = library.encode_ordinary(text)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want += [(str(i), len(ids), digest(",".join(map(str, ids))), digest(text))] * copies[i, source, len(words(text))]
    assert len(left) < len(known) and set(copies.values()) >= {1, 2}
    assert got == sorted(want)

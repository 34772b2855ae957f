"""Content sort, sessions and the filter audit: against brute force, with groups cut by partitions and odd inputs."""

import hashlib
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import content_sort, filter_audit, sessions

DOCS = "doc_id bigint, text string, lang string, source string, keep_id string, lead int, `key` int, number int"
WHITE = re.compile(r"[\x20\x09-\x0d]+")


def doc(i, text, source="s"):
    return (i, text, "en", source, "k", 1, 2, 3)


LONG = "word " * 30_000
ODD = [doc(1, "a b"), doc(1, "a b"), doc(0, "a\t\n b"), doc(2, None), doc(3, ""), doc(None, ""), doc(None, "only"), doc(None, "only"), doc(4, LONG), doc(5, LONG.replace(" ", "\r\n")), doc(6, " "), doc(7, " \x0b\x0c "), doc(8, "日本語 🎉"), doc(9, "a b"), doc(10, "a B")]


# ---- content sort


def exact(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[WHITE.sub(" ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def sorted_groups(df, **options):
    return sorted(map(tuple, content_sort.exact_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_exact_groups_of_odd_rows(spark, partitions):
    assert sorted_groups(spark.createDataFrame(ODD, DOCS), partitions=partitions) == exact(ODD)


def test_exact_groups_without_rows(spark):
    assert sorted_groups(spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("partitions", [2, 7, 60])
def test_hot_groups_lie_over_many_partitions(spark, monkeypatch, partitions):
    """A third of all rows is one text, another third near copies of it that differ behind the lead of the splitters."""
    monkeypatch.setattr(content_sort, "PIECE", 16)
    hot = "the same lead " * 20
    rows = [doc(i, hot if i % 3 == 0 else f"{hot}{i % 9}" if i % 3 == 1 else f"text {i}") for i in range(900)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted_groups(df, partitions=partitions) == exact(rows)


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    """Splitters may cut between different texts of one lead and one hash; whole texts decide."""
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    lead = "x" * 70
    rows = [doc(i, f"{lead}{i % 4}") for i in range(200)]
    assert sorted_groups(spark.createDataFrame(rows, DOCS), partitions=9) == exact(rows)


def test_rows_that_stay(spark):
    df = spark.createDataFrame([*ODD, doc(11, "a b"), doc(1, "a  b")], DOCS).withColumn("sha", F.lit("own"))
    got = content_sort.without_copies(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id, WHITE.sub(" ", r.text or "")) for r in got.collect() if r.doc_id is not None)
    assert kept == [(i, WHITE.sub(" ", dict((x[0], x[1]) for x in ODD)[i] or "")) for i in (0, 2, 4, 6, 8, 9, 10)]
    assert got.where("doc_id IS NULL").count() == 1


def test_identifiers_of_another_kind(spark):
    got = content_sort.exact_groups(spark.createDataFrame([("b", "t"), ("a", "t")], "name string, body string"), "name", "body")
    assert sorted((r.name, r.keep_id, r.kept) for r in got.collect()) == [("a", "a", True), ("b", "a", False)]


def test_a_group_larger_than_batches(spark):
    """Whole batches from Spark lie within one group."""
    rows = [doc(i, "hot" if i % 3 else None if i % 2 else f"t{i}") for i in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted_groups(spark.createDataFrame(rows, DOCS), partitions=4) == exact(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "double", "date", "timestamp", "timestamp_ntz", "binary"])
def test_identifiers_of_any_kind(spark, kind):
    ids = F.col("i").cast("timestamp").cast(kind) if kind[:4] in ("date", "time") else F.col("i").cast("string").cast(kind)
    df = spark.createDataFrame([(86_400 * i if kind[:4] in ("date", "time") else i, "t" if i < 3 else None) for i in range(6)], "i int, text string").select("i", "text", ids.alias("doc_id"))
    got = content_sort.exact_groups(df)
    assert got.schema["doc_id"].dataType == got.schema["keep_id"].dataType == df.schema["doc_id"].dataType
    least = df.groupBy("text").agg(F.min("doc_id").alias("least"))
    want = df.join(least, df.text.eqNullSafe(least.text)).select("doc_id", "least", F.lit(3).cast("long"), F.col("doc_id") == F.col("least"))
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept").collect())) == sorted(map(tuple, want.collect()))


def test_partitions_grow_with_texts(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "SHARE", 1000)
    seen = []
    monkeypatch.setattr(content_sort, "cut", lambda df, old=content_sort.cut: (seen.append(df), old(df))[1])
    content_sort.exact_groups(spark.createDataFrame([doc(i, "x" * 500) for i in range(100)], DOCS))
    assert seen[0].rdd.getNumPartitions() == 50


def test_a_group_holds_its_identifiers_and_not_its_texts(monkeypatch):
    """Batches come as they do from Spark: all columns of one share a buffer."""
    monkeypatch.setattr(content_sort, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda _: 0})())}))
    names, size, held = ["key", "id", "text"], 1000, []
    base = pa.total_allocated_bytes()

    def batches():
        for k in range(40):
            held.append(pa.total_allocated_bytes() - base)
            sink = pa.BufferOutputStream()
            batch = pa.record_batch([pa.array([7] * size), pa.array(range(k * size, (k + 1) * size)), pa.array(["x" * 1000] * size)], names=names)
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()

    got = pa.Table.from_batches(content_sort._neighbours(batches()))
    assert got["id"].to_pylist() == [*range(40 * size)] and set(got["n"].to_pylist()) == {40 * size}
    assert max(held) < 8 * size * 1000  # of 40 MB of texts


# ---- sessions

CLICKS = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, client_id bigint, kind string, value double, piece int, head string"
T0 = datetime(2024, 1, 1)
MICRO = timedelta(microseconds=1)


def click(i, client, minutes, kind="view", value=1.0, late=0.0, micros=0):
    ts = None if minutes is None else T0 + timedelta(minutes=minutes) + micros * MICRO
    return (i, ts, None if ts is None else ts + timedelta(minutes=late), client, kind, value, 1, "h")


def brute_sessions(rows):
    us = lambda t: (t - datetime(1970, 1, 1)) // MICRO
    once = {}
    for i, ts, at, client, kind, value, *_ in rows:
        if None not in (i, ts, client):
            cents = 0 if value is None or value != value else int(np.floor(100 * value + 0.5))
            c = (client, us(ts), at is not None and us(at) - us(ts) > 3_600_000_000, kind == "purchase" and value is not None and value == value and value >= 60, cents)
            once[i] = min(once.get(i, c), c)
    of = defaultdict(list)
    for i, c in once.items():
        of[c[0]].append((c[1], i, *c[2:]))
    out = []
    for client, clicks in of.items():
        found = []
        for t, i, _, final, cents in sorted(x for x in clicks if not x[2]):
            if found:
                s = found[-1]
                why = "end" if s["final"] else "gap" if t - s["end"] >= 1_800_000_000 else "length" if t - s["start"] > 7_200_000_000 else None
                if why:
                    s["why"] = why
            if not found or why:
                found.append({"start": t, "ids": [], "cents": 0, "why": None})
            s = found[-1]
            s["ids"].append(i)
            s["end"], s["final"] = t, final
            s["cents"] += cents
        for s, after in zip(found, [*found[1:], None], strict=False):
            late = sum(1 for x in clicks if x[2] and s["start"] <= x[0] and (after is None or x[0] < after["start"]))
            path = hashlib.sha256(",".join(map(str, s["ids"])).encode()).hexdigest()
            out.append((client, s["ids"][0], s["start"], s["end"], len(s["ids"]), late, s["cents"], s["why"] or ("end" if s["final"] else "none"), path))
    return sorted(out)


def got_sessions(spark, rows, **options):
    return sorted(map(tuple, sessions.sessions(spark.createDataFrame(rows, CLICKS), **options).collect()))


EDGES = [
    click(1, 1, 0), click(2, 1, 30, micros=-1), click(3, 1, 60, micros=-1), click(4, 1, 89), click(5, 1, 118), click(6, 1, 120), click(7, 1, 120, micros=1),  # no gap; exactly the length, and beyond it
    click(8, 2, 0), click(9, 2, 30), click(10, 2, 40, "purchase", 60.0), click(11, 2, 40), click(12, 2, 41, "purchase", 59.99), click(13, 2, 42, "purchase", 1e9), click(14, 2, 80),
    click(20, 3, 0, late=60), click(21, 3, 1, late=61), click(22, 3, 29, late=100), click(23, 3, 31), click(24, 3, 31, late=61), click(19, 3, 0, late=61), click(18, 3, -1, late=61),
    click(30, 4, 0, "purchase", 70.0), click(31, 4, 0, "purchase", 70.0), click(32, 4, 0), click(33, 4, 0, late=61),  # sessions that begin at one time
    click(40, 5, 0, None, None), click(41, 5, 1, "purchase", None), click(42, 5, 2, None, 99.0), click(43, 5, 3, "view", float("nan")), click(44, 5, 4, "view", -0.005), click(44, 5, 4, "view", -0.005), click(45, 5, 4, "view", 1.005),
    click(50, 6, 0, late=90), click(51, 6, 5, late=90), click(60, None, 0), click(61, 7, None), click(None, 7, 0), (62, T0, None, 7, "view", 1.0, 1, "h"),
]


@pytest.mark.parametrize("pieces", [1, 4, 50])
def test_sessions_at_their_edges(spark, pieces):
    assert got_sessions(spark, EDGES, pieces=pieces) == brute_sessions(EDGES)


def random_clicks(seed, n=1500, quiet=False):
    """A third of the clicks has one client. quiet: no gaps and no final clicks, so only the length ends sessions."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        client = 1 if i % 3 == 0 or quiet else r.randrange(2, 30)
        kind = "view" if quiet else r.choice(["view", "click", "purchase", None])
        rows.append(click(i, client, i * 7 if quiet else r.choice([r.randrange(6000), r.randrange(60)]), kind, r.choice([None, round(r.uniform(-5, 120), 2)]), late=r.choice([0, 1, 59, 61, 300]) if not quiet or i % 5 else 61, micros=r.randrange(3)))
    rows += r.sample(rows, n // 20)
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "pieces", "quiet"), [(1, 1, False), (2, 6, False), (3, 90, False), (4, 12, True)])
def test_sessions_against_brute_force(spark, seed, pieces, quiet):
    rows = random_clicks(seed, quiet=quiet)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # sessions go on from batch to batch
    try:
        assert got_sessions(spark, rows, pieces=pieces) == brute_sessions(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_client_takes_many_pieces(spark):
    """The state machine's rows of one client lie in many pieces, none with much more than its share."""
    rows = [click(i, 1, i * 2, "purchase" if i % 9 == 0 else "view", 99.0) for i in range(4000)]
    seen = []
    stored = sessions.cut
    try:
        sessions.cut = lambda df: seen.append(stored(df)) or seen[-1]
        got = got_sessions(spark, rows, pieces=10)
    finally:
        sessions.cut = stored
    pieces = {r.piece: r["count"] for r in seen[-1].where("NOT head").groupBy("piece").count().collect()}
    assert len(pieces) == 10 and max(pieces.values()) < 800 and got == brute_sessions(rows)


def test_sessions_in_any_zone_and_of_nothing(spark):
    want = brute_sessions(EDGES)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert got_sessions(spark, EDGES) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got_sessions(spark, []) == []


# ---- filter audit


def brute_mask(text):
    words = [w for w in WHITE.split(text) if w]
    caps = len(re.findall("[A-Z]", text))
    return (len(words) < 50) * 1 + (100 * len(set(words)) < 65 * len(words)) * 2 + (100 * caps > 5 * len(text)) * 4 + bool(re.search(r"[#$%&*|]", text)) * 8


def brute_audit(rows, labels):
    least = defaultdict(list)
    for i, text, *_ in rows:
        least[text or ""] += [i] if i is not None else []
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for i, text, _, source, *_ in rows:
        ids = least[text or ""]
        again = bool(ids) and (i is None or i > min(ids))
        parts[source or ""].append((brute_mask(text or "") + 16 * again, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                here = [d for d in docs if d[0] & bit and not d[0] & before]
                shapley[f] += len(here)
                out[part, "".join(order), step + 1] = [sum(not d[0] & (before | bit) for d in docs), len(here), sum(bool(d[0] & bit and d[0] & before) for d in docs), sum(d[0] == bit for d in docs), sum(d[1] for d in here), sum(d[2] for d in here)]
                before |= bit
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def audited(spark, rows, labels):
    masks = filter_audit.document_masks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(masks).collect()}


def random_texts(n, seed=1):
    r = random.Random(seed)
    words = ["one", "Two", "THREE", "vier", "fünf", "a|b", "日本", "🎉", "x#", "six", "seven", "A"]
    for _ in range(n):
        k = r.choice([0, 3, 49, 50, 51, 90])
        yield "".join(r.choice(words) * r.choice([1, 1, 2]) + r.choice([" ", "\n", "\t\x0b ", "\r\n"]) for _ in range(k))


def test_audit_against_brute_force(spark):
    texts = [*random_texts(60)]
    r = random.Random(2)
    rows = [doc(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(200)] + ODD + [doc(3, "again"), doc(3, "again")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 200, 2)] + [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (9999, 1, 1)]
    got = audited(spark, rows, labels)
    assert got == brute_audit(rows, labels) and len(got) == 600 * 4  # null and empty sources are one part


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [doc(1, None, None)], []) == brute_audit([doc(1, None, None)], [])


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_scan_reads_buffers(bits):
    """Slices, nulls and texts of every kind; short hashes collide, and whole words decide."""
    texts = ["skipped one", *random_texts(40, 3), None, "", " ", "a a\tb\x0bb", "\x85\xa0 x", "end ", LONG[:500], "skipped too"]
    for kind in (pa.string(), pa.large_string()):
        got = filter_audit.scan(pa.array(texts, kind).slice(1, len(texts) - 2), (1 << bits) - 1)
        for k, text in enumerate(x or "" for x in texts[1:-1]):
            words = [w for w in WHITE.split(text) if w]
            want = {"words": len(words), "distinct": len(set(words)), "capitals": len(re.findall("[A-Z]", text)), "symbols": len(re.findall(r"[#$%&*|]", text)), "points": len(text)}
            assert {n: int(v[k]) for n, v in got.items()} == want, text


def test_scan_of_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "LONG", 64)
    for text in [*random_texts(30, 5), "x" * 200, "y" * 100 + " " + "z" * 300 + "\n", ""]:
        body = memoryview(text.encode())
        assert b"".join(filter_audit._pieces(body, 16)) == text.encode()
        got, want = filter_audit.scan_long(body), filter_audit.scan(pa.array([text]))
        assert got == {n: int(v[0]) for n, v in want.items()}

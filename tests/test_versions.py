"""Schemas, loose JSON, versions of tables, the response cache, files in and out, helpers in SQL."""

import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from helpers import values
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import case, schema, sql_helpers, template
from sparkloom.functions.schema import Anything, Entries, Flag, Int, Items, Null, Number, OneOf, Optional, Record, Text, Union
from sparkloom.operators import drift, loose
from sparkloom.sinks import fan_out
from sparkloom.sources import captured
from sparkloom.streaming import responses

# ---- schemas


def issues(spark, s, *texts):
    got = values(spark, s.issues_of_json, texts)
    return [[(".".join(i.path), i.code, i.message) for i in x] for x in got]


def expected(kind, received, path=""):
    return (path, "invalid_type", f"Invalid input: expected {kind}, received {received}")


def test_types_of_values(spark):
    each = {"string": Text(), "boolean": Flag(), "number": Number(), "array": Items(Anything()), "object": Record({}), "null": Null()}
    samples = {"string": '"x"', "boolean": "false", "number": "1e3", "array": "[1]", "object": '{"a":1}', "null": "null"}
    for kind, s in each.items():
        got = issues(spark, s, *samples.values())
        assert got == [[] if k == kind else [expected(kind, k)] for k in samples]
    assert issues(spark, Int(), "1", "1.0", "1.5", "9007199254740992", "-3", '"1"', "true") == [[], [], [expected("int", "number")], [expected("int", "number")], [], [expected("number", "string")], [expected("number", "boolean")]]
    assert issues(spark, Text(), None, "", "{") == [[("", "invalid_json", "Invalid JSON")]] * 3


def test_all_checks_of_a_text(spark):
    def of(name):
        return [m for p, _, m in issues(spark, schema.WORKER_OPTIONS, json.dumps({"name": name, "features": ["entryPoint"]}))[0]]

    empty, long, letters, hyphen = schema.NAME.least[1], schema.NAME.most[1], schema.NAME.patterns[0][1], schema.NAME.patterns[1][1]
    assert of("") == [empty, letters, hyphen] and of("a" * 54) == of("a") == [] and of("-" * 55) == [long, hyphen]
    assert of("A_" * 30) == [long, letters, hyphen] and of("a-") == [hyphen] and of("a\n") == [letters, hyphen] and of("é") == [letters, hyphen]


def test_paths_into_lists_and_maps(spark):
    s = Record({"a": Items(Items(Int())), "m": Entries(Record({"x": Text(), "y": Optional(Flag())})), "u": Union([Items(Text()), Null()]), "e": OneOf(["p", "q"])})
    good = {"a": [[1], []], "m": {"k.1": {"x": ""}}, "u": None, "e": "q", "more": {"kept": 1}}
    bad = {"a": [[1, "2"], 3, [None]], "m": {"k": {"y": None}, "b": [], "z": {"x": 1, "y": True}}, "u": [1], "e": "r"}
    got = issues(spark, s, json.dumps(good), json.dumps(bad), "{}")
    assert got[0] == []
    assert got[1] == [expected("number", "string", "a.0.1"), expected("array", "number", "a.1"), expected("number", "null", "a.2.0"), expected("object", "array", "m.b"), expected("string", "undefined", "m.k.x"), expected("boolean", "null", "m.k.y"), expected("string", "number", "m.z.x"), ("u", "invalid_union", "Invalid input"), ("e", "invalid_value", 'Invalid option: expected one of "p"|"q"')]
    assert got[2] == [expected("array", "undefined", "a"), expected("record", "undefined", "m"), ("u", "invalid_union", "Invalid input"), ("e", "invalid_value", 'Invalid option: expected one of "p"|"q"')]


def test_moments(spark):
    good = ["2024-02-29T00:00:00Z", "2024-02-29T23:59Z", "2024-02-29T23:59:59.123456789Z"]
    bad = ["2024-02-30T00:00:00Z", "2024-02-29T24:00:00Z", "2024-02-29T00:00:00", "2024-02-29T00:00:00+01:00", "2024-02-29", "x"]
    assert values(spark, schema.iso_datetime_ok, good + bad) == [True] * 3 + [False] * 6


def test_issues_run_in_the_jvm(spark):
    df = spark.createDataFrame([("{}",)], "x string").select(schema.TASK_CONFIG.issues_of_json(F.col("x")).alias("i"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert values(spark, schema.TASK_CONFIG.first_message, ['{"tasks":{}}', "{}"]) == [None, "Invalid input: expected record, received undefined"]


# ---- loose JSON files

FILES = "path string, text string"


def test_forms_of_json(spark):
    texts = ['{ "b" : [1,\n "a  \\" b"] , "a": null }', '{"a":null,"b":[1,"a  \\" b"]}', "{", None, '"x y"']
    assert values(spark, loose.order_free, texts) == ['{"a":null,"b":[1,"a  \\" b"]}'] * 2 + [None, None, '"x y"']
    assert values(spark, loose.order_bound, texts) == ['{"b":[1,"a  \\" b"],"a":null}', '{"a":null,"b":[1,"a  \\" b"]}', None, None, '"x y"']
    long = json.dumps({"k": 'q"\\' * 50_000, "z": [" "] * 1000}, indent=2)
    assert values(spark, loose.order_bound, [long]) == [json.dumps(json.loads(long), separators=(",", ":"))]


def test_files_to_write(spark):
    held = spark.createDataFrame([("a", '{"x": 1, "y": 2}'), ("b", '{"y":2,"x":1}'), ("c", "{}"), ("d", "{broken"), ("e", "{broken"), ("f", None)], FILES)
    want = spark.createDataFrame([("a", '{"x":1,"y":2}'), ("b", '{"x":1,"y":2}'), ("d", "{broken"), ("e", "{}"), ("f", None), ("g", "{}")], FILES)
    got = {r.path: r.state for r in loose.compared(held, want).collect()}
    assert got == {"a": "same", "b": "differs", "c": "unwanted", "d": "same", "e": "differs", "f": "same", "g": "missing"}
    assert {r.path for r in loose.writes(held, want, ordered=False).collect()} == {"e", "g"}
    assert [r.path for r in loose.checked(held.where("path = 'a'"), want.where("path = 'a'")).collect()] == ["a"]
    with pytest.raises(PySparkException, match="g does not match its source"):
        loose.checked(held, want.where("path = 'g'")).collect()
    assert loose.compared(held.limit(0), want.limit(0)).count() == 0


def test_guards(spark):
    there = spark.createDataFrame([("w/wrangler.toml", ""), ("w/x.json", ""), ("wrangler.json", "")], FILES)
    want = spark.createDataFrame([(p, "{}") for p in ("w/wrangler.json", "v/wrangler.json", "wrangler.jsonc", "w/deep/wrangler.json", "w/x.json")], FILES)
    assert {r.path: r.blocked_by for r in loose.guarded(there, want).collect()} == {"w/wrangler.json": "w/wrangler.toml", "v/wrangler.json": None, "wrangler.jsonc": "wrangler.json", "w/deep/wrangler.json": None, "w/x.json": "w/wrangler.toml"}


# ---- versions of tables


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_changes_against_brute_force(spark, kind):
    r = random.Random(4)
    key = lambda i: None if i == 0 else i if kind == "bigint" else f"k{i}"
    old = [(key(r.randrange(-200, 200)), r.choice([None, "a", "b"]), r.choice([None, 1.5, -0.0])) for _ in range(300)]
    new = [x for x in old if r.random() > 0.1] + [(key(r.randrange(150, 260)), "c", None) for _ in range(20)] + old[:5]
    frames = [spark.createDataFrame(x, f"k {kind}, `range` string, v double") for x in (old, new)]
    a, b = Counter(old), Counter(new)
    more, less = {x[0] for x in (b - a)}, {x[0] for x in (a - b)}
    want = {k: "changed" if k in more & less else "added" if k in more else "removed" for k in more | less}
    got = drift.changes(frames[0], frames[1].select("v", "range", "k"), "k", width=16)
    assert {x.k: x.change for x in got.collect()} == want
    assert drift.changes(frames[0], frames[0], "k").isEmpty() and drift.changes(frames[0].limit(0), frames[0].limit(0), "k").isEmpty()
    assert {x.change for x in drift.changes(frames[0].limit(0), frames[1], "k").collect()} == {"added"}


def test_only_differing_ranges_are_compared(spark):
    old = spark.range(100_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    new = old.withColumn("v", F.when(F.col("k") == 77_777, 2).otherwise(1))
    trees = [drift.digest_tree(t, "k", 1024) for t in (old, new)]
    assert [r.node for r in drift.differing_ranges(*trees).collect()] == [77_777 // 1024]
    assert {r.level: r.n for r in trees[0].groupBy("level").agg(F.sum("n").alias("n")).collect()} == dict.fromkeys(range(4), 100_000)
    kept = drift.differing_ranges(*trees)
    assert [tuple(r) for r in drift.changes(old, new, "k", 1024, ranges=kept).collect()] == [(77_777, "changed")]


def test_digests_tell_nulls_and_repeated_rows(spark):
    rows = lambda *x: spark.createDataFrame([*x], "k int, a string, b string")
    assert [r.change for r in drift.changes(rows((1, None, "x")), rows((1, "x", None)), "k").collect()] == ["changed"]
    assert [r.change for r in drift.changes(rows((1, "x", "x"), (1, "x", "x")), rows((1, "y", "y"), (1, "y", "y")), "k").collect()] == ["changed"]
    assert [r.change for r in drift.changes(rows((1, "x", "x")), rows((1, "x", "x"), (1, "x", "x")), "k").collect()] == ["added"]


# ---- the response cache


REQUESTS = "url string, method string, ts timestamp, status int"
T0 = datetime(2024, 1, 1)
RULES = [(200, 60), (404, 7), (200, 1)]


def answers(rows, rules=RULES):
    """One request after another."""
    ttl = {}
    for status, t in rules:
        ttl.setdefault(status, t)
    ends, out = {}, []
    for url, method, ts, status in sorted(rows, key=lambda r: (int((r[2] - T0) / timedelta(milliseconds=1)), r[3] is not None, r[3] or 0, r[2])):
        key, ms = " ".join(x for x in (url, method) if x is not None), int((ts - T0) / timedelta(milliseconds=1))
        hit = ms < ends.get(key, -1)
        if not hit and ttl.get(status):
            ends[key] = ms + 1000 * ttl[status]
        out.append((key, ts, status, hit))
    return sorted(out, key=str)


def random_requests(seed, n=600):
    r = random.Random(seed)
    return [("hot" if i % 3 else f"u{r.randrange(6)}", "GET", T0 + timedelta(milliseconds=r.choice([r.randrange(400_000), r.randrange(400) * 1000]), microseconds=r.choice([0, 0, 7])), r.choice([200, 404, 500, None])) for i in range(n)]


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 7), (3, 50)])
def test_cache_of_a_hot_key(spark, seed, partitions):
    rows = random_requests(seed)
    got = responses.cached_table(spark.createDataFrame(rows, REQUESTS), RULES, partitions=partitions)
    assert sorted(map(tuple, got.collect()), key=str) == answers(rows)


def test_cache_without_python_and_of_nothing(spark):
    got = responses.cached_table(spark.createDataFrame(random_requests(4), REQUESTS), RULES)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert responses.cached_table(spark.createDataFrame([], REQUESTS), RULES).count() == 0
    assert [r.hit for r in responses.cached_table(spark.createDataFrame([("a", "GET", T0, 500)] * 3, REQUESTS), RULES).collect()] == [False] * 3


def test_cache_of_many_stored_responses(spark):
    """A chain of 3,000 responses of one key, each stored as the one before ends."""
    rows = [("hot", "GET", T0 + timedelta(seconds=30 * i), 200) for i in range(6000)]
    got = responses.cached_table(spark.createDataFrame(rows, REQUESTS), RULES, partitions=8)
    assert Counter(r.hit for r in got.collect()) == {True: 3000, False: 3000}


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_cache_as_a_stream(spark, rocksdb, tmp_path):
    """Agrees with the table on requests in order, goes on from its checkpoint, and drops state after its end."""
    rows = sorted(random_requests(5, 240), key=lambda r: (r[2].replace(microsecond=r[2].microsecond // 1000 * 1000), r[3] is not None, r[3] or 0, r[2]))
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run(part, n):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(source)
        q = responses.cached_stream(stream, RULES, lateness="1 second").writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.lastProgress

    for at in range(0, 240, 80):  # each run starts from the checkpoint of the one before
        cut = rows[at : at + 80]
        run(cut, at)
    assert sorted(map(tuple, spark.read.schema(responses.OUTPUT).parquet(sink).collect()), key=str) == answers(rows)
    later = T0 + timedelta(days=1)
    run([("new", "GET", later, 500)], 240)
    last = run([("new", "GET", later + timedelta(hours=1), 500)], 241)
    assert sum(s["numRowsTotal"] for s in json.loads(last.json)["stateOperators"]) == 0


# ---- files in and out


@pytest.fixture
def sources(spark):
    spark.dataSource.register(captured.CapturedOutput)
    spark.dataSource.register(fan_out.TextFiles)


def read(spark, folder, ddl=None, **options):
    r = spark.read.format("captured_output").options(**options)
    return (r.schema(ddl) if ddl else r).load(str(folder))


def test_captured_output(spark, sources, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in {"a.json": '{"id": "1", "n": 2, "d": 1, "on": true, "t": "2024-01-02T03:04:05", "m": {"k": [1]}, "unknown": {}}', "sub/b.json": '{"id": null, "m": {}}', "_skipped": "x", ".hidden": "x"}.items():
        (tmp_path / name).write_text(text)
    ddl = "id string, n bigint, d double, on boolean, t timestamp, m map<string,array<int>>, s struct<x:string>"
    got = read(spark, tmp_path, ddl, partition_bytes=1)
    assert got.rdd.getNumPartitions() == 2
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(id="1", n=2, d=1.0, on=True, t=datetime(2024, 1, 2, 3, 4, 5), m={"k": [1]}, s=None), Row(id=None, n=None, d=None, on=None, t=None, m={}, s=None)]))
    assert read(spark, tmp_path).select("value").where("value LIKE '%unknown%'").count() == 1
    assert read(spark, tmp_path / "gone", ddl).count() == 0


@pytest.mark.parametrize("text", ["{", "[1]", '{"n": "2"}', '{"n": true}', '{"n": 1.5}', '{"m": {"k": 1}}', ""])
def test_captured_output_fails_fast(spark, sources, tmp_path, text):
    (tmp_path / "good").write_text("{}")
    (tmp_path / "bad").write_text(text)
    ddl = "n bigint, m map<string,array<string>>"
    with pytest.raises(PySparkException, match="bad"):
        read(spark, tmp_path, ddl).collect()
    assert [tuple(r) for r in read(spark, tmp_path, ddl, mode="permissive").collect()] == [(None, None)] * 2


def write(df, folder, mode="append"):
    df.write.format("text_files").mode(mode).save(str(folder))


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names}


def test_files_are_published_together(spark, sources, tmp_path):
    rows = [(f"d{i % 3}/{i}.md", f"text {i}" if i else None) for i in range(20)]
    write(spark.createDataFrame(rows, FILES).repartition(4), tmp_path / "out")
    assert tree(tmp_path / "out") == {p: t or "" for p, t in rows}
    write(spark.createDataFrame([("d0/0.md", "again"), ("new", "x")], FILES), tmp_path / "out")
    assert tree(tmp_path / "out")["d0/0.md"] == "again" and len(tree(tmp_path / "out")) == 21
    write(spark.createDataFrame([("only", "x")], FILES), tmp_path / "out", "overwrite")
    assert tree(tmp_path / "out") == {"only": "x"}


@pytest.mark.parametrize("rows", [[("../x", "")], [("/x", "")], [("a", "1"), ("b/../a", "2")], [(None, "x")], [("_staging-1/x", "")]])
def test_a_failed_write_changes_nothing(spark, sources, tmp_path, rows):
    (tmp_path / "old").write_text("old")
    good = [(f"f{i}", "x") for i in range(6)]
    with pytest.raises(PySparkException):
        write(spark.createDataFrame([*good, *rows], FILES).repartition(3), tmp_path)
    assert tree(tmp_path) == {"old": "old"}


def test_repeated_tasks_leave_no_doubles(tmp_path):
    """Two attempts of one task and one that is lost: only what is committed is published."""
    w = fan_out._Writer(str(tmp_path), False)
    lost, first, other = (w.write(iter([Row(path=p, text=t)])) for p, t in (("a", "lost"), ("a", "kept"), ("b", "b")))
    w.commit([first, other])
    assert tree(tmp_path) == {"a": "kept", "b": "b"} and lost.folder != first.folder


def test_templates(spark):
    got = values(spark, lambda x: template.render("# {{ pascal name }} {{name}}{{ slug-p name }}!", {"name": x}), ["my app", None])
    assert got == ["# MyApp my appmy-apps!", "#  s!"]
    with pytest.raises(KeyError):
        template.render("{{ other }}", {})


# ---- helpers in SQL


def test_helpers_in_sql_are_the_column_functions(spark):
    names = sql_helpers.register(spark, "h_")
    inputs = ["fooBarHTTPServer", " Ünï's. x", "v2beta10 x", "", "  ", "ÀÉ ß", "a_b-c", "words", None, "12 34", "ǅ x", "日本 語"]
    df = spark.createDataFrame([(x,) for x in inputs], "x string")
    df.createOrReplaceTempView("h_inputs")
    calls = {f"h_{n.replace('-', '_')}": f for n, f in case.HELPERS.items()}
    assert set(calls) <= set(names)
    got = spark.sql(f"SELECT {', '.join(f'{n}(x) AS {n}' for n in calls)}, h_pascal_of(h_word_and_number_list(x)) AS apart FROM h_inputs")
    want = df.select(*(f(F.col("x")).alias(n) for n, f in calls.items()), case.pascal_case(F.col("x"), split=case.words_and_numbers).alias("apart"))
    assert got.collect() == want.collect()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert isinstance(got.schema["h_slug"].dataType, T.StringType)

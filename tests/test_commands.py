"""Configurations and commands with callbacks, and text in pieces."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators import records
from sparkloom.plans import commands


def test_configurations_of_a_callback(spark):
    texts = ['{"tasks": {}}', '{"$schema": "", "tasks": {}, "x": {"$schema": "in"}}', '{"$schema": "own", "tasks": {"a": {"dependsOn": ["b"]}}}']
    calls = []

    def made():
        calls.append(1)
        return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")

    link = f'"$schema":"{commands.DEFAULT_SCHEMA}"'
    got = [r.text for r in commands.defined(made).orderBy("path").collect()]
    assert calls == [1] and got == [f'{{"tasks":{{}},{link}}}', f'{{{link},"tasks":{{}},"x":{{"$schema":"in"}}}}', '{"$schema":"own","tasks":{"a":{"dependsOn":["b"]}}}']
    bad = spark.createDataFrame([("p", '{"tasks": {"a": {"cache": 1}}, "ui": "x"}'), ("q", None)], "path string, text string")
    errors = [r.error for r in commands.defined(bad, strict=False).orderBy("path").collect()]
    assert errors == ['Invalid configuration: Invalid input: expected boolean, received number at tasks.a.cache\nInvalid option: expected one of "stream"|"tui" at ui', "Invalid configuration: Invalid JSON"]
    with pytest.raises(PySparkException, match="Invalid configuration"):
        commands.defined(bad).collect()


def test_command_hook(spark):
    runs = spark.createDataFrame([(1, "i", "deploy", {"b": "1", "a": "2"}, {"CI": "0"}), (2, "none", "test", None, None)], "run int, item string, command string, args map<string,string>, env map<string,string>")
    items = spark.createDataFrame([("i", [({"id": "s"}, "K", "1"), ({"id": "s"}, "K", "2"), (None, "L", "3"), ({"id": "t"}, "M", "4")])], "id string, fields array<struct<section:struct<id:string>,label:string,value:string>>")
    sections = spark.createDataFrame([("s",)], "id string")
    seen = []
    got = {r.run: r for r in commands.command_runs(runs, items, sections, {"CI": "1", "PATH": "x"}, ["deploy"], before=lambda r: seen.append(r.columns)).collect()}
    assert seen == [runs.columns]  # a hook that returns nothing changes nothing
    assert got[1].options == '{"args":{"a":"2","b":"1"},"env":{"CI":"1"},"secrets":{"K":"2"}}' and got[2].options == '{"args":{},"env":{"CI":"1"},"secrets":{}}'
    assert got[1].words == ["op", "run", "--no-masking", "--", "dagger", "call", "deploy", "--docker-socket=/var/run/docker.sock", "--options=env://DAGGER_OPTIONS"] and len(got[2].words) == 8
    assert commands.command_runs(runs, items, sections, before=lambda r: r.where("run = 2")).count() == 1

    def stop(_):
        raise RuntimeError("not now")

    with pytest.raises(RuntimeError, match="not now"):
        commands.command_runs(runs, items, sections, before=stop)


def test_joined_pieces_are_the_joined_text(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"g{i % 5}" if i % 2 else None, None if i % 11 == 0 else f"v{i}", i) for i in range(500)], "g string, v string, i int")
    pieces = commands.joined_pieces(df, "g", "v", "i", ", ", rows=7).collect()
    whole = {r.g: r.text for r in df.groupBy("g").agg(records.joined(F.col("v"), F.col("i"), ", ").alias("text")).collect()}
    for g, text in whole.items():
        own = sorted((r.piece, r.text) for r in pieces if r.g == g)
        assert [k for k, _ in own] == [*range(len(own))] and ", ".join(t for _, t in own) == text and all(t.count(", ") <= 6 for _, t in own)

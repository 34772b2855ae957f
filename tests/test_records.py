import pytest
from helpers import rows, values
from pyspark.sql import functions as F

from sparkloom.functions import validate, web
from sparkloom.operators import records, recursive
from sparkloom.plans import secrets

NAME = [("my-worker", None), ("a", None), ("", "Worker name cannot be empty"), (None, "Worker name cannot be empty"), ("a" * 55, "Worker name cannot exceed 54 characters"), ("my_worker", "Worker name can only contain lowercase letters, numbers, and hyphens"), ("MyWorker", "Worker name can only contain lowercase letters, numbers, and hyphens"), ("-my-worker", "Worker name cannot start or end with a hyphen"), ("my-worker-", "Worker name cannot start or end with a hyphen"), ("-", "Worker name cannot start or end with a hyphen"), ("a\n", "Worker name can only contain lowercase letters, numbers, and hyphens")]


def test_name_messages(spark):
    assert values(spark, validate.name_error, [a for a, _ in NAME]) == [b for _, b in NAME]
    assert values(spark, validate.repository_name_ok, ["a.b", "..", "__", "a b", "_a"]) == [True, False, False, False, True]
    assert values(spark, lambda x: validate.one_of(x, validate.MANAGERS), ["bun", "pip", "", None]) == [True, False, False, False]


def test_worker_config(spark):
    df = spark.createDataFrame([(0, "n", ["entryPoint"], "src/index.ts", "./public"), (1, "n", ["staticAssets"], None, "./public"), (2, "n", ["entryPoint", "staticAssets"], "src/index.ts", "./public"), (3, "bad name", ["entryPoint"], "x", None), (4, "n", [], None, None)], "i int, name string, f array<string>, e string, a string")
    got = rows(df.select("i", F.to_json(validate.worker_config(F.col("name"), F.col("f"), F.col("e"), F.col("a"), F.lit("2024-01-15"))).alias("c"), validate.options_error(F.col("name"), F.col("f")).alias("e")), "i")
    assert got[0][1] == '{"name":"n","main":"src/index.ts","compatibility_date":"2024-01-15","observability":{"enabled":true}}' and got[0][2] is None
    assert got[1][1] == '{"name":"n","compatibility_date":"2024-01-15","assets":{"directory":"./public"}}'
    assert '"binding":"ASSETS"' in got[2][1]
    assert got[3][2].startswith("Worker name can only") and got[4][2] == "At least one feature must be selected"


def test_soft_and_strict_json(spark):
    got = values(spark, lambda x: validate.json_soft(x, "a int, b string", required=["a"]), ['{"a":1,"z":2}', '{"b":"x"}', "{", '{"a":"no"}'])
    assert [(g.success, g.error) for g in got] == [(True, None), (False, "a is required"), (False, "malformed"), (False, "malformed")]
    with pytest.raises(Exception, match="MALFORMED"):
        values(spark, lambda x: validate.json_strict(x, "a int"), ['{"a":"no"}'])


def test_redaction(spark):
    urls = ["https://x/?key=1&KEY=2&a=b", "https://x/?token=1&token=2#key=3", "https://x/p", "https://x/?a=%zz&apikey=q", None]
    assert values(spark, web.redact, urls) == ["https://x/?key=REDACTED&KEY=REDACTED&a=b", "https://x/?token=REDACTED#key=3", "https://x/p", "https://x/?a=%25zz&apikey=REDACTED", None]
    assert values(spark, web.params_array, ["https://x/?a=1&b=x%20y&&c", "https://x"]) == [["a=1", "b=x y", "c="], []]


def test_errors(spark):
    df = spark.createDataFrame([(0, True, 401, "m"), (1, True, 404, "m"), (2, True, 503, "m"), (3, False, None, "m")], "i int, h boolean, s int, m string")
    got = [r.e for r in df.select("i", web.error_body(F.col("h"), F.col("s"), F.col("m")).alias("e")).orderBy("i").collect()]
    assert [(g.status, g.logged) for g in got] == [(401, False), (404, False), (503, True), (500, True)]
    assert "unauthorized" in got[0].body and '"m"' in got[1].body and "internal server error" in got[3].body


def test_lookups(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, k string")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(records.matching(left, right, "k", "k"), "i") == [(1, "a")]
    assert rows(records.unmatched(left, right, "k", "k"), "i") == [(2, "b"), (3, None)]
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    with pytest.raises(Exception, match="Secret b is undefined"):
        records.required_lookup(names, spark.createDataFrame([("a", "1"), ("b", "")], "name string, value string")).collect()
    assert values(spark, lambda x: records.first_rule(x, [(200, 1), (404, 2), (200, 3)]), [200, 404, 500, None], "int") == [1, 2, None, None]


def test_folds(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 2, 3), ("x", 3, 2), ("y", 4, 1)], "k string, v int, o int")
    assert rows(records.last_wins(df, "k", "v", ["o"]), "k") == [("x", 2), ("y", 4)]
    codes = spark.createDataFrame([(0,), (None,)], "c int")
    assert codes.agg(records.any_failed(F.col("c"))).first()[0] is True
    assert codes.where("c = 0").agg(records.any_failed(F.col("c"))).first()[0] is False
    assert codes.where("c = 9").agg(records.any_failed(F.col("c"))).first()[0] is False


def test_merges(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4", "a": None}), (None, {"x": "y"})], "l map<string,string>, h map<string,string>")
    assert [r.m for r in df.select(records.merged(F.col("l"), F.col("h")).alias("m")).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}]


def test_precedence_and_flags(spark):
    assert values(spark, records.package_manager, [["yarn.lock", "bun.lock"], ["package-lock.json"], []], "array<string>") == ["bun", "npm", "npm"]
    assert values(spark, lambda x: records.first_existing(records.ENTRY_POINTS, x), [["index.ts", "src/index.ts"], []], "array<string>") == ["src/index.ts", None]
    assert values(spark, lambda x: records.files_to_remove(x), [["claude", "cursor", "windsurf"]], "array<string>") == [["AGENTS.md"]]


def test_collation(spark):
    df = spark.createDataFrame([(x,) for x in "B é a A b".split()], "n string")
    assert [r.n for r in records.by_name(df, "n").collect()] == ["a", "A", "b", "B", "é"]


def test_extends(spark):
    chain = spark.createDataFrame([("app", "web", {"a": "1"}), ("web", "base", {"a": "2", "b": "2"}), ("base", None, {"b": "3", "c": "3"}), ("x", "y", {"p": "x"}), ("y", "x", {"p": "y", "q": "y"}), ("empty", None, {})], "config string, parent string, options map<string,string>")
    got = {r.config: r.options for r in recursive.resolve_extends(chain).collect()}
    assert got == {"app": {"a": "1", "b": "2", "c": "3"}, "web": {"a": "2", "b": "2", "c": "3"}, "base": {"b": "3", "c": "3"}, "x": {"p": "x", "q": "y"}, "y": {"p": "y", "q": "y"}, "empty": {}}


def secret_tables(spark):
    held = spark.createDataFrame([("A", "1"), ("B", "2"), ("C", "3")], "name string, value string")
    presets = spark.createDataFrame([("api", ["A", "B"]), ("cache", ["C"])], "preset string, names array<string>")
    variables = spark.createDataFrame([("A", "X", "x"), ("GONE", "Y", "y"), ("C", "Z", "z")], "name string, key string, value string")
    env = spark.createDataFrame([("CI", "true"), ("X", "over"), ("N", None)], "key string, value string")
    return held, presets, variables, env


def test_container_plan(spark):
    held, presets, variables, env = secret_tables(spark)
    names = secrets.secret_names(spark.createDataFrame([("GONE",)], "name string"), presets, spark.createDataFrame([("api",)], "preset string"))
    assert rows(secrets.with_env(held, names, variables, env), "kind", "key") == [("secret", "A", "1"), ("secret", "B", "2"), ("variable", "CI", "true"), ("variable", "X", "over"), ("variable", "Y", "y")]
    assert rows(secrets.without_env(held, names, variables, env), "kind", "key") == [("secret", "A"), ("secret", "B"), ("variable", "CI"), ("variable", "N"), ("variable", "X"), ("variable", "Y")]


def test_unknown_preset_and_missing_secret(spark):
    held, presets, variables, env = secret_tables(spark)
    none = spark.createDataFrame([], "name string")
    with pytest.raises(Exception, match="Unknown secret preset: nope"):
        secrets.secret_names(none, presets, spark.createDataFrame([("nope",)], "preset string")).collect()
    names = secrets.secret_names(none, presets, spark.createDataFrame([("cache",)], "preset string"))
    with pytest.raises(Exception, match="Secret C is undefined"):
        secrets.with_env(held.where("name <> 'C'"), names, variables, env).collect()


def test_chosen_fields(spark):
    item = spark.createDataFrame([([(("s1",), "L", "1"), (None, "M", "2"), (("s1",), "L", "3"), (("s2",), "K", "4")],)], "fields array<struct<section:struct<id:string>,label:string,value:string>>")
    assert rows(secrets.chosen_fields(item, spark.createDataFrame([("s1",)], "id string"))) == [("L", "3")]
    outside = spark.createDataFrame([("CI", "1"), ("HOME", "/")], "key string, value string")
    assert rows(secrets.run_environment(spark.createDataFrame([("CI", "0"), ("A", "b")], "key string, value string"), outside), "key") == [("A", "b"), ("CI", "1")]

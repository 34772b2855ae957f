"""Queries on schemas and loose JSON objects, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import schema
from sparkloom.plans.registry import query, table
from sparkloom.sources.shared import dealt


def _listed(df: DataFrame, key: str, issues: Column) -> DataFrame:
    """A row an issue, with its place."""
    each = dealt(df).select(key, F.posexplode(issues).alias("place", "i"))
    return each.select(key, F.col("place").cast("long").alias("place"), F.array_join("i.path", ".").alias("path"), F.col("i.code").alias("code"), F.col("i.message").alias("message"))


def _listed_sql(key: str, source: str, issues: str) -> str:
    """The same of a list of structs, null where there is no issue."""
    return f"SELECT {key}, CAST(place AS BIGINT) AS place, i.path AS path, i.code AS code, i.message AS message FROM (SELECT {key}, unnest(range(len(l))) AS place, unnest(l) AS i FROM (SELECT {key}, list_filter([{issues}], lambda x: x IS NOT NULL) AS l FROM {source}))"


def _when(condition: str, path: str, code: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN {{'path': {path}, 'code': '{code}', 'message': {message}}} END"


# ---- worker options: names of every kind, features that are none, no list or no strings


_OPTIONS_SQL = ", ".join([
    _when("k % 4 = 3", "'name'", "invalid_type", "'Invalid input: expected string, received ' || CASE WHEN k % 8 = 3 THEN 'undefined' ELSE 'number' END"),
    _when("k % 4 <> 3 AND n = ''", "'name'", "too_small", "'Worker name cannot be empty'"),
    _when("k % 4 <> 3 AND length(n) > 54", "'name'", "too_big", "'Worker name cannot exceed 54 characters'"),
    _when("k % 4 <> 3 AND NOT regexp_full_match(n, '[a-z0-9-]+')", "'name'", "invalid_format", "'Worker name can only contain lowercase letters, numbers, and hyphens'"),
    _when("k % 4 <> 3 AND NOT regexp_full_match(n, '[a-z0-9].*[a-z0-9]|[a-z0-9]')", "'name'", "invalid_format", "'Worker name cannot start or end with a hyphen'"),
    _when("k % 5 = 1", "'features'", "invalid_type", "'Invalid input: expected array, received string'"),
    _when("k % 5 = 2", "'features.1'", "invalid_value", """'Invalid option: expected one of "entryPoint"|"staticAssets"'"""),
    _when("k % 5 = 2 AND k % 2 = 0", "'features.2'", "invalid_value", """'Invalid option: expected one of "entryPoint"|"staticAssets"'"""),
    _when("k % 5 = 3", "'features'", "too_small", "'At least one feature must be selected'"),
    _when("k % 6 = 0", "'entryPoint'", "invalid_type", "'Invalid input: expected string, received null'"),
])


@query(_listed_sql("p_partkey", "(SELECT p_partkey, p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a' || p_size || CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END WHEN 2 THEN repeat('-' || lower(p_brand), p_size % 10) END AS n FROM part)", _OPTIONS_SQL))
def option_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit("a"), size, F.when(size % 2 == 0, "-").otherwise(""))).otherwise(F.repeat(F.concat(F.lit("-"), F.lower("p_brand")), size % 10))
    name = F.when(k % 8 == 3, "").when(k % 8 == 7, '"name":7,').otherwise(F.concat(F.lit('"name":'), F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2), F.lit(",")))
    features = F.when(k % 5 == 1, '"entryPoint"').when(k % 5 == 2, F.concat(F.lit('["entryPoint",1'), F.when(k % 2 == 0, ',"other"').otherwise(""), F.lit("]"))).when(k % 5 == 3, "[]").otherwise('["staticAssets"]')
    json = F.concat(F.lit("{"), name, F.lit('"other":{"kept":1},"features":'), features, F.when(k % 6 == 0, ',"entryPoint":null').otherwise(""), F.lit("}"))
    return _listed(table(spark, sf_dir, "part"), "p_partkey", schema.WORKER_OPTIONS.issues_of_json(json))


_ITEM_SQL = ", ".join([
    _when("k % 7 = 0", "'favorite'", "invalid_type", "'Invalid input: expected boolean, received string'"),
    _when("k % 5 = 0", "'version'", "invalid_type", "'Invalid input: expected int, received number'"),
    _when("k % 6 = 1", "'vault.name'", "invalid_type", "'Invalid input: expected string, received undefined'"),
    _when("k % 2 = 1", "'category'", "invalid_value", """'Invalid input: expected "SECURE_NOTE"'"""),
    _when("k % 3 = 0", "'updated_at'", "invalid_format", "'Invalid ISO datetime'"),
    _when("k % 4 = 0", "'fields.0.type'", "invalid_value", """'Invalid option: expected one of "STRING"|"CONCEALED"|"MONTH_YEAR"'"""),
    _when("k % 4 = 1", "'fields.1.section.id'", "invalid_type", "'Invalid input: expected string, received number'"),
    _when("k % 8 = 1", "'fields.1.label'", "invalid_type", "'Invalid input: expected string, received array'"),
])


@query(_listed_sql("c_custkey", "(SELECT c_custkey, c_custkey AS k FROM customer)", _ITEM_SQL))
def item_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    field = lambda kind, section, label: F.concat(F.lit('{"id":"f","section":'), section, F.lit(',"type":"'), kind, F.lit('","label":'), label, F.lit(',"value":"v","reference":"r"}'))
    fields = F.concat(F.lit("["), field(F.when(k % 4 == 0, "NUMBER").otherwise("STRING"), F.lit('{"id":"s","label":"x"}'), F.lit('"a"')), F.lit(","), field(F.lit("CONCEALED"), F.when(k % 4 == 1, '{"id":1}').otherwise('{"id":"s"}'), F.when(k % 8 == 1, "[]").otherwise('"b"')), F.lit("]"))
    json = F.concat(
        F.lit('{"id":"'), k, F.lit('","title":"'), F.col("c_name"), F.lit('","favorite":'), F.when(k % 7 == 0, '"yes"').otherwise("true"), F.lit(',"version":'), F.when(k % 5 == 0, "1.5").otherwise("3"),
        F.lit(',"vault":{"id":"v"'), F.when(k % 6 == 1, "").otherwise(',"name":"n"'), F.lit('},"category":"'), F.when(k % 2 == 1, "LOGIN").otherwise("SECURE_NOTE"), F.lit('","last_edited_by":"x","created_at":"2024-01-02T03:04:05Z","updated_at":"'),
        F.when(k % 3 == 0, "2024-02-30T00:00:00Z").otherwise("2024-02-29T00:00Z"), F.lit('","additional_information":"","sections":[{"id":"s"}],"fields":'), fields, F.lit("}"),
    )
    return _listed(table(spark, sf_dir, "customer"), "c_custkey", schema.SECRET_ITEM.issues_of_json(json))


_TASKS_SQL = ", ".join([
    _when("k % 11 = 0", "''", "invalid_json", "'Invalid JSON'"),
    _when("k % 11 > 0 AND k % 3 = 0", "'boundaries.tags.' || p_type || '.dependents.deny.0'", "invalid_type", "'Invalid input: expected string, received boolean'"),
    _when("k % 11 > 0 AND k % 5 = 0", "'globalPassThroughEnv'", "invalid_union", "'Invalid input'"),
    _when("k % 11 > 0 AND k % 7 = 0", "'tasks'", "invalid_type", "'Invalid input: expected record, received undefined'"),
    _when("k % 11 > 0 AND k % 7 > 0 AND k % 2 = 0", "'tasks.build.outputLogs'", "invalid_value", """'Invalid option: expected one of "errors-only"|"full"|"hash-only"|"new-only"|"none"'"""),
    _when("k % 11 > 0 AND k % 7 > 0 AND k % 13 = 0", "'tasks.lint.dependsOn.1'", "invalid_type", "'Invalid input: expected string, received object'"),
    _when("k % 11 > 0 AND k % 2 = 1", "'ui'", "invalid_value", """'Invalid option: expected one of "stream"|"tui"'"""),
])


@query(_listed_sql("p_partkey", "(SELECT p_partkey, p_partkey AS k, p_type FROM part)", _TASKS_SQL))
def task_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tasks = F.concat(F.lit('"tasks":{"lint":{"dependsOn":["^lint",'), F.when(k % 13 == 0, "{}").otherwise('"x"'), F.lit('],"passThroughEnv":null},"build":{"cache":true,"outputLogs":"'), F.when(k % 2 == 0, "all").otherwise("full"), F.lit('"}},'))
    json = F.concat(
        F.lit('{"unknown":[1],"futureFlags":{"a":1,"b":null},"boundaries":{"tags":{"'), F.col("p_type"), F.lit('":{"dependents":{"deny":['), F.when(k % 3 == 0, "true").otherwise('"y"'), F.lit("]}}}},"),
        F.when(k % 5 == 0, '"globalPassThroughEnv":{},').otherwise('"globalPassThroughEnv":null,'), F.when(k % 7 == 0, "").otherwise(tasks), F.lit('"ui":"'), F.when(k % 2 == 0, "tui").otherwise("gui"), F.lit('"'), F.when(k % 11 == 0, "").otherwise("}"),
    )
    return _listed(table(spark, sf_dir, "part"), "p_partkey", schema.TASK_CONFIG.issues_of_json(json))


# ---- what clicks carry along: broken texts, keys that are missing or of another type, lists that are null or empty

CLICK_PROPS = schema.Record({
    "k": schema.Int(),
    "device": schema.Optional(schema.Record({"os": schema.OneOf(("web", "ios", "android")), "ver": schema.Text(patterns=[(r"^[0-3]\.", "Version is not supported")])})),
    "tags": schema.Optional(schema.Items(schema.Text(), least=(1, "No tags"))),
    "items": schema.Optional(schema.Items(schema.Record({"sku": schema.Int(), "qty": schema.Int()}), least=(1, "No items"))),
})
_NULL_TAG = _when("json_type(x) = 'NULL'", "'tags.' || (n - 1)", "invalid_type", "'Invalid input: expected string, received null'")
_CLICK_SQL = ", ".join([
    _when("j IS NULL", "''", "invalid_json", "'Invalid JSON'"),
    _when("j IS NOT NULL AND json_type(j, '$.k') IS NULL", "'k'", "invalid_type", "'Invalid input: expected number, received undefined'"),
    _when("json_type(j, '$.k') = 'VARCHAR'", "'k'", "invalid_type", "'Invalid input: expected number, received string'"),
    _when("json_extract_string(j, '$.device.os') NOT IN ('web', 'ios', 'android')", "'device.os'", "invalid_value", """'Invalid option: expected one of "web"|"ios"|"android"'"""),
    _when("left(json_extract_string(j, '$.device.ver'), 2) NOT IN ('0.', '1.', '2.', '3.')", "'device.ver'", "invalid_format", "'Version is not supported'"),
    _when("json_type(j, '$.tags') = 'NULL'", "'tags'", "invalid_type", "'Invalid input: expected array, received null'"),
    _when("json_array_length(j, '$.tags') = 0 AND json_type(j, '$.tags') = 'ARRAY'", "'tags'", "too_small", "'No tags'") + f"] || coalesce(list_transform(json_extract(j, '$.tags[*]'), lambda x, n: {_NULL_TAG}), []) || [NULL",
    _when("json_array_length(j, '$.items') = 0 AND json_type(j, '$.items') = 'ARRAY'", "'items'", "too_small", "'No items'"),
])


@query(_listed_sql("click_id", "(SELECT click_id, CASE WHEN json_valid(props) THEN props END AS j FROM clicks)", _CLICK_SQL))
def click_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(table(spark, sf_dir, "clicks"), "click_id", CLICK_PROPS.issues_of_json(F.col("props")))

"""Callbacks of the caller in whole plans: configurations that a function makes, commands with a hook before them; joined text
in pieces."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import schema
from sparkloom.operators import loose, ranking, records
from sparkloom.plans.registry import query, table

DEFAULT_SCHEMA = "https://turbo.build/schema.json"


def explained(issues: Column) -> Column:
    """Issues as lines: `message at path`."""
    line = lambda i: F.concat(i["message"], F.when(F.size(i["path"]) > 0, F.concat(F.lit(" at "), F.array_join(i["path"], "."))).otherwise(""))
    return F.array_join(F.transform(issues, line), "\n")


def defined(source: DataFrame | Callable[[], DataFrame], strict: bool = True, default: str = DEFAULT_SCHEMA) -> DataFrame:
    """(path, text, error) of task configurations (path, text) or of a function that makes them: JSON with `$schema` as its last
    key where it has none (an empty one is replaced), all other keys as they are.

    Where there are issues, text is null and error lists them; strict, reading it raises them."""
    found = (source() if callable(source) else source).select("path", "text", schema.TASK_CONFIG.issues_of_json(F.col("text")).alias("issues"), loose.order_bound(F.col("text")).alias("bare"))
    own = F.try_variant_get(F.try_parse_json("text"), "$['$schema']", "string")
    link = F.lit(f'"$schema":"{default}"')
    whole = F.when(own.isNull(), F.concat(F.regexp_replace("bare", r"\}\z", ""), F.when(F.col("bare") != "{}", ",").otherwise(""), link, F.lit("}"))).when(own == "", F.replace("bare", F.lit('"$schema":""'), link)).otherwise(F.col("bare"))
    error = F.when(F.size("issues") > 0, F.concat(F.lit("Invalid configuration: "), explained(F.col("issues"))))
    text = F.when(error.isNotNull(), F.raise_error(error) if strict else F.lit(None)).otherwise(whole)
    return found.select("path", text.alias("text"), error.alias("error"))


def command_runs(
    runs: DataFrame,
    items: DataFrame,
    sections: DataFrame,
    outside: Mapping[str, str] | None = None,
    docker_commands: Sequence[str] = (),
    before: Callable[[DataFrame], DataFrame | None] | None = None,
    passed: Sequence[str] = ("CI", "GITHUB_ACTIONS"),
) -> DataFrame:
    """(run, words, options) of runs (run, item, command, args, env; the last two maps): the words of each command and the JSON that
    goes with it, {args, env, secrets}. Secrets are the fields of the run's item (id, fields) in the sections (id), the last of
    a label winning; names in `passed` are taken from `outside`, over the run's own.

    `before` is called with the runs when the plan is made; what it returns, if anything, takes their place. Without an item a
    run has no secrets. Maps are written by key."""
    if before is not None:
        runs = before(runs) or runs
    fields = items.select("id", F.posexplode("fields").alias("at", "f")).select("id", "at", F.col("f.section.id").alias("section"), F.col("f.label").alias("label"), F.col("f.value").alias("value"))
    chosen = records.last_wins(records.matching(fields, sections, "section", "id"), "label", "value", ["at"], by=["id"])
    held = chosen.groupBy(F.col("id").alias("item")).agg(F.collect_list(F.struct("label", "value")).alias("secrets"))  # an item's own
    empty = F.create_map().cast("map<string,string>")
    given = {k: v for k, v in (outside or {}).items() if k in passed}
    over = F.create_map(*(F.lit(x) for kv in given.items() for x in kv)) if given else empty
    in_order = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    options = F.struct(in_order(F.coalesce("args", empty)).alias("args"), in_order(records.merged(F.col("env"), over)).alias("env"), F.map_from_entries(F.array_sort(F.coalesce("secrets", F.array().cast("array<struct<label:string,value:string>>")))).alias("secrets"))
    docker = F.when(F.col("command").isin(*docker_commands), F.array(F.lit("--docker-socket=/var/run/docker.sock"))).otherwise(F.array().cast("array<string>"))
    words = F.concat(F.array(*map(F.lit, ("op", "run", "--no-masking", "--", "dagger", "call")), F.col("command")), docker, F.array(F.lit("--options=env://DAGGER_OPTIONS")))
    return runs.join(held, "item", "left").select("run", words.alias("words"), F.to_json(options).alias("options"))


def joined_pieces(df: DataFrame, by: str, value: str, order: str, delimiter: str, rows: int = 10_000) -> DataFrame:
    """(by, piece, text) of a group's values joined in order, in pieces of at most so many rows: the pieces one after another,
    with the delimiter between them, are what records.joined() gives of a group, whatever its size. Nulls are left out.

    Rows are numbered over all groups by ranges; no task holds a group."""
    some = df.where(F.col(value).isNotNull()).select(F.col(by).alias("by"), F.col(order).alias("order"), F.col(value).alias("value"))
    placed = ranking.global_rank(some, [F.col("by").asc(), F.col("order").asc(), F.col("value").asc()], "place")
    first = placed.groupBy(F.col("by").alias("of")).agg(F.min("place").alias("first"))
    dealt = placed.join(first, F.col("by").eqNullSafe(F.col("of"))).select("by", F.floor((F.col("place") - F.col("first")) / rows).alias("piece"), "place", "value")
    return dealt.groupBy("by", "piece").agg(records.joined(F.col("value"), F.col("place"), delimiter).alias("text")).select(F.col("by").alias(by), "piece", "text")


# ---- queries


@query("""SELECT '/p/' || p_partkey || '/turbo.json' AS path, CASE WHEN p_size % 3 = 2 THEN NULL ELSE '{"ui":"tui",' || CASE p_size % 3 WHEN 0 THEN '"$schema":"own",' ELSE '' END || '"more":[1,null],"tasks":{"' || p_type || '":{"cache":' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END || '}}' || CASE p_size % 3 WHEN 0 THEN '' ELSE ',"$schema":"https://turbo.build/schema.json"' END || '}' END AS text,
  CASE WHEN p_size % 3 = 2 THEN 'Invalid configuration: Invalid input: expected boolean, received string at tasks.' || p_type || E'.cache\nInvalid input: expected array, received object at tags' END AS error FROM part""")
def defined_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations that a function makes, checked and completed."""

    def made() -> DataFrame:
        size = F.col("p_size")
        cache = F.when(size % 3 == 2, '"yes"').otherwise(F.when(size % 2 == 0, "true").otherwise("false"))
        text = F.concat(F.lit('{ "ui": "tui", '), F.when(size % 3 == 0, '"$schema": "own", ').otherwise(""), F.lit('"more": [1, null], "tasks": {"'), F.col("p_type"), F.lit('": {"cache": '), cache, F.lit("}}"), F.when(size % 3 == 2, ', "tags": {}').otherwise(""), F.lit(" }"))
        return table(spark, sf_dir, "part").select(F.concat(F.lit("/p/"), "p_partkey", F.lit("/turbo.json")).alias("path"), text.alias("text"))

    return defined(made, strict=False)


@query("""SELECT c_custkey AS run, 'op run --no-masking -- dagger call ' || c_mktsegment || CASE WHEN c_mktsegment = 'BUILDING' THEN ' --docker-socket=/var/run/docker.sock' ELSE '' END || ' --options=env://DAGGER_OPTIONS' AS words,
  '{"args":{"name":"' || c_name || '"},"env":{"CI":"1","own":"' || c_nationkey || '"},"secrets":{' || coalesce('"late":"' || s_suppkey || '","name":"' || s_name || '"', '') || '}}' AS options
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 150 WHERE c_custkey % 2 = 0""")
def command_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each customer that a hook lets through, with the secrets of a supplier."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    field = lambda section, label, value: F.struct(F.struct(F.lit(section).alias("id")).alias("section"), F.lit(label).alias("label"), value.alias("value"))
    items = s.select(F.col("s_suppkey").alias("id"), F.array(field("in", "late", F.lit("early")), field("in", "name", F.col("s_name")), field("out", "hidden", F.lit("x")), field("in", "late", F.col("s_suppkey").cast("string"))).alias("fields"))
    runs = c.select(F.col("c_custkey").alias("run"), (F.col("c_custkey") % 150).alias("item"), F.col("c_mktsegment").alias("command"), F.create_map(F.lit("name"), F.col("c_name")).alias("args"), F.create_map(F.lit("own"), F.col("c_nationkey").cast("string"), F.lit("CI"), F.lit("no")).alias("env"))
    sections = spark.createDataFrame([("in",)], "id string")
    got = command_runs(runs, items, sections, {"CI": "1", "HOME": "/root"}, ["BUILDING"], before=lambda r: r.where("run % 2 = 0"))
    return got.select("run", F.array_join("words", " ").alias("words"), "options")


@query("""SELECT event_type, piece, string_agg(event_id, ',' ORDER BY event_id) AS text FROM (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 500 AS piece FROM events WHERE event_id % 7 > 0) GROUP BY ALL""")
def joined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type, listed in order, in pieces."""
    e = table(spark, sf_dir, "events")
    listed = e.select("event_type", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_id").cast("string")).alias("id"))
    return joined_pieces(listed, "event_type", "id", "event_id", ",", rows=500)

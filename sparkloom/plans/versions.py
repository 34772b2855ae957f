"""Queries on files and versions of tables: what to write, what differs, sources and sinks of files, helpers in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import case, sql_helpers, template
from sparkloom.operators import drift, loose
from sparkloom.plans.registry import query, table
from sparkloom.sinks.fan_out import TextFiles
from sparkloom.sources import shared
from sparkloom.sources.captured import CapturedOutput

# ---- JSON files with any keys: part p's file as it is, and as it should be


def _config(size: Column, sep: str, flipped: Column) -> Column:
    """A configuration with keys that no schema names, mixed lists and a null; flipped: the same, keys in another order."""
    name, extra = F.concat(F.lit('"name":'), F.lit(sep), F.to_json(F.struct(F.col("p_name").alias("n")))), F.concat(F.lit('"sizes":'), F.lit(sep), F.lit("["), size, F.lit(f',{sep}"a  b",{sep}null,{sep}{{"z": 1,{sep}"y": [true]}}]'))
    return F.concat(F.lit("{"), F.when(flipped, F.concat(extra, F.lit(","), name)).otherwise(F.concat(name, F.lit(f",{sep}"), extra)), F.lit("}"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, text) as it is and as wanted. Of 7 parts, one is not there yet, one is unwanted, one has another size, one other
    keys' order, one is no JSON."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat(F.lit("/apps/"), k % 10, F.lit("/"), k, F.lit(".json")).alias("path")
    held = F.when(k % 7 == 4, "{broken").otherwise(_config(F.when(k % 7 == 2, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string"), "\n\t", k % 7 == 3))
    return p.where("p_partkey % 7 <> 0").select(path, held.alias("text")), p.where("p_partkey % 7 <> 1").select(path, _config(F.col("p_size").cast("string"), "", F.lit(False)).alias("text"))


_PATH = "'/apps/' || (p_partkey % 10) || '/' || p_partkey || '.json'"


@query(f"""SELECT {_PATH} AS path, CASE p_partkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unwanted' WHEN 2 THEN 'differs' WHEN 3 THEN 'differs' WHEN 4 THEN 'differs' ELSE 'same' END AS in_order,
  CASE p_partkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unwanted' WHEN 2 THEN 'differs' WHEN 4 THEN 'differs' ELSE 'same' END AS in_any_order FROM part""")
def config_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose JSON is not what it should be, with the keys' order and without it."""
    held, wanted = _files(spark, sf_dir)
    bound, free = loose.compared(held, wanted), loose.compared(held, wanted, ordered=False)
    return bound.select("path", F.col("state").alias("in_order")).join(free.select("path", F.col("state").alias("in_any_order")), "path")


@query(f"""SELECT {_PATH} AS path, '{{"name":{{"n":"' || p_name || '"}},"sizes":[' || p_size || ',"a  b",null,{{"z":1,"y":[true]}}]}}' AS text FROM part WHERE p_partkey % 7 IN (0, 2, 3, 4)""")
def config_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains to be written, as it is written."""
    return loose.writes(*_files(spark, sf_dir)).select("path", loose.order_bound(F.col("text")).alias("text"))


@query("""SELECT '/w/' || p_partkey || '/wrangler.jsonc' AS path, CASE p_partkey % 4 WHEN 0 THEN '/w/' || p_partkey || '/wrangler.jsonc' WHEN 1 THEN '/w/' || p_partkey || '/wrangler.json' WHEN 2 THEN '/w/' || p_partkey || '/wrangler.toml' END AS blocked_by FROM part""")
def guarded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New configurations, and the file that stands in the way of each."""
    p = table(spark, sf_dir, "part")
    at = lambda name: F.concat(F.lit("/w/"), F.col("p_partkey"), F.lit(f"/{name}")).alias("path")
    there = p.where("p_partkey % 4 IN (0, 2)").select(at("wrangler.toml")).union(p.where("p_partkey % 4 = 1").select(at("wrangler.json"))).union(p.where("p_partkey % 4 = 0").select(at("wrangler.jsonc"))).union(p.select(at("other.json")))
    return loose.guarded(there, p.select(at("wrangler.jsonc"), F.lit("{}").alias("text"))).select("path", "blocked_by")


# ---- versions of a table


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and orders with some removed, some dearer, and some new ones far away."""
    old, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    new = old.where("o_orderkey % 997 <> 0").withColumn("o_totalprice", F.when(k % 499 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return old, new.unionByName(old.where("o_orderkey % 1009 = 5").withColumn("o_orderkey", k + 100_000_000))


@query("""SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 997 = 0 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 997 <> 0 AND o_orderkey % 499 = 1
  UNION ALL SELECT o_orderkey + 100000000, 'added' FROM orders WHERE o_orderkey % 1009 = 5""")
def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that differ between two versions; only key ranges whose digests differ are compared."""
    return drift.changes(*_versions(spark, sf_dir), "o_orderkey", width=64)


@query("""WITH RECURSIVE n(level, node, n) AS (SELECT 0, o_orderkey // 64, count(*) FROM orders GROUP BY 2), t AS (SELECT * FROM n UNION ALL SELECT 1, node // 16, sum(n) FROM n GROUP BY 2 UNION ALL SELECT 2, node // 256, sum(n) FROM n GROUP BY 2 UNION ALL SELECT 3, node // 4096, sum(n) FROM n GROUP BY 2),
  changed AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 997 = 0 OR o_orderkey % 499 = 1 UNION ALL SELECT o_orderkey + 100000000 FROM orders WHERE o_orderkey % 1009 = 5)
  SELECT CAST(level AS INT) AS level, node, CAST(n AS BIGINT) AS n, level = 0 AND node IN (SELECT k // 64 FROM changed) AS differs FROM t UNION ALL SELECT DISTINCT -1, k // 64, 0, TRUE FROM changed WHERE k >= 100000000""")
def digest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ranges of orders with their numbers of rows, and those that differ from the other version's; level -1 has those that
    orders lacks."""
    old, new = _versions(spark, sf_dir)
    a, b = drift.digest_tree(old, "o_orderkey", 64), drift.digest_tree(new, "o_orderkey", 64)
    differing = drift.differing_ranges(a, b).select("node", F.lit(0).alias("level"), F.lit(True).alias("differs"))
    met = a.join(differing, ["level", "node"], "full")
    there = F.col("n").isNotNull()
    return met.select(F.when(there, F.col("level")).otherwise(-1).alias("level"), "node", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("differs", F.lit(False)).alias("differs"))


# ---- files in, files out

_README = "# {{ pascal name }}\n\nPackage `{{ slug-p name }}` of {{ nation }}.\n"


@query(r"""SELECT 'suppliers/' || s_suppkey || '/README.md' AS path, '# Supplier' || regexp_extract(s_name, '[0-9]+') || E'x\n\nPackage `' || lower(s_name) || E'-xs` of ' || s_nationkey || E'.\n' AS text FROM supplier""")
def template_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier from a template, written, published and read back."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.col("s_name"), F.lit(" x"))
    body = template.render(_README, {"name": name, "nation": F.col("s_nationkey")}, case.HELPERS | {"pascal": lambda c: F.concat(F.lit("Supplier"), F.regexp_extract(c, "[0-9]+", 0), F.lit("x"))})
    folder = shared.new_dir(spark)
    spark.dataSource.register(TextFiles)
    spark.dataSource.register(CapturedOutput)
    files = s.select(F.concat(F.lit("suppliers/"), "s_suppkey", F.lit("/README.md")).alias("path"), body.alias("text"))
    files.write.format("text_files").mode("append").save(folder)
    return spark.read.format("captured_output").load(folder).select(F.regexp_extract("path", r"suppliers/.*$", 0).alias("path"), F.col("value").alias("text"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS balance, s_suppkey % 3 = 0 AS active, 'nation' AS label, CAST(s_nationkey AS VARCHAR) AS value FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal, s_suppkey % 3 = 0, 'name', s_name FROM supplier")
def captured_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of a process for each supplier, a file each, through the data source."""
    item = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("balance"), (F.col("s_suppkey") % 3 == 0).alias("active"), F.lit(1).alias("unknown"), F.array(F.struct(F.lit("nation").alias("label"), F.col("s_nationkey").cast("string").alias("value")), F.struct(F.lit("name").alias("label"), F.col("s_name").alias("value"))).alias("fields"))
    folder = shared.new_dir(spark)
    spark.dataSource.register(TextFiles)
    spark.dataSource.register(CapturedOutput)
    table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit(".json")).alias("path"), F.to_json(item).alias("text")).write.format("text_files").mode("append").save(folder)
    schema = T.StructType.fromDDL("id string, balance double, active boolean, fields array<struct<label:string,value:string>>")
    got = spark.read.format("captured_output").schema(schema).option("partition_bytes", 1 << 14).load(folder)
    return got.select("id", "balance", "active", F.inline("fields"))


# ---- helpers in SQL text alone

_CALLS = "p_partkey, slug(p_name) AS slug, slug_s(concat(p_name, 's')) AS slug_s, slug_p(p_type) AS slug_p, pascal(concat(p_brand, ' ', p_name)) AS pascal, pascal_s(p_type) AS pascal_s, pascal_p(p_name) AS pascal_p, kebab_of(word_and_number_list(p_brand)) AS kebab"
_W = "list_filter(string_split(regexp_replace(%s, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_P = "array_to_string(list_transform(" + _W + ", lambda w, i: CASE WHEN i > 1 AND w[1] BETWEEN '0' AND '9' THEN '_' || lower(w) ELSE upper(w[1]) || lower(w[2:]) END), '')"
_S = "replace(lower(%s), ' ', '-')"


@query(f"""SELECT p_partkey, {_S % "p_name"} AS slug, {_S % "p_name"} AS slug_s, CASE WHEN lower(p_type) LIKE '%s' THEN {_S % "p_type"} ELSE {_S % "p_type"} || 's' END AS slug_p, {_P % "(p_brand || ' ' || p_name)"} AS pascal,
  regexp_replace({_P % "p_type"}, 's$', '') AS pascal_s, CASE WHEN {_P % "p_name"} LIKE '%s' THEN {_P % "p_name"} ELSE {_P % "p_name"} || 's' END AS pascal_p, replace(lower(regexp_replace(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')), ' ', '-') AS kebab FROM part""")
def sql_helpers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_helpers.register(spark)
    return spark.sql(f"SELECT {_CALLS} FROM {{part}}", part=table(spark, sf_dir, "part"))

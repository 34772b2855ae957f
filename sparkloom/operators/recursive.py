"""Configuration inheritance and dependency edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import records
from sparkloom.sources.shared import stored


def parent_path(path: Column, extends: Column) -> Column:
    """The path that a document names as its parent: relative to its folder after `./` or `../`, else as it is; `.json` is
    added where there is no such ending."""
    full = F.when(extends.rlike(r"^\.\.?/"), records.normal_path(F.concat(F.regexp_extract(path, r"^(.*/)?", 0), extends))).otherwise(extends)
    return F.when(F.endswith(full, F.lit(".json")), full).otherwise(F.concat(full, F.lit(".json")))


def configurations(documents: DataFrame) -> DataFrame:
    """(config, parent, options) of JSON documents (path, value): the path, the parent's path, and compilerOptions with each
    value as JSON text, so numbers, lists and explicit nulls stay what they are. A text that is no JSON object has neither."""
    v = F.try_parse_json("value")
    own = F.transform_values(F.try_variant_get(v, "$.compilerOptions", "map<string,variant>"), lambda _, x: F.to_json(x))
    return documents.select(F.col("path").alias("config"), parent_path(F.col("path"), F.try_variant_get(v, "$.extends", "string")).alias("parent"), own.alias("options"))


def inherited(chain: DataFrame, config: str = "config", parent: str = "parent", options: str = "options") -> DataFrame:
    """(config, options, cyclic): each configuration's options over those it extends, the nearer winning, keys replaced
    whole; cyclic says that its chain never ends. There a configuration counts where it comes first.

    Pointer doubling: after k rounds a row holds the merged options of its 2^k nearest and points to the next, so a chain of
    any depth takes the logarithm of it in joins, and only rows whose chain goes on are joined again. If a round ends none of
    them, all that are left never end, and only they are on their chains, so that many steps reach everything. Rounds are written to
    the shared folder. A parent that is not in the table ends the chain; null options are none; a configuration is listed
    once. A parent of very many configurations is one join key, which adaptive execution splits."""
    empty = F.create_map().cast("map<string,string>")
    first = stored(chain.select(F.col(config).alias("config"), F.col(parent).alias("up"), F.coalesce(F.col(options), empty).alias("options")))
    done, going, reach, before = [first.where("up IS NULL")], first.where("up IS NOT NULL"), 1, 0
    while (n := going.count()) and (n != before or reach <= n):
        before = n
        every = reduce(DataFrame.unionByName, [*done, going])
        ahead = every.select(F.col("config").alias("up"), F.col("up").alias("far"), F.col("options").alias("below"))
        moved = stored(going.join(ahead, "up", "left").select("config", F.col("far").alias("up"), records.merged(F.col("below"), F.col("options")).alias("options")))
        done.append(moved.where("up IS NULL"))
        going, reach = moved.where("up IS NOT NULL"), 2 * reach
    return reduce(DataFrame.unionByName, [*done, going]).select("config", "options", F.col("up").isNotNull().alias("cyclic"))


def resolve_extends(chain: DataFrame, config: str = "config", parent: str = "parent", options: str = "options") -> DataFrame:
    """(config, options) of inherited()."""
    return inherited(chain, config, parent, options).select("config", "options")


def task_edges(configs: DataFrame, tasks: str = "tasks", keep: Sequence[str] = ()) -> DataFrame:
    """(task, depends_on, scope), after the columns to keep, of a map of tasks: `^x` means x of upstream packages, `//#x`
    the root's."""
    pairs = configs.select(*keep, F.explode(tasks).alias("task", "spec")).select(*keep, "task", F.explode("spec.dependsOn").alias("raw"))
    scope = F.when(F.startswith("raw", F.lit("^")), "upstream").when(F.startswith("raw", F.lit("//#")), "root").otherwise("package")
    return pairs.select(*keep, "task", F.regexp_replace("raw", r"^(?:\^|//#)", "").alias("depends_on"), scope.alias("scope"))

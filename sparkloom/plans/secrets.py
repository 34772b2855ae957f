"""A secret item to a container's variables: sections, presets, derived variables, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import records


def chosen_fields(items: DataFrame, sections: DataFrame) -> DataFrame:
    """(label, value) of the fields in the chosen sections, the last of a label winning."""
    fields = items.select(F.posexplode("fields").alias("at", "f")).select("at", F.col("f.section.id").alias("section"), F.col("f.label").alias("label"), F.col("f.value").alias("value"))
    return records.last_wins(records.matching(fields, sections, "section", "id"), "label", "value", ["at"])


def run_environment(env: DataFrame, outside: DataFrame, passed: tuple[str, ...] = ("CI", "GITHUB_ACTIONS")) -> DataFrame:
    """(key, value): the given environment, with the passed names of the outside one over it."""
    return records.merge_tables([env, outside.where(F.col("key").isin(*passed) & F.col("value").isNotNull())], "key", "value")


def _at(df: DataFrame) -> Column:
    """The order of rows, if the table gives one in `at`."""
    return F.col("at").cast("long") if "at" in df.columns else F.lit(0).cast("long")


def secret_names(names: DataFrame, presets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, required, at): names asked for alone, and then those of the wanted presets; an unknown preset raises.

    names (name) and wanted (preset) may have an order, `at`."""
    known = presets.select("preset", "names", F.lit(True).alias("known"))
    found = wanted.select("preset", _at(wanted).alias("at")).join(known, "preset", "left")
    checked = found.withColumn("names", F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("Unknown secret preset: "), F.col("preset")))).otherwise(F.col("names")))
    place = lambda group, at, pos: F.array(F.lit(group).cast("long"), at, pos.cast("long")).alias("at")
    alone = names.select("name", F.lit(False).alias("required"), place(0, _at(names), F.lit(0)))
    listed = checked.select("at", F.posexplode("names").alias("pos", "name"))
    return alone.unionByName(listed.select("name", F.lit(True).alias("required"), place(1, F.col("at"), F.col("pos"))))


def with_env(secrets: DataFrame, names: DataFrame, variables: DataFrame, env: DataFrame) -> DataFrame:
    """(kind, key, value) that a container gets: secrets, then derived variables, then the options' environment.

    secrets: (name, value); names as from secret_names: single names without a secret are passed over but still have
    their derived variables, preset names must have one. variables: (name, key, value), and their order `at` if they have
    one: of derived variables with one key the last counts, by the order of names and then their own (without an order,
    the greatest value). Null environment values go."""
    held = names.join(secrets.select("name", "value", F.lit(True).alias("held")), "name", "left").where("held OR required")
    secret = held.select(F.lit("secret").alias("kind"), F.col("name").alias("key"), records.required(F.col("value"), F.col("name")).alias("value")).distinct()
    order = F.col("at") if "at" in names.columns else F.array().cast("array<bigint>")
    own = variables.select("name", "key", "value", _at(variables).alias("own"))
    derived = names.select("name", order.alias("at")).join(own, "name").select("key", "value", F.lit(0).alias("late"), "at", "own")
    given = env.where("value IS NOT NULL").select("key", "value", F.lit(1).alias("late"), F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("long").alias("own"))
    plain = derived.unionByName(given).groupBy("key").agg(F.max_by("value", F.struct("late", "at", "own", "value")).alias("value"))
    return secret.unionByName(plain.select(F.lit("variable").alias("kind"), "key", "value"))


def without_env(secrets: DataFrame, names: DataFrame, variables: DataFrame, env: DataFrame) -> DataFrame:
    """(kind, key) that are taken from a container again: as with_env, but every key of the environment."""
    added = with_env(secrets, names, variables, env.where("false")).select("kind", "key")
    return added.unionByName(env.select(F.lit("variable").alias("kind"), "key")).distinct()

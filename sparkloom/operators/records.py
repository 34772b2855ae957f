"""Record operators on DataFrames and columns: lookups, folds, merges, filters, precedence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text, web

#: Rule files of each assistant, commands that add a tool by each package manager, lock files by precedence.
RULE_FILES = {"claude": ("CLAUDE.md", ".claude"), "cursor": (".cursor",), "windsurf": (".windsurf",), "amp": ("AGENTS.md",)}
ADD_COMMANDS = {"bun": ("bun", "add", "--dev"), "pnpm": ("pnpm", "add", "--save-dev"), "yarn": ("yarn", "add", "--dev"), "npm": ("npm", "install", "--save-dev")}
LOCK_FILES = (("bun.lockb", "bun"), ("bun.lock", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"))
ENTRY_POINTS = ("src/index.ts", "index.ts")
ASSET_DIRECTORIES = ("public", "static", "assets", "dist")


# projections


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once for each row, however often later columns and filters use them.

    Projections alone may be merged and filters pushed below them, which copies costly expressions into every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def request_log(requests: DataFrame) -> DataFrame:
    """Log records of requests (url, method, path, route_path, headers map, started_ms): secrets hidden, first known address."""
    h = lambda name: F.col("headers")[name]
    return requests.select(
        web.redact(F.col("url")).alias("url"),
        "method",
        "path",
        F.col("route_path").alias("routePath"),
        web.query_string(web.redacted_params(F.col("url"))).alias("searchParams"),
        web.header_pairs(F.col("headers")).alias("headers"),
        text.first_truthy(h("cf-connecting-ip"), h("x-real-ip"), h("x-forwarded-for")).alias("ip"),
        web.iso_millis(F.col("started_ms")).alias("timestamp"),
    )


def described(description: Column, globs: Column, always: Column, lead: str = "Read Cursor rule: ") -> Column:
    """Lead and description, with `(applies to ..., always-apply)` as far as they hold; empty globs don't."""
    facts = F.array_compact(F.array(F.when(globs != "", F.concat(F.lit("applies to "), globs)), F.when(always, "always-apply")))
    return F.concat(F.lit(lead), description, F.when(F.size(facts) > 0, F.concat(F.lit(" ("), F.array_join(facts, ", "), F.lit(")"))).otherwise(""))


def under(root: Column, paths: Column) -> Column:
    """root/path of each path, normalised."""
    return F.transform(paths, lambda p: normal_path(F.concat_ws("/", root, p)))


def normal_path(path: Column) -> Column:
    """path without empty and `.` parts; `..` takes the part before it away. A slash at the end stays, one alone is the
    root, above which nothing is; nothing at all is `.`."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(back, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((x == "..") & absolute, done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    body = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"), F.when(F.endswith(path, F.lit("/")) & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(body == "", ".").otherwise(body)


# filters


def string_entries(values: Column) -> Column:
    """Entries of a map whose value is there."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def either_has_key(first: Column, second: Column, key: str) -> Column:
    """Whether a key is in either of two maps; a null map has none."""
    return F.coalesce(F.map_contains_key(first, key), F.lit(False)) | F.coalesce(F.map_contains_key(second, key), F.lit(False))


def required(value: Column, name: Column) -> Column:
    """value, raising an error where it is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(F.concat(F.lit("Secret "), name, F.lit(" is undefined")))).otherwise(value)


def default_all(flags: Mapping[str, Column], defaults: Sequence[str]) -> dict[str, Column]:
    """Flags as they are if any is set; else the default ones set."""
    flags = {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}
    some = F.lit(False)
    for v in flags.values():
        some = some | v
    return {k: F.when(some, v).otherwise(F.lit(k in defaults)) for k, v in flags.items()}


def existing(candidates: Sequence[str], present: Column) -> Column:
    """Those of the candidates that are in the array `present`, in the candidates' order."""
    return F.filter(F.array(*map(F.lit, candidates)), lambda x: F.array_contains(present, x))


def first_existing(candidates: Sequence[str], present: Column) -> Column:
    return F.try_element_at(existing(candidates, present), F.lit(1))


def nearest_above(folders: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """(folder, found) of each folder: the path, among files (path), of the nearest marker in it or above it, or null."""
    parts = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(parts, 1, n), F.lit(marker)).alias("path")))).alias("a"))
    held = files.select("path", F.col("path").alias("there"))
    met = above.select("folder", "a.depth", "a.path").join(held, "path", "left")
    return met.groupBy("folder").agg(F.max_by("there", F.when(F.col("there").isNotNull(), F.col("depth")).otherwise(0)).alias("found"))


def package_manager(present: Column) -> Column:
    """By the lock files there are; npm without any."""
    out = F.lit("npm")
    for file, manager in reversed(LOCK_FILES):
        out = F.when(F.array_contains(present, file), manager).otherwise(out)
    return out


# lookups


def matching(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is among right's; a null key never matches."""
    return left.join(right.select(F.col(right_key).alias("__k")), F.col(left_key) == F.col("__k"), "left_semi")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("__k")), F.col(left_key) == F.col("__k"), "left_anti")


def required_lookup(names: DataFrame, values: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """names with their values; a name without a value raises an error when it is read."""
    found = names.join(values.select(name, value), name, "left")
    return found.withColumn(value, required(F.col(value), F.col(name)))


def expanded(groups: DataFrame, group: str = "preset", members: str = "names", name: str = "name") -> DataFrame:
    """A row a member of each group."""
    return groups.select(group, F.explode(members).alias(name))


def derived(names: DataFrame, variables: DataFrame, name: str = "name") -> DataFrame:
    """Each name's derived variables; names without any give none, repeated names repeat them."""
    return names.join(variables, name)


def constant_lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Value of a key in a small constant table; null for others."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def first_rule(value: Column, rules: Sequence[tuple[object, object]]) -> Column:
    """Outcome of the first rule whose match equals value; null if none does."""
    out = F.lit(None)
    for match, outcome in reversed(rules):
        out = F.when(value == F.lit(match), F.lit(outcome)).otherwise(out)
    return out


def add_command(manager: Column, tool: str) -> Column:
    """The words of the command that adds a tool; null for an unknown package manager."""
    return F.concat(constant_lookup(manager, ADD_COMMANDS), F.array(F.lit(tool)))


def files_to_remove(selected: Column) -> Column:
    """Files of all assistants that are not selected."""
    rest = F.array_except(F.array(*map(F.lit, RULE_FILES)), selected)
    return F.flatten(F.transform(rest, lambda r: constant_lookup(r, RULE_FILES)))


# folds


def last_wins(df: DataFrame, key: str, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For each key, the value of the last row by order: partial aggregation, no window."""
    return df.groupBy(*by, key).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_wins_map(entries: Column) -> Column:
    """A map of an array of (key, value) structs in which later values win."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(last)


def any_failed(exit_code: Column) -> Column:
    """Aggregate: whether any exit code is null or not 0; false over no rows."""
    return F.coalesce(F.bool_or(exit_code.isNull() | (exit_code != 0)), F.lit(False))


def joined(value: Column, order: Column, delimiter: str) -> Column:
    """Aggregate: values joined in order; nulls left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), delimiter)


# sets


def merged(low: Column, high: Column) -> Column:
    """Map of both, the second's values winning; a null map is empty, a null value counts as absent."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(low, empty), F.coalesce(high, empty), lambda _, x, y: F.coalesce(y, x))


def merge_tables(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Key and value tables as one, later tables winning."""
    all_rows = [t.select(key, value, F.lit(i).alias("__at")) for i, t in enumerate(tables)]
    out = all_rows[0]
    for t in all_rows[1:]:
        out = out.unionByName(t)
    return out.groupBy(key).agg(F.max_by(value, "__at").alias(value))


def concatenated(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def by_name(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of a locale-independent collation."""
    return df.orderBy(F.collate(F.col(column), "UNICODE"))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with their place in their group; ties by the later order columns."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

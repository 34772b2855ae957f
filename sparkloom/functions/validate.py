"""Schema validation as columns: struct(success, data, error), with the first failing message, or an error raised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.schema import iso_datetime_ok

#: Fixed messages, in the order in which they are tested.
NAME_CHECKS = (
    (r"^[\s\S]", "Worker name cannot be empty"),
    (r"^[\s\S]{0,54}\z", "Worker name cannot exceed 54 characters"),
    (r"^[a-z0-9-]+\z", "Worker name can only contain lowercase letters, numbers, and hyphens"),
    (r"^(?:[a-z0-9].*[a-z0-9]|[a-z0-9])\z", "Worker name cannot start or end with a hyphen"),
)
MANAGERS = ("bun", "pnpm", "yarn", "npm")
FEATURES = ("entryPoint", "staticAssets")
FIELD_TYPES, PURPOSES, CATEGORIES = ("STRING", "CONCEALED", "MONTH_YEAR"), ("NOTES",), ("SECURE_NOTE",)
ENV_MODES, OUTPUT_LOGS, DISPLAYS = ("loose", "strict"), ("errors-only", "full", "hash-only", "new-only", "none"), ("stream", "tui")


def result(data: Column, error: Column) -> Column:
    """struct(success, data, error); data is null where there is an error."""
    return F.struct(error.isNull().alias("success"), F.when(error.isNull(), data).alias("data"), error.alias("error"))


def parsed(data: Column, error: Column) -> Column:
    """data, raising the error where there is one."""
    return F.when(error.isNotNull(), F.raise_error(error)).otherwise(data)


def first_error(*checks: tuple[Column, str]) -> Column:
    """Message of the first check that is not true."""
    out = F.lit(None).cast("string")
    for good, message in reversed(checks):
        out = F.when(~F.coalesce(good, F.lit(False)), message).otherwise(out)
    return out


def name_error(name: Column) -> Column:
    """First message of an identifier, null if it is valid; null text is empty."""
    return first_error(*((F.coalesce(name, F.lit("")).rlike(p), m) for p, m in NAME_CHECKS))


def repository_name_ok(name: Column) -> Column:
    """Letters, digits, `-`, `_`, `.`; neither dots nor underscores alone."""
    return name.rlike(r"^(?!\.+\z)(?!_+\z)[A-Za-z0-9\-_.]+\z")


def one_of(value: Column, members: Sequence[str]) -> Column:
    """Whether a value is a member; null is none."""
    return F.coalesce(value.isin(*members), F.lit(False))


def options_error(name: Column, features: Column) -> Column:
    """First message of worker options: the name, then at least one feature, all known."""
    some = first_error((F.size(features) >= 1, "At least one feature must be selected"), (F.forall(features, lambda x: x.isin(*FEATURES)), "Unknown feature"))
    return F.coalesce(name_error(name), some)


def worker_config(name: Column, features: Column, entry_point: Column, assets: Column, date: Column) -> Column:
    """Configuration of valid options; parts that don't apply are null. A binding needs both features."""
    entry, static = F.array_contains(features, "entryPoint"), F.array_contains(features, "staticAssets")
    has_entry, has_assets = entry & (F.coalesce(entry_point, F.lit("")) != ""), static & (F.coalesce(assets, F.lit("")) != "")
    return F.struct(
        name.alias("name"),
        F.when(has_entry, entry_point).alias("main"),
        date.alias("compatibility_date"),
        F.when(has_entry, F.struct(F.lit(True).alias("enabled"))).alias("observability"),
        F.when(has_assets, F.struct(assets.alias("directory"), F.when(entry, "ASSETS").alias("binding"))).alias("assets"),
    )


SECRET_ITEM = (
    "id string, title string, favorite boolean, version bigint, vault struct<id:string,name:string>, category string, last_edited_by string, created_at string, updated_at string, additional_information string, "
    "sections array<struct<id:string,label:string>>, fields array<struct<id:string,section:struct<id:string,label:string>,type:string,purpose:string,label:string,value:string,reference:string>>"
)
MANIFEST = "name string, dependencies map<string,string>, devDependencies map<string,string>"
PERMISSIONS = "struct<allow:array<string>,deny:array<string>>"
TASK = "struct<cache:boolean,dependsOn:array<string>,env:array<string>,inputs:array<string>,interactive:boolean,interruptible:boolean,outputLogs:string,outputs:array<string>,passThroughEnv:array<string>,persistent:boolean,with:array<string>>"
TASK_CONFIG = (
    f"`$schema` string, boundaries struct<implicitDependencies:array<string>,tags:map<string,struct<dependencies:{PERMISSIONS},dependents:{PERMISSIONS}>>>, cacheDir string, concurrency string, daemon boolean, "
    "dangerouslyDisablePackageManagerCheck boolean, envMode string, futureFlags map<string,string>, globalDependencies array<string>, globalEnv array<string>, globalPassThroughEnv array<string>, noUpdateNotifier boolean, "
    f"remoteCache struct<apiUrl:string,enabled:boolean,loginUrl:string,preflight:boolean,signature:boolean,teamId:string,teamSlug:string,timeout:double,uploadTimeout:double>, tasks map<string,{TASK}>, ui string, extends array<string>, tags array<string>"
)


def json_strict(text: Column, schema: T.StructType | str) -> Column:
    """JSON as a struct; a mistyped field or malformed text raises."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def json_soft(text: Column, schema: T.StructType | str, required: Sequence[str] = ()) -> Column:
    """struct(success, data, error) of JSON: malformed text and missing required fields are errors, unknown keys go."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    got = F.from_json(text, corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    error = F.when(got.isNull() | got["__corrupt"].isNotNull(), "malformed").otherwise(first_error(*((got[r].isNotNull(), f"{r} is required") for r in required)))
    return result(F.struct(*(got[f.name].alias(f.name) for f in schema.fields)), error)


def secret_item_error(item: Column) -> Column:
    """First message of a secret item parsed as SECRET_ITEM."""
    needed = T.StructType.fromDDL(SECRET_ITEM).fieldNames()
    fields = F.forall(item["fields"], lambda f: f["id"].isNotNull() & f["label"].isNotNull() & f["value"].isNotNull() & f["reference"].isNotNull() & f["type"].isin(*FIELD_TYPES) & (f["purpose"].isNull() | f["purpose"].isin(*PURPOSES)) & (f["section"].isNull() | f["section"]["id"].isNotNull()))
    return first_error(
        *((item[n].isNotNull(), f"{n} is required") for n in needed),
        (item["vault"]["id"].isNotNull() & item["vault"]["name"].isNotNull(), "vault is invalid"),
        (one_of(item["category"], CATEGORIES), "category is invalid"),
        (iso_datetime_ok(item["created_at"]) & iso_datetime_ok(item["updated_at"]), "time is invalid"),
        (F.forall(item["sections"], lambda s: s["id"].isNotNull()), "sections are invalid"),
        (fields, "fields are invalid"),
    )


def task_config_error(config: Column) -> Column:
    """First message of a task configuration parsed as TASK_CONFIG: tasks are required, enums must hold."""
    none_or = lambda x, members: x.isNull() | x.isin(*members)
    return first_error(
        (config["tasks"].isNotNull(), "tasks is required"),
        (none_or(config["envMode"], ENV_MODES), "envMode is invalid"),
        (none_or(config["ui"], DISPLAYS), "ui is invalid"),
        (F.forall(F.map_values(config["tasks"]), lambda t: none_or(t["outputLogs"], OUTPUT_LOGS)), "outputLogs is invalid"),
    )


def with_default_schema(schema: Column, default: str) -> Column:
    """A document's `$schema`, or the default where it has none."""
    return F.coalesce(schema, F.lit(default))

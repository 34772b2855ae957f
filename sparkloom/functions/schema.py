"""Schemas for JSON values, compiled to one expression that gives every issue of a value, in order.

    Record({"name": Text(), "ports": Items(Int(), least=1)}).issues(F.try_parse_json("text"))

An issue is struct(path, code, message); path holds the keys and positions (from 0) that lead to it. A value of another
type than the schema's has that issue alone; of the right type, each of its checks that fails gives one. Fields come in the
schema's order, elements by position, entries of a map by key. Fields that a record doesn't name are let pass. It is all
built-in expressions over Variant values, so it runs in the JVM, on any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ISSUE = "struct<path:array<string>,code:string,message:string>"


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def _issue(path: Column, code: str, message: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _all(issues: Sequence[Column]) -> Column:
    return F.concat(*issues) if issues else _none()


def kind(value: Column) -> Column:
    """Type of a Variant value: undefined where there is none, null, string, boolean, number, array or object."""

    def named(shape: Column) -> Column:
        return (
            F.when(value.isNull(), "undefined")
            .when(F.is_variant_null(value), "null")
            .when(shape == "STRING", "string")
            .when(shape == "BOOLEAN", "boolean")
            .when(F.startswith(shape, F.lit("ARRAY")), "array")
            .when(F.startswith(shape, F.lit("OBJECT")), "object")
            .otherwise("number")
        )

    return _let(F.schema_of_variant(value), named)


def iso_datetime_ok(text: Column) -> Column:
    """Whether a text is a day that exists and a time in UTC, seconds and their fractions as may be."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?Z\z") & F.try_to_timestamp(F.left(text, F.lit(10))).isNotNull()


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


class Schema:
    """What a value has to be; `type` is its name in messages."""

    type = "any"

    def checks(self, value: Column, path: Column) -> Column:
        """Issues of a value of the right type."""
        return _none()

    def wrong(self, value: Column, path: Column) -> Column:
        return _issue(path, "invalid_type", F.concat(F.lit(f"Invalid input: expected {self.type}, received "), kind(value)))

    def found(self, value: Column, path: Column) -> Column:
        return F.when(kind(value) != self.type, self.wrong(value, path)).otherwise(self.checks(value, path))

    def issues(self, value: Column) -> Column:
        """array<struct<path, code, message>> of a Variant value, null for one that is not there."""
        return self.found(value, F.array().cast("array<string>"))

    def issues_of_json(self, text: Column) -> Column:
        """issues() of a JSON text; text that is no JSON has one issue, and so has null."""
        root = F.array().cast("array<string>")
        return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), _issue(root, "invalid_json", "Invalid JSON")).otherwise(self.issues(v)))

    def first_message(self, text: Column) -> Column:
        """Message of the first issue of a JSON text; null if there is none."""
        return F.get(self.issues_of_json(text), F.lit(0))["message"]


class Parts(Schema):
    """A value of parts. That it can be taken apart tells its type, so the types of all that is in it are not derived."""

    parts = ""

    def each(self, parts: Column, path: Column) -> Column:
        """Issues of the parts."""
        return _none()

    def found(self, value: Column, path: Column) -> Column:
        return _let(F.try_variant_get(value, "$", self.parts), lambda xs: F.when(xs.isNull(), self.wrong(value, path)).otherwise(self.each(xs, path)))


class Anything(Schema):
    def found(self, value: Column, path: Column) -> Column:
        return _none()


@dataclass(frozen=True)
class Text(Schema):
    """A string; lengths in code points. Messages of checks may be given, as (limit, message)."""

    least: tuple[int, str] | None = None
    most: tuple[int, str] | None = None
    patterns: Sequence[tuple[str, str]] = ()
    moment: bool = False
    type = "string"

    def checks(self, value: Column, path: Column) -> Column:
        def each(x: Column) -> Column:
            rules = [(F.length(x) >= n, "too_small", m) for n, m in filter(None, [self.least])] + [(F.length(x) <= n, "too_big", m) for n, m in filter(None, [self.most])]
            rules += [(x.rlike(p), "invalid_format", m) for p, m in self.patterns]
            if self.moment:
                rules.append((iso_datetime_ok(x), "invalid_format", "Invalid ISO datetime"))
            return _all([F.when(good, _none()).otherwise(_issue(path, code, message)) for good, code, message in rules])

        return _let(as_text(value), each)


class Flag(Schema):
    type = "boolean"


class Number(Schema):
    type = "number"


class Int(Number):
    """A whole number that a double holds exactly."""

    def checks(self, value: Column, path: Column) -> Column:
        x = F.try_variant_get(value, "$", "double")
        return F.when((x == F.floor(x)) & (F.abs(x) < 2**53), _none()).otherwise(_issue(path, "invalid_type", "Invalid input: expected int, received number"))


@dataclass(frozen=True)
class OneOf(Schema):
    members: Sequence[str]

    def found(self, value: Column, path: Column) -> Column:
        shown = "|".join(f'"{m}"' for m in self.members)
        message = f"Invalid option: expected one of {shown}" if len(self.members) > 1 else f"Invalid input: expected {shown}"
        good = (kind(value) == "string") & as_text(value).isin(*self.members)
        return F.when(F.coalesce(good, F.lit(False)), _none()).otherwise(_issue(path, "invalid_value", message))


@dataclass(frozen=True)
class Items(Parts):
    of: Schema
    least: tuple[int, str] | None = None
    type = "array"
    parts = "array<variant>"

    def each(self, parts: Column, path: Column) -> Column:
        inner = F.flatten(F.transform(parts, lambda x, i: self.of.found(x, F.concat(path, F.array(i.cast("string"))))))
        if not self.least:
            return inner
        return F.concat(inner, F.when(F.size(parts) >= self.least[0], _none()).otherwise(_issue(path, "too_small", self.least[1])))


@dataclass(frozen=True)
class Record(Parts):
    fields: Mapping[str, Schema]
    type = "object"
    parts = "map<string,variant>"

    def each(self, parts: Column, path: Column) -> Column:
        return _all([_let(F.try_element_at(parts, F.lit(k)), self._field(k, s, path)) for k, s in self.fields.items()])

    @staticmethod
    def _field(name: str, schema: Schema, path: Column) -> Callable[[Column], Column]:
        return lambda v: schema.found(v, F.concat(path, F.array(F.lit(name))))


@dataclass(frozen=True)
class Entries(Parts):
    """An object with any keys, all of whose values are of one schema."""

    of: Schema
    type = "record"
    parts = "map<string,variant>"

    def each(self, parts: Column, path: Column) -> Column:
        return F.flatten(F.transform(F.map_entries(parts), lambda e: self.of.found(e["value"], F.concat(path, F.array(e["key"])))))


@dataclass(frozen=True)
class Optional(Schema):
    """What may be missing; null is not missing."""

    of: Schema

    def found(self, value: Column, path: Column) -> Column:
        return F.when(value.isNull(), _none()).otherwise(self.of.found(value, path))


class Null(Schema):
    type = "null"


@dataclass(frozen=True)
class Union(Schema):
    """Any of some schemas; else one issue."""

    options: Sequence[Schema]

    def found(self, value: Column, path: Column) -> Column:
        good = reduce(Column.__or__, [F.size(o.found(value, path)) == 0 for o in self.options])
        return F.when(good, _none()).otherwise(_issue(path, "invalid_union", "Invalid input"))


#: Fixed messages and members of the configurations that are known here.
NAME = Text(
    least=(1, "Worker name cannot be empty"),
    most=(54, "Worker name cannot exceed 54 characters"),
    patterns=[
        (r"^[a-z0-9-]+\z", "Worker name can only contain lowercase letters, numbers, and hyphens"),
        (r"^(?:[a-z0-9].*[a-z0-9]|[a-z0-9])\z", "Worker name cannot start or end with a hyphen"),
    ],
)
WORKER_OPTIONS = Record({"name": NAME, "features": Items(OneOf(("entryPoint", "staticAssets")), least=(1, "At least one feature must be selected")), "entryPoint": Optional(Text()), "assetsDirectory": Optional(Text())})

_SECTION = Record({"id": Text(), "label": Optional(Text())})
SECRET_ITEM = Record({
    "id": Text(), "title": Text(), "favorite": Flag(), "version": Int(), "vault": Record({"id": Text(), "name": Text()}), "category": OneOf(("SECURE_NOTE",)),
    "last_edited_by": Text(), "created_at": Text(moment=True), "updated_at": Text(moment=True), "additional_information": Text(), "sections": Items(_SECTION),
    "fields": Items(Record({"id": Text(), "section": Optional(_SECTION), "type": OneOf(("STRING", "CONCEALED", "MONTH_YEAR")), "purpose": Optional(OneOf(("NOTES",))), "label": Text(), "value": Text(), "reference": Text()})),
})

_TEXTS, _FLAG, _TEXT = Optional(Items(Text())), Optional(Flag()), Optional(Text())
_TEXTS_OR_NULL = Optional(Union([Items(Text()), Null()]))
_PERMISSIONS = Optional(Record({"allow": _TEXTS, "deny": _TEXTS}))
_TASK = Record({
    "cache": _FLAG, "dependsOn": _TEXTS, "env": _TEXTS, "inputs": _TEXTS, "interactive": _FLAG, "interruptible": _FLAG, "outputLogs": Optional(OneOf(("errors-only", "full", "hash-only", "new-only", "none"))),
    "outputs": _TEXTS, "passThroughEnv": _TEXTS_OR_NULL, "persistent": _FLAG, "with": _TEXTS,
})
TASK_CONFIG = Record({
    "$schema": _TEXT, "boundaries": Optional(Record({"implicitDependencies": _TEXTS, "tags": Optional(Entries(Record({"dependencies": _PERMISSIONS, "dependents": _PERMISSIONS})))})),
    "cacheDir": _TEXT, "concurrency": _TEXT, "daemon": _FLAG, "dangerouslyDisablePackageManagerCheck": _FLAG, "envMode": Optional(OneOf(("loose", "strict"))), "futureFlags": Optional(Entries(Anything())),
    "globalDependencies": _TEXTS, "globalEnv": _TEXTS, "globalPassThroughEnv": _TEXTS_OR_NULL, "noUpdateNotifier": _FLAG,
    "remoteCache": Optional(Record({"apiUrl": _TEXT, "enabled": _FLAG, "loginUrl": _TEXT, "preflight": _FLAG, "signature": _FLAG, "teamId": _TEXT, "teamSlug": _TEXT, "timeout": Optional(Number()), "uploadTimeout": Optional(Number())})),
    "tasks": Entries(_TASK), "ui": Optional(OneOf(("stream", "tui"))), "extends": _TEXTS, "tags": _TEXTS,
})

"""URL, time, JSON and error functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys whose values are hidden.
SECRET_KEYS = ("key", "apikey", "api_key", "token")
QUERY = r"\?([^#]*)"


def _query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def params(url: Column) -> Column:
    """Decoded (key, value) pairs of the query, in order; empty parts are left out."""
    parts = F.filter(F.split(_query(url), "&", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(_decode(F.substring_index(x, "=", 1)).alias("key"), _decode(F.regexp_replace(x, "^[^=]*=?", "")).alias("value")))


def params_array(url: Column) -> Column:
    """`key=value` of each pair, decoded."""
    return F.transform(params(url), lambda p: F.concat_ws("=", p["key"], p["value"]))


def redacted_params(url: Column) -> Column:
    """Pairs with secret values hidden. The first pair with a secret key stays, later ones of exactly that key go."""
    pairs = params(url)
    secret = lambda p: F.lower(p["key"]).isin(*SECRET_KEYS)
    at = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i")))
    kept = F.filter(at, lambda p: ~secret(p) | (F.array_position(F.transform(pairs, lambda x: x["key"]), p["key"]) == p["i"] + 1))
    return F.transform(kept, lambda p: F.struct(p["key"].alias("key"), F.when(secret(p), "REDACTED").otherwise(p["value"]).alias("value")))


def query_string(pairs: Column) -> Column:
    """Pairs in form encoding."""
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", F.url_encode(p["key"]), F.url_encode(p["value"]))), "&")


def redact(url: Column) -> Column:
    """url with secret query values hidden; a URL without a secret key is not changed at all."""
    secret = F.exists(params(url), lambda p: F.lower(p["key"]).isin(*SECRET_KEYS))
    before, fragment = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, "#.*$", 0)
    return F.when(secret, F.concat(before, F.lit("?"), query_string(redacted_params(url)), fragment)).otherwise(url)


def header_pairs(headers: Column) -> Column:
    """A map of headers as a JSON array of [name, value], by name."""
    entries = F.array_sort(F.map_entries(headers))
    return F.to_json(F.transform(entries, lambda e: F.array(e["key"], e["value"])))


def iso_millis(epoch_millis: Column) -> Column:
    """ISO 8601 in UTC with milliseconds and Z, whatever the session's time zone."""
    day, rest = F.floor(epoch_millis / 86_400_000).cast("int"), F.pmod(epoch_millis, F.lit(86_400_000))
    part = lambda unit, size, digits: F.lpad((F.floor(rest / unit) % size).cast("string"), digits, "0")
    clock = F.concat(part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def today() -> Column:
    """The date in UTC, whatever the session's time zone."""
    return F.left(iso_millis(F.unix_millis(F.current_timestamp())), F.lit(10))


def error_body(is_http: Column, status: Column, message: Column) -> Column:
    """struct(status, body, logged): messages of known errors pass, but for 401; others become a plain 500."""
    text = F.when(~is_http, "internal server error").when((status < 500) & (status == 401), "unauthorized").otherwise(message)
    body = F.to_json(F.struct(F.lit(False).alias("success"), F.struct(text.alias("message")).alias("error")))
    code = F.when(is_http, status).otherwise(500)
    return F.struct(code.cast("int").alias("status"), body.alias("body"), (code >= 500).alias("logged"))


def not_found_body() -> Column:
    return F.to_json(F.struct(F.lit(False).alias("success"), F.struct(F.lit("not found").alias("message")).alias("error")))


def http_error(status: Column, message: Column) -> Column:
    return F.struct(status.alias("status"), message.alias("message"))


def pretty_json(value: Column) -> Column:
    """A record as JSON over several lines, two spaces a level, `"key": value`; arrays of plain values on one line."""
    return F.regexp_replace(F.to_json(value, {"pretty": "true"}), r'(?m)^(\s*"(?:[^"\\]|\\.)*") : ', "$1: ")

"""Templates with named fields and helpers, as one expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.case import HELPERS

_CALL = re.compile(r"\{\{\s*(?:([\w-]+)\s+)?(\w+)\s*\}\}")


def render(template: str, fields: Mapping[str, Column], helpers: Mapping[str, Callable[[Column], Column]] = HELPERS) -> Column:
    """template with `{{ field }}` and `{{ helper field }}` filled in; a null field is empty. Unknown names raise KeyError."""
    parts, at = [], 0
    for m in _CALL.finditer(template):
        value = F.coalesce(fields[m[2]].cast("string"), F.lit(""))
        parts += [F.lit(template[at : m.start()]), helpers[m[1]](value) if m[1] else value]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))

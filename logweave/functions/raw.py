"""Reading of the raw record, kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(keys: list[str]) -> str | None:
    """A JSON path of byte-exact keys (dots do not split); None if a key cannot be written in one."""
    if any("'" in k or "]" in k or not k for k in keys):
        return None
    return "$" + "".join(f"['{k}']" for k in keys)


def value(raw: Column, keys: list[str]) -> Column:
    """The value under the keys as text, containers as JSON; null if absent."""
    found = path(keys)
    if found is not None:
        return F.get_json_object(raw, found)
    out = F.from_json(raw, "map<string,string>")[keys[0]]
    for k in keys[1:]:
        out = F.from_json(out, "map<string,string>")[k]
    return out


def scalar(raw: Column, keys: list[str]) -> Column:
    """The value under the keys, null for containers."""
    found = value(raw, keys)
    return F.when(~found.rlike(r"^\s*[\[{]"), found)


def first_scalar(raw: Column, candidates: list[list[str]]) -> Column:
    return F.coalesce(*[scalar(raw, c) for c in candidates], F.lit(None).cast("string"))

"""Registries of assets and identities as CSV: import with every fault told and nothing half done, and export.

One column for each kind of alias may hold several values. A row with a fault is named with its number, and while there is
one no row is written: rows and their aliases stand in one table, whose change is one commit. What an export writes, an
import reads back the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.functions import ip
from logweave.operators.tables import Table
from logweave.scratch import written

#: Kinds of aliases, columns, levels, separators of several values, and what is no in a cell.
ALIASES = {"asset": ("hostname", "fqdn", "ip", "cidr", "mac"), "identity": ("email", "upn", "sam", "employee_id", "cn")}
COLUMNS = {
    "asset": ("asset_id", "display_name", "criticality", "category", "owner", "business_unit", "environment", "watchlist", "enabled", "notes"),
    "identity": ("identity_id", "display_name", "priority", "department", "manager", "title", "email", "watchlist", "enabled", "notes"),
}
LEVELS = ("critical", "high", "medium", "low", "unknown")
LEVEL_COLUMNS, LISTS = ("criticality", "priority"), ("category", "watchlist")
SEPARATORS = (";", "|", ",")
NO = ("false", "0", "no", "n", "off", "disabled")
_SPACE = " \t\r\n\f\x0b"


def alias(kind: str, value: Column) -> Column:
    """The canonical spelling of an alias of a kind, null for one that cannot be."""
    text = F.lower(F.btrim(value, F.lit(_SPACE)))
    filled = F.nullif(text, F.lit(""))
    if kind in ("hostname", "fqdn"):
        return F.nullif(F.regexp_replace(text, r"\.+$", ""), F.lit(""))
    if kind == "ip":
        return ip.bind(ip.key(text), lambda k: ip.text_of(F.substring(k, 2, 32)))
    if kind == "cidr":
        return ip.bind(
            ip.networked(text),
            lambda n: F.when(n.isNotNull(), F.concat(ip.text_of(F.rpad(F.substring(n["prefix"], 2, 32), F.when(n["prefix"].startswith("4"), 8).otherwise(32), F.lit("0"))), F.lit("/"), n["length"].cast("string"))),
        )
    if kind == "mac":
        digits = F.regexp_replace(text, "[^0-9a-f]", "")
        return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(?!$)", "$1:"))
    if kind in ("email", "upn"):
        return F.when(text.contains("@") & (F.length(text) > 2), text)
    if kind == "sam":
        return F.replace(filled, F.lit("/"), F.lit("\\"))
    if kind in ("employee_id", "cn"):
        return filled
    raise ConfigError(f"unknown kind of alias: {kind}")


def several(cell: Column) -> Column:
    """The values of a cell, lower-cased: the first separator that is there parts them."""
    text = F.btrim(F.coalesce(cell, F.lit("")), F.lit(_SPACE))
    parted = F.array(text)
    for sep in reversed(SEPARATORS):
        parted = F.when(text.contains(sep), F.split(text, rf"\Q{sep}\E", -1)).otherwise(parted)
    return F.filter(F.transform(parted, lambda p: F.lower(F.btrim(p, F.lit(_SPACE)))), lambda p: p != "")


@dataclass
class Plan:
    """What an import would do: the rows, the faults (line, fault) and the lines without any alias. Nothing is written."""

    rows: DataFrame
    faults: DataFrame
    without_alias: DataFrame

    @property
    def ok(self) -> bool:
        return not self.faults.limit(1).count()


def schema(kind: str) -> str:
    kinds = {"enabled": "boolean", **{c: "array<string>" for c in LISTS}}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in COLUMNS[kind]) + ", aliases array<struct<type:string,value:string>>, source string"


def registry(spark: SparkSession, path: str, kind: str, buckets: int = 16) -> Table:
    """The table of a registry in a folder."""
    return Table(spark, path, [f"{kind}_id"], schema(kind), buckets)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows, stored, with their line, the first being 2: numbers of a partition begin behind those of earlier ones."""
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "registry-rows")
    counts = sorted((r[0], r[1]) for r in rows.groupBy(F.shiftright("_id", 33)).count().collect())  # a row a partition
    starts, total = [], 2
    for part, n in counts:
        starts.append((part, total - (part << 33)))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return rows.join(F.broadcast(starts), F.shiftright("_id", 33) == F.col("_part")).withColumn("line", F.col("_id") + F.col("_start")).drop("_id", "_part", "_start")


def plan(spark: SparkSession, path: str, kind: str) -> Plan:
    """Reads a CSV file with a header. Unknown columns, empty, repeated and misspelt values are faults."""
    key, columns, kinds = f"{kind}_id", COLUMNS[kind], ALIASES[kind]
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {c.strip().lower(): c for c in raw.columns}
    fault = lambda text: spark.createDataFrame([(1, text)], "line long, fault string")
    none = spark.createDataFrame([], schema(kind))
    if key not in names:
        return Plan(none, fault(f"the header has no {key!r} column (found: {', '.join(sorted(names)) or 'nothing'})"), none.selectExpr("1L as line").limit(0))
    unknown = sorted(set(names) - set(columns) - set(kinds))
    if unknown:
        return Plan(none, fault(f"unknown column(s): {', '.join(unknown)}"), none.selectExpr("1L as line").limit(0))
    cell = lambda c: F.btrim(F.coalesce(F.col(f"`{names[c]}`"), F.lit("")), F.lit(_SPACE)) if c in names else F.lit("")
    rows = _numbered(raw)
    rows = rows.where(F.concat(*[cell(c) for c in names]) != "")
    found = []
    for k in kinds:
        if k in names:
            found.append(_aliases(k, cell(k)))
    every = F.concat(*found) if found else F.array().cast("array<struct<type:string,raw:string,value:string>>")
    rows = rows.withColumns({"_ident": cell(key), "_aliases": every})
    first = rows.where("_ident <> ''").groupBy("_ident").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = written(rows.join(written(first, "repeated"), "_ident", "left"), "registry-plan")
    bad = F.get(F.filter("_aliases", lambda a: a["value"].isNull()), 0)
    line = F.concat(F.lit("row "), F.col("line").cast("string"), F.lit(": "))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    told = (
        F.when(F.col("_ident") == "", F.concat(line, F.lit(f"{key} is empty")))
        .when(F.col("line") > F.col("_first"), F.concat(line, F.lit(f"{key} "), quoted(F.col("_ident")), F.lit(" appears twice (also on row "), F.col("_first").cast("string"), F.lit(")")))
        .when(bad.isNotNull(), F.concat(line, quoted(bad["raw"]), F.lit(" is not a valid "), bad["type"]))
    )
    rows = rows.withColumn("_fault", told)
    good = rows.where("_fault is null")
    out = []
    for c in columns:
        if c == key:
            value = F.col("_ident")
        elif c in LISTS:
            value = several(cell(c))
        elif c == "enabled":
            value = ~F.lower(cell(c)).isin(*NO)
        elif c in LEVEL_COLUMNS:
            value = F.coalesce(F.nullif(F.lower(cell(c)), F.lit("")), F.lit("medium"))
            value = F.when(value.isin(*LEVELS), value).otherwise("unknown")
        else:
            value = cell(c)
        out.append(value.alias(c))
    kept = F.transform("_aliases", lambda a: F.struct(a["type"].alias("type"), a["value"].alias("value")))
    faults = rows.where("_fault is not null").select("line", F.col("_fault").alias("fault"))
    if not rows.limit(1).count():
        faults = fault("the file has a valid header but no data rows")
    return Plan(good.select(*out, kept.alias("aliases"), F.lit("csv").alias("source")), faults, good.where(F.size("_aliases") == 0).select("line"))


def _aliases(kind: str, cell: Column) -> Column:
    return F.transform(several(cell), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("raw"), alias(kind, v).alias("value")))


def load(table: Table, path: str, kind: str) -> Plan:
    """Imports a file into a registry's table: all of it, or nothing if it has a fault."""
    found = plan(table.spark, path, kind)
    if found.ok:
        table.upsert(found.rows)
    return found


def alias_rows(table: Table) -> DataFrame:
    """Rows (alias, id) that lookups join with; networks are apart."""
    rows = table.read().where("enabled").select(F.explode("aliases").alias("a"), F.col(table.keys[0]))
    return rows.select(F.col("a.value").alias("alias"), F.col("a.type").alias("alias_type"), table.keys[0])


def export(table: Table, kind: str) -> DataFrame:
    """The registry as rows of text cells, with a column for each column and kind of alias, as an import reads them."""
    out = []
    for c in COLUMNS[kind]:
        joined = F.array_join(c, ";") if c in LISTS else F.when(F.col(c), "true").otherwise("false") if c == "enabled" else F.coalesce(F.col(c), F.lit(""))
        out.append(joined.alias(c))
    for k in ALIASES[kind]:
        if k not in COLUMNS[kind]:
            out.append(F.array_join(F.transform(_of(k), lambda a: a["value"]), ";").alias(k))
    return table.read().select(*out)


def _of(kind: str) -> Column:
    return F.filter("aliases", lambda a: a["type"] == kind)

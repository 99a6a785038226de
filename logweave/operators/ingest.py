"""Ingest transforms on normalised events: fallback time, field mappers, drop/mask/route/sample actions, de-dup, store."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.functions import ip
from logweave.functions import raw as raw_json

TEXT_COLUMNS = ("product", "log_type", "severity", "action", "protocol", "app", "user_name", "host_name", "rule_name", "message")
MASKABLE = (*TEXT_COLUMNS, "src_ip", "dst_ip", "src_port", "dst_port", "bytes_total")
PERCENT = 10_000


def fallback_time(events: DataFrame, batch_time: dt.datetime) -> DataFrame:
    """Events without a time get the batch's."""
    kind = events.schema["event_time"].dataType
    return events.withColumn("event_time", F.coalesce("event_time", F.lit(batch_time).cast(kind)))


def identity_hash() -> Column:
    """Identity of an event: vendor, time and raw record."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce("vendor", F.lit("")), F.coalesce(F.col("event_time").cast("string"), F.lit("none")), F.coalesce("raw", F.lit(""))), 256)


def dedup(batch: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Each event once, and none that the store holds."""
    out = batch.withColumn("dedup_hash", identity_hash()).dropDuplicates(["dedup_hash", "event_time"])
    if store is None:
        return out
    return out.join(store.select("dedup_hash", "event_time"), ["dedup_hash", "event_time"], "left_anti")


# -- conditions ----------------------------------------------------------------------------------------------------


def condition(spec: dict | None) -> Column:
    """All of a map's terms: a column or raw key against a value, a list of values, or {contains, regex, cidr, exists}."""
    out = F.lit(True)
    for name, wanted in (spec or {}).items():
        value = F.col(name).cast("string") if name in MASKABLE or name == "vendor" else raw_json.scalar(F.col("raw"), name.split("/"))
        low = F.lower(value)
        if isinstance(wanted, dict):
            for op, arg in wanted.items():
                test = {
                    "contains": lambda: low.contains(str(arg).lower()),
                    "regex": lambda: value.rlike(str(arg)),
                    "cidr": lambda: ip.inside(ip.key(value), str(arg)),
                    "exists": lambda: value.isNotNull() if arg else value.isNull(),
                }.get(op)
                if test is None:
                    raise ConfigError(f"unknown test {op!r} of {name!r}")
                out = out & F.coalesce(test(), F.lit(False))
        else:
            values = [str(v).lower() for v in (wanted if isinstance(wanted, list) else [wanted])]
            out = out & F.coalesce(low.isin(*values), F.lit(False))
    return out


# -- field mappers ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mapper:
    """Fills empty columns from raw keys, or from key-value pairs of a text, where a raw key contains a text."""

    key: str
    contains: str
    fields: dict[str, str]
    vendor: str | None = None
    product: str | None = None
    kv_source: str | None = None
    pair_sep: str = " "


def map_fields(events: DataFrame, mappers: list[Mapper]) -> DataFrame:
    """The first mapper that matches an event fills its empty columns; vendor and product are its word."""
    which = F.lit(-1)
    for i, m in reversed(list(enumerate(mappers))):
        source = F.col(m.key) if m.key in events.columns else raw_json.value(F.col("raw"), [m.key])
        which = F.when(F.coalesce(F.lower(source).contains(m.contains.lower()), F.lit(False)), F.lit(i)).otherwise(which)
    out = events.withColumn("_mapper", which)
    new: dict[str, Column] = {}
    for i, m in enumerate(mappers):
        mine = F.col("_mapper") == i
        for key, column in m.fields.items():
            if m.kv_source:
                text = F.col(m.kv_source) if m.kv_source in events.columns else raw_json.value(F.col("raw"), [m.kv_source])
                found = F.try_element_at(pairs(text, m.pair_sep), F.lit(key))
            else:
                found = raw_json.scalar(F.col("raw"), key.split("/"))
            now = new.get(column, F.col(column))
            empty = now.isNull() | (now.cast("string") == "")
            new[column] = F.when(mine & empty & found.isNotNull(), found.try_cast(events.schema[column].dataType)).otherwise(now)
        for column, value in (("vendor", m.vendor), ("product", m.product)):
            if value:
                new[column] = F.when(mine, F.lit(value)).otherwise(new.get(column, F.col(column)))
    return out.withColumns(new).drop("_mapper")


def pairs(text: Column, sep: str = " ") -> Column:
    """A map of k=v pairs; values may be quoted, the last of equal keys wins."""
    stop = r"\s" if sep == " " else "\\Q" + sep + "\\E"
    pattern = rf'([A-Za-z_][\w.-]*)=("[^"]*"|[^{stop}]*)' if sep == " " else rf'([A-Za-z_][\w.-]*)=("[^"]*"|(?:(?!{stop}).)*)'
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.btrim(v, F.lit('"')))
    # the reversed arrays put the last value of a key first, and only firsts are kept
    zipped = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))

    def firsts(z: Column) -> Column:
        names = F.transform(z, lambda y: y["k"])
        return ip.bind(names, lambda n: F.map_from_entries(F.filter(z, lambda x, i: F.array_position(n, x["k"]) == i + 1)))

    return ip.bind(zipped, firsts)


# -- actions -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Action:
    id: str
    kind: str  # drop, mask, route, sample
    when: dict = field(default_factory=dict)
    order: int = 100
    fields: tuple[str, ...] = ()
    raw_keys: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    method: str = "redact"
    salt: str = ""
    to: dict = field(default_factory=dict)
    modulus: int = 1
    numerator: int = 1
    key: tuple[str, ...] = ()

    @classmethod
    def parse(cls, doc: dict) -> Action:
        kind = doc.get("action")
        if kind not in ("drop", "mask", "route", "sample"):
            raise ConfigError(f"{doc.get('id')}: unknown action {kind!r}")
        mask, sample = doc.get("mask") or {}, doc.get("sample") or {}
        modulus, numerator = 1, 1
        if kind == "sample":
            if ("rate" in sample) == ("percent" in sample):
                raise ConfigError(f"{doc.get('id')}: sample takes a rate or a percentage")
            if "rate" in sample:
                modulus = int(sample["rate"])
                if modulus < 1:
                    raise ConfigError(f"{doc.get('id')}: the rate is at least 1")
            else:
                if not 0 < float(sample["percent"]) <= 100:
                    raise ConfigError(f"{doc.get('id')}: the percentage is above 0, up to 100")
                modulus, numerator = PERCENT, round(float(sample["percent"]) * 100)
        key = sample.get("key") or ()
        key = (key,) if isinstance(key, str) else tuple(key)
        for name in (*mask.get("fields", ()), *key):
            if name not in MASKABLE and name != "vendor":
                raise ConfigError(f"{doc.get('id')}: {name!r} is no column")
        return cls(
            str(doc["id"]), kind, doc.get("when") or {}, int(doc.get("order", 100)), tuple(mask.get("fields", ())), tuple(mask.get("raw", ())),
            tuple(mask.get("patterns", ())), mask.get("method", "redact"), mask.get("salt", ""), dict(doc.get("route") or {}), modulus, numerator, key,
        )


def _hidden(action: Action, value: Column) -> Column:
    if action.method == "hash":
        return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(action.salt), value.cast("string")), 256), 1, 16))
    return F.lit("[redacted]")


#: Values of so many characters are hidden inside words too, and the network of pseudonym addresses.
EMBEDDED_FROM = 8
PSEUDONYMS = ("100.64.0.0", 22)


def pseudonym(action: Action, value: Column) -> Column:
    """An address of the shared address space (100.64.0.0/10) that stands for a value: equal for equal ones."""
    digest = F.sha2(F.concat(F.lit(action.salt), value.cast("string")), 256)
    host = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").bitwiseAND(F.lit((1 << PSEUDONYMS[1]) - 1))
    parts = [F.lit("100"), 64 + F.shiftright(host, 16), F.shiftright(host, 8).bitwiseAND(F.lit(255)), host.bitwiseAND(F.lit(255))]
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _literal_regex(value: Column) -> Column:
    """The value as a pattern: a long one anywhere, a short one where it stands as a whole word."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    word, long = "^[A-Za-z0-9_]$", F.length(value) >= EMBEDDED_FROM
    left = F.when(long | ~F.substring(value, 1, 1).rlike(word), "").otherwise(r"(?<![A-Za-z0-9_])")
    right = F.when(long | ~F.substring(value, -1, 1).rlike(word), "").otherwise(r"(?![A-Za-z0-9_])")
    return F.concat(left, quoted, right)


def mask(events: DataFrame, action: Action) -> DataFrame:
    """Named columns are replaced (redacted addresses and numbers become null, hashed addresses a pseudonym one), and
    their former values wherever else they stand, short ones as whole words; raw keys at the top level are replaced;
    patterns are replaced in all texts and raw values."""
    hit = condition(action.when)
    out = events.withColumn("_hit", hit)
    texts = [c for c in TEXT_COLUMNS if c in events.columns]
    for name in action.fields:
        out = out.withColumn("_old", F.when(F.col("_hit"), F.col(name).cast("string")))
        known = F.length("_old") > 0
        address = name in ("src_ip", "dst_ip") and action.method == "hash"
        new = (pseudonym if address else _hidden)(action, F.col("_old"))
        places = {c: F.when(known, F.regexp_replace(F.col(c), _literal_regex(F.col("_old")), new)).otherwise(F.col(c)) for c in texts if c != name}
        if "raw" in events.columns:
            escaped = F.replace(F.replace("_old", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
            pattern = F.concat(_literal_regex(escaped), F.lit(r"(?![^\"]*\"\s*:)"))
            places["raw"] = F.when(known, F.regexp_replace("raw", pattern, new)).otherwise(F.col("raw"))
        own = new if name in TEXT_COLUMNS or address else F.lit(None).cast(events.schema[name].dataType)
        places[name] = F.when(F.col("_old").isNotNull(), own).otherwise(F.col(name))
        out = out.withColumns(places).drop("_old")
    for key in action.raw_keys:
        name = r"\Q" + json.dumps(key, ensure_ascii=False).replace(r"\E", r"\E\\E\Q") + r"\E"
        pattern = rf'({name}\s*:\s*)("(?:[^"\\]|\\.)*"|[^,}}\]\s]+)'
        value = raw_json.value(F.col("raw"), [key])
        new = F.concat(F.lit('$1"'), _hidden(action, value), F.lit('"'))
        out = out.withColumn("raw", F.when(F.col("_hit") & value.isNotNull(), F.regexp_replace("raw", F.lit(pattern), new)).otherwise(F.col("raw")))
    for pattern in action.patterns:
        places = {c: F.when(F.col("_hit"), F.regexp_replace(c, pattern, "[redacted]")).otherwise(F.col(c)) for c in texts}
        if "raw" in events.columns:
            in_value = rf"(?:{pattern})(?![^\"]*\"\s*:)"
            places["raw"] = F.when(F.col("_hit"), F.regexp_replace("raw", in_value, "[redacted]")).otherwise(F.col("raw"))
        out = out.withColumns(places)
    return out.drop("_hit")


def sample_kept(action: Action) -> Column:
    """Whether an event's hash bucket is kept: by the key's values, else by the event's identity. Stable across runs."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in action.key]) if action.key else identity_hash()
    bucket = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long") % action.modulus
    return bucket < action.numerator


def apply_actions(events: DataFrame, actions: list[Action]) -> DataFrame:
    """All actions by (order, id); later ones see what earlier ones have changed. applied names those that hit."""
    out = events.withColumn("applied", F.array().cast("array<string>"))
    for a in sorted(actions, key=lambda a: (a.order, a.id)):
        hit = condition(a.when)
        if a.kind == "drop":
            out = out.where(~hit)
            continue
        if a.kind == "sample":
            out = out.where(~hit | sample_kept(a))
            continue
        out = out.withColumn("applied", F.when(hit, F.array_append("applied", F.lit(a.id))).otherwise(F.col("applied")))
        if a.kind == "mask":
            out = mask(out, a)
        else:
            out = out.withColumns({c: F.when(hit, F.lit(str(v))).otherwise(F.col(c)) for c, v in a.to.items() if c in ("vendor", "product", "log_type")})
    return out


class Accounting:
    """What became of a batch, counted by the job that writes it: total, dropped by actions, duplicates, inserted. counts()
    waits for that job; steps of the job that are computed twice would be counted twice, so it reads stored rows."""

    def __init__(self) -> None:
        self.came, self.kept, self.new = Observation(), Observation(), Observation()

    @staticmethod
    def seen(df: DataFrame, at: Observation) -> DataFrame:
        return df.observe(at, F.count(F.lit(1)).alias("n"))

    def counts(self) -> dict[str, int]:
        total, kept, new = (int(o.get["n"]) for o in (self.came, self.kept, self.new))
        return {"total": total, "inserted": new, "dropped": total - kept, "duplicates": kept - new}


def chain(
    events: DataFrame, *, batch_time: dt.datetime, mappers=(), actions=(), models=None, store: DataFrame | None = None, counted: Accounting | None = None
) -> DataFrame:
    """The ingest order: fallback time, mappers, actions, tags, de-dup. The same function serves batches and streams."""
    out = fallback_time(events, batch_time)
    if counted is not None:
        out = counted.seen(out, counted.came)
    if mappers:
        out = map_fields(out, list(mappers))
    if actions:
        out = apply_actions(out, list(actions))
    if counted is not None:
        out = counted.seen(out, counted.kept)
    if models is not None:
        out = models.tag(out)
    out = dedup(out, store)
    return out if counted is None else counted.seen(out, counted.new)


def accounting(total: int, dropped: int, stored: int) -> dict[str, int]:
    return {"total": total, "inserted": stored, "dropped": dropped, "duplicates": total - dropped - stored}


def write_store(events: DataFrame, path: str) -> None:
    """Appends to the month-partitioned store, rows of a month sorted by time for row-group statistics."""
    rows = events.withColumn("event_month", F.date_format("event_time", "yyyy-MM"))
    rows.sortWithinPartitions("event_month", "event_time").write.mode("append").partitionBy("event_month").parquet(path)

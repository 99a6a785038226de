"""Detection rules (a subset of Sigma) compiled to boolean columns, alerts, and the import of foreign rules.

Compiling happens on the driver; base64 and dash variants are expanded there. A rule that cannot be compiled is
reported and disabled, the others run. Rules are evaluated in groups of GROUP in one projection over a few shared columns.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.errors import ConfigError
from logweave.functions import ip
from logweave.functions import raw as raw_json

GROUP = 40
MESSAGE_CHARS = 1000
#: Spellings of fields in rules, and vendors of a log source's product.
ALIASES = {
    "sourceip": "src_ip", "srcip": "src_ip", "source_ip": "src_ip", "src": "src_ip",
    "destinationip": "dst_ip", "dstip": "dst_ip", "destination_ip": "dst_ip", "dst": "dst_ip",
    "sourceport": "src_port", "srcport": "src_port", "destinationport": "dst_port", "dstport": "dst_port",
    "user": "user_name", "username": "user_name", "account": "user_name",
    "computername": "host_name", "hostname": "host_name", "host": "host_name", "msg": "message",
    "eventid": "event_id", "event id": "event_id", "event_code": "event_id", "eventcode": "event_id",
}
VENDORS = {"windows": ["microsoft"], "linux": ["linux", "syslog"], "aws": ["aws"], "gcp": ["gcp"], "azure": ["microsoft"]}
COLUMNS = (
    "vendor product log_type severity action src_ip dst_ip src_port dst_port protocol app user_name host_name rule_name bytes_total message"
).split()
LEVELS = ("informational", "low", "medium", "high", "critical")
_DASHES = ("-", "/", "–", "—", "―")
_MODIFIERS = frozenset(
    "contains startswith endswith re i m s cidr lt lte gt gte exists fieldref base64 base64offset windash all cased".split()
)


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str
    detection: dict
    logsource: dict = field(default_factory=dict)
    datamodels: tuple[str, ...] = ()
    tactics: tuple[str, ...] = ()
    techniques: tuple[str, ...] = ()

    @classmethod
    def parse(cls, doc: dict) -> Rule:
        detection = doc.get("detection")
        if not isinstance(detection, dict) or not [k for k in detection if k != "condition"]:
            raise ConfigError(f"{doc.get('id') or doc.get('title')}: needs a detection with a selection")
        tags = [str(t).lower() for t in doc.get("tags") or []]
        attack = [t.split(".", 1)[1] for t in tags if t.startswith(("attack.", "atlas."))]
        techniques = tuple(t.upper() for t in attack if re.fullmatch(r"(t\d{4}(\.\d{3})?|aml\.t\d{4}(\.\d{3})?)", t))
        tactics = tuple(t.replace("_", " ") for t in attack if t.upper() not in techniques and not re.match(r"[gs]\d{4}$", t))
        models = doc.get("datamodels") or ()
        models = (models,) if isinstance(models, str) else tuple(models)
        level = str(doc.get("level") or "medium").lower()
        return cls(
            str(doc.get("id") or doc.get("title")),
            str(doc.get("title") or doc.get("id")),
            level if level in LEVELS else "medium",
            detection,
            doc.get("logsource") or {},
            models,
            tactics,
            techniques,
        )


#: Fixed value: objects are opened down to this depth below the record.
DEEPEST = 16


def flat_raw(raw: Column) -> Column:
    """The raw record as structs (k, v): lower-cased, dot-joined keys and the text of values that are no objects. One
    step of the aggregation opens the objects of one depth; where none is left the rest of the steps do nothing. A record
    without any object is left as it is."""
    none = F.array().cast("array<struct<k:string,v:string>>")

    def entries(text: Column, prefix: Column) -> Column:
        pairs = F.map_entries(F.from_json(text, "map<string,string>"))
        return F.transform(pairs, lambda x: F.struct(F.lower(F.concat(prefix, x["key"])).alias("k"), x["value"].alias("v")))

    is_object = lambda e: F.coalesce(e["v"].startswith("{") & F.from_json(e["v"], "map<string,string>").isNotNull(), F.lit(False))

    def opened(acc: Column, _: Column) -> Column:
        inner = F.flatten(F.transform(F.filter(acc["open"], is_object), lambda e: entries(e["v"], F.concat(e["k"], F.lit(".")))))
        leaves = F.concat(acc["done"], F.filter(acc["open"], lambda e: ~is_object(e)))
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(F.struct(leaves.alias("done"), F.coalesce(inner, none).alias("open")))

    top = F.coalesce(entries(raw, F.lit("")), none)
    steps = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), F.struct(none.alias("done"), t.alias("open")), opened, lambda acc: acc["done"])
    return ip.bind(top, lambda t: F.when(F.exists(t, is_object), steps(t)).otherwise(t))


class Compiler:
    """Columns of one rule. Fields are event columns first, then raw keys whatever their case."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = {c for c in columns if c in COLUMNS}

    def value(self, name: str) -> Column:
        low = name.lower()
        column = low if low in self.columns else ALIASES.get(low, low)
        if column in self.columns:
            return F.col(column).cast("string")
        hits = F.filter(F.col("_flat"), lambda e: e["k"].isin(low, column))
        return F.get(hits, 0)["v"]

    def each(self, name: str, test) -> Column:
        """The test on the field's value; on any element where the value is a list."""
        v = self.value(name)
        if ALIASES.get(name.lower(), name.lower()) in self.columns:
            return F.coalesce(test(v), F.lit(False))
        listed = F.from_json(v, "array<string>")
        any_of = F.exists(listed, lambda x: F.coalesce(test(x), F.lit(False)))
        return F.coalesce(F.when(v.startswith("["), any_of).otherwise(test(v)), F.lit(False))

    def field_test(self, spec: str, expected: object) -> Column:
        name, *modifiers = spec.split("|")
        unknown = set(modifiers) - _MODIFIERS
        if unknown:
            raise ConfigError(f"unknown modifier {sorted(unknown)[0]!r} in {spec!r}")
        if "exists" in modifiers:
            v = self.value(name)
            there = F.coalesce(F.length(v) > 0, F.lit(False))
            return there if expected in (True, "true", "yes", 1) else ~there
        values = expected if isinstance(expected, list) else [expected]
        tests = [self.one(name, modifiers, v) for v in values]
        if "cidr" in modifiers and "all" not in modifiers and values:
            for v in values:
                ip.bounds(str(v))  # a network that cannot be read disables the rule
            return self.each(name, lambda v: ip.within(ip.key(v), [str(x) for x in values]))
        if not tests:
            return F.lit(False)
        return reduce((lambda a, b: a & b) if "all" in modifiers else (lambda a, b: a | b), tests)

    def one(self, name: str, modifiers: list[str], value: object) -> Column:
        cased = "cased" in modifiers
        if value is None:
            v = self.value(name)
            return v.isNull() | (v == "")
        if "fieldref" in modifiers:
            other = self.value(str(value))
            left = self.value(name)
            same = left == other if cased else F.lower(left) == F.lower(other)
            return F.coalesce(same, F.lit(False))
        if "cidr" in modifiers:
            ip.bounds(str(value))  # a network that cannot be read disables the rule
            return self.each(name, lambda v: ip.inside(ip.key(v), str(value)))
        for m in ("lt", "lte", "gt", "gte"):
            if m in modifiers:
                bound = float(value)
                op = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}[m]
                return self.each(name, lambda v: op(v.try_cast("double"), F.lit(bound)))
        text = "true" if value is True else "false" if value is False else str(value)
        if "re" in modifiers:
            return self.each(name, regex_test(text, modifiers))
        wanted = expansions(text, modifiers)
        tests = [self.each(name, text_test(w, modifiers, cased)) for w in wanted]
        return reduce(lambda a, b: a | b, tests)

    def keyword(self, value: object) -> Column:
        low = str(value).lower()
        in_columns = [F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False)) for c in sorted(self.columns)]
        in_raw = F.exists(F.col("_flat"), lambda e: F.coalesce(F.lower(e["v"]).contains(low), F.lit(False)))
        return reduce(lambda a, b: a | b, [*in_columns, in_raw])

    def selection(self, spec: object) -> Column:
        """A map is AND, a list is OR; plain values are keywords."""
        if isinstance(spec, dict):
            tests = [self.field_test(str(k), v) for k, v in spec.items()]
            return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)
        if isinstance(spec, list):
            tests = [self.selection(x) if isinstance(x, (dict, list)) else self.keyword(x) for x in spec]
            return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        return self.keyword(spec)

    def selections(self, rule: Rule) -> dict[str, Column]:
        return {k: self.selection(v) for k, v in rule.detection.items() if k != "condition"}

    def rule(self, rule: Rule, model_tags: dict[str, str] | None = None) -> Column:
        selections = self.selections(rule)
        condition = rule.detection.get("condition")
        texts = condition if isinstance(condition, list) else [condition or ""]
        out = reduce(lambda a, b: a | b, [Condition(str(c), selections).column() for c in texts])
        return out & self.logsource_gate(rule) & self.model_gate(rule, model_tags)

    def logsource_gate(self, rule: Rule) -> Column:
        """Whether the event is of the rule's log source; true for a rule without one."""
        gates = [self.same(name, rule.logsource[name]) for name in ("vendor", "log_type") if name in rule.logsource]
        if "service" in rule.logsource:
            gates.append(self.same("log_type", rule.logsource["service"]))
        if "product" in rule.logsource:
            product = str(rule.logsource["product"]).lower()
            makers = [self.same("vendor", vendor) for vendor in VENDORS.get(product, [])]
            gates.append(reduce(lambda a, b: a | b, makers, self.same("product", product)))
        return reduce(lambda a, b: a & b, gates, F.lit(True))

    def model_gate(self, rule: Rule, model_tags: dict[str, str] | None = None) -> Column:
        """Whether the event is of a data model that the rule is bound to; true for a rule that is not bound."""
        if not rule.datamodels:
            return F.lit(True)
        tags = []
        for m in rule.datamodels:
            if not model_tags or m.lower() not in model_tags:
                raise ConfigError(f"{rule.id}: unknown data model {m!r}")
            tags.append(model_tags[m.lower()])
        return F.coalesce(F.arrays_overlap("cim_models", F.array(*[F.lit(t) for t in tags])), F.lit(False))

    def same(self, name: str, value: object) -> Column:
        return F.coalesce(F.lower(self.value(name)) == str(value).lower(), F.lit(False))


def regex_test(pattern: str, modifiers: list[str]):
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    flags = "".join(m for m in ("i", "m", "s") if m in modifiers) + ("" if "cased" in modifiers or "i" in modifiers else "i")
    return lambda v: v.rlike(f"(?{flags}){pattern}" if flags else pattern)


def check_regex(spark: SparkSession, pattern: str) -> str | None:
    """Java's complaint about a pattern, if it has one."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(re.sub(r"\(\?P<", "(?<", pattern))
    except Exception as e:  # py4j wraps PatternSyntaxException
        return str(getattr(e, "java_exception", e)).split("\n")[0]
    return None


def glob_regex(text: str) -> str:
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text)
    return f"(?s)^{out}$"


def text_test(wanted: str, modifiers: list[str], cased: bool):
    low = wanted if cased else wanted.lower()

    def test(v: Column) -> Column:
        v = v if cased else F.lower(v)
        for m, method in (("contains", Column.contains), ("startswith", Column.startswith), ("endswith", Column.endswith)):
            if m in modifiers:
                return method(v, low)
        return v.rlike(glob_regex(low)) if any(c in low for c in "*?") else v == low

    return test


def expansions(text: str, modifiers: list[str]) -> list[str]:
    """The values that a modified one stands for."""
    out = [text]
    if "windash" in modifiers:
        out = list(dict.fromkeys([text] + [re.sub(r"(^|(?<=\s))[-/](?=\S)", d, text) for d in _DASHES]))
    if "base64" in modifiers:
        out = [base64.b64encode(x.encode()).decode() for x in out]
    elif "base64offset" in modifiers:
        out = [s for x in out for s in _offsets(x.encode())]
    return out


def _offsets(data: bytes) -> list[str]:
    """The text of data at each of the three alignments, less the digits that neighbours would change."""
    out = []
    for shift in range(3):
        whole = base64.b64encode(b"\0" * shift + data).decode()
        first = -(-shift * 8 // 6)
        last = (shift + len(data)) * 8 // 6
        out.append(whole[first:last])
    return out


class Condition:
    """and, or, not, parentheses, "N of", "all of", them and name patterns. Unknown names are false."""

    _LEX = re.compile(r"\s*(\(|\)|[^\s()]+)")

    def __init__(self, text: str, selections: dict[str, Column]) -> None:
        self.words, self.selections, self.at = self._LEX.findall(text), selections, 0
        self.missing: list[str] = []

    def column(self) -> Column:
        if not self.words:
            return reduce(lambda a, b: a & b, self.selections.values())
        out = self._or()
        if self.at < len(self.words):
            raise ConfigError(f"unexpected {self.words[self.at]!r} in a condition")
        return out

    def _peek(self) -> str:
        return self.words[self.at].lower() if self.at < len(self.words) else ""

    def _next(self) -> str:
        if self.at >= len(self.words):
            raise ConfigError("a condition ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def _or(self) -> Column:
        out = self._and()
        while self._peek() == "or":
            self._next()
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self._peek() == "and":
            self._next()
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._peek() == "not":
            self._next()
            return ~self._not()
        return self._atom()

    def _atom(self) -> Column:
        word = self._next()
        if word == "(":
            out = self._or()
            if self._next() != ")":
                raise ConfigError("a parenthesis is not closed")
            return out
        if (word.isdigit() or word.lower() == "all") and self._peek() == "of":
            self._next()
            return self._of(word.lower(), self._next() if self.at < len(self.words) else "")
        if word not in self.selections:
            self.missing.append(word)
            return F.lit(False)
        return self.selections[word]

    def _of(self, count: str, target: str) -> Column:
        if target.lower() == "them":
            found = list(self.selections.values())
        elif target.endswith("*"):
            found = [c for k, c in self.selections.items() if k.startswith(target[:-1])]
        else:
            found = [self.selections[target]] if target in self.selections else []
        if not found:
            self.missing.append(target)
            return F.lit(False)
        if count == "all":
            return reduce(lambda a, b: a & b, found)
        if count == "1":
            return reduce(lambda a, b: a | b, found)
        return reduce(lambda a, b: a + b, [c.cast("int") for c in found]) >= int(count)


@dataclass
class Compiled:
    rules: list[tuple[Rule, Column]]
    disabled: dict[str, str]


def compile_rules(rules: list[Rule], columns: list[str], model_tags: dict[str, str] | None = None, spark: SparkSession | None = None) -> Compiled:
    """Every rule's column; rules that cannot be compiled are reported by id."""
    out = Compiled([], {})
    for rule in rules:
        try:
            for pattern in _patterns(rule.detection) if spark else ():
                problem = check_regex(spark, pattern)
                if problem:
                    raise ConfigError(problem)
            out.rules.append((rule, Compiler(columns).rule(rule, model_tags)))
        except (ConfigError, ValueError) as e:
            out.disabled[rule.id] = str(e)
    return out


def _patterns(spec: object, key: str = "") -> list[str]:
    if isinstance(spec, dict):
        return [p for k, v in spec.items() for p in _patterns(v, str(k))]
    if isinstance(spec, list):
        return [p for v in spec for p in _patterns(v, key)]
    return [str(spec)] if "re" in key.split("|")[1:] else []


def matches(events: DataFrame, compiled: Compiled) -> DataFrame:
    """events with the column rule_ids: the rules that match, as a sorted array."""
    out = events.withColumn("_flat", flat_raw(F.col("raw")))
    groups = []
    for at in range(0, len(compiled.rules), GROUP):
        part = compiled.rules[at : at + GROUP]
        out = out.withColumn(f"_g{at}", F.array_compact(F.array(*[F.when(c, F.lit(r.id)) for r, c in part])))
        groups.append(f"_g{at}")
    found = F.concat(*groups) if groups else F.array().cast("array<string>")
    return out.withColumn("rule_ids", F.array_sort(found)).drop("_flat", *groups)


def matched(events: DataFrame, compiled: Compiled) -> DataFrame:
    """One row per event and rule that matches, in column rule_id."""
    # explode_outer: for explode() the optimizer would compute all rules a second time, for a filter on the size
    return matches(events, compiled).withColumn("rule_id", F.explode_outer("rule_ids")).where(F.col("rule_id").isNotNull())


def alerts(events: DataFrame, compiled: Compiled) -> DataFrame:
    """One row per rule and event, with the rule's metadata from a map (no join)."""
    if not compiled.rules:
        compiled = Compiled([], {})
    by = {r.id: r for r, _ in compiled.rules}
    rows = matched(events, compiled)

    def meta(get, kind: str) -> Column:
        if not by:
            return F.lit(None).cast(kind)
        pairs = [x for k, r in by.items() for x in (F.lit(k), get(r))]
        return F.element_at(F.create_map(*pairs), F.col("rule_id"))

    def listed(values) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return rows.select(
        "rule_id",
        meta(lambda r: F.lit(r.title), "string").alias("rule_title"),
        meta(lambda r: F.lit(r.level), "string").alias("level"),
        meta(lambda r: listed(r.tactics), "array<string>").alias("tactics"),
        meta(lambda r: listed(r.techniques), "array<string>").alias("techniques"),
        "event_time",
        "vendor",
        "src_ip",
        "dst_ip",
        "user_name",
        "host_name",
        F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE_CHARS).alias("message"),
        F.sha2(F.concat_ws("|", "rule_id", F.col("id").cast("string")), 256).alias("dedup_hash"),
        F.col("id").alias("event_id"),
    ).dropDuplicates(["rule_id", "dedup_hash"])


def diagnose(events: DataFrame, rule: Rule, model_tags: dict[str, str] | None = None) -> DataFrame:
    """events with a rule's verdict and why: matched, logsource_ok, datamodel_ok, and selections, a map of each by name.
    A rule that cannot be compiled raises ConfigError."""
    compiler = Compiler(events.columns)
    named = [x for k, c in compiler.selections(rule).items() for x in (F.lit(k), F.coalesce(c, F.lit(False)))]
    verdict = {
        "matched": F.coalesce(compiler.rule(rule, model_tags), F.lit(False)),
        "logsource_ok": compiler.logsource_gate(rule),
        "datamodel_ok": compiler.model_gate(rule, model_tags),
        "selections": F.create_map(*named),
    }
    return events.withColumn("_flat", flat_raw(F.col("raw"))).withColumns(verdict).drop("_flat")


def dry_run(events: DataFrame, rule: Rule, limit: int = 200, model_tags: dict[str, str] | None = None) -> DataFrame:
    """The verdict on the latest events, at most 1,000: what a rule would do before it is enabled. No alert is stored."""
    latest = events.orderBy(F.col("event_time").desc_nulls_last(), F.col("id").desc()).limit(min(max(limit, 1), 1000))
    return diagnose(latest, rule, model_tags)


def new_alerts(found: DataFrame, store: DataFrame) -> DataFrame:
    """Alerts that the store does not hold."""
    return found.join(store.select("rule_id", "dedup_hash"), ["rule_id", "dedup_hash"], "left_anti")


def lint(doc: dict) -> list[str]:
    """What an author should know about a rule; an undefined selection is silently false at run time."""
    try:
        rule = Rule.parse(doc)
    except ConfigError as e:
        return [str(e)]
    out = []
    selections = {k: F.lit(True) for k in rule.detection if k != "condition"}
    conditions = rule.detection.get("condition") or ""
    for c in conditions if isinstance(conditions, list) else [conditions]:
        parsed = Condition(str(c), selections)
        try:
            parsed.column()
        except ConfigError as e:
            out.append(str(e))
        out += [f"the condition names {m!r}, which is no selection" for m in parsed.missing]
    if not rule.techniques:
        out.append("no technique is tagged")
    if "title" not in doc:
        out.append("there is no title")
    return out


def import_foreign(docs: list[dict], known: set[str]) -> tuple[list[Rule], dict[str, str]]:
    """Foreign rules with a log source that can be gated, once by id, and why the others are skipped."""
    out, skipped = [], {}
    for doc in docs:
        name = str(doc.get("id") or doc.get("title") or "?")
        source = doc.get("logsource") or {}
        if name in known:
            skipped[name] = "there is a rule with this id"
        elif any(k in doc for k in ("correlation", "action")):
            skipped[name] = "not a single-event rule"
        elif str(doc.get("status", "")).lower() in ("deprecated", "unsupported"):
            skipped[name] = "deprecated"
        elif not ({"product", "service", "vendor", "log_type"} & set(source)):
            skipped[name] = "the log source names neither product nor service"
        elif "timeframe" in (doc.get("detection") or {}) or "|" in re.sub(r"\S+\|\S+:", "", str((doc.get("detection") or {}).get("condition", ""))):
            skipped[name] = "aggregations are not supported"
        else:
            try:
                out.append(Rule.parse(doc))
                known = known | {name}
            except ConfigError as e:
                skipped[name] = str(e)
    return out, skipped

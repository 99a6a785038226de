"""Syntax tree to DataFrame: analysis and lowering in one walk. Catalyst does the optimising.

Divergences on purpose: a number compared with text compares as numbers; relative times are taken from as_of; rows
without an order are made deterministic by id where a stage must pick one.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.errors import QueryError
from logweave.functions import raw as raw_json
from logweave.functions import text as text_fn
from logweave.functions import times
from logweave.plans import nodes as n
from logweave.plans.scope import BASE, CARRIED, Scope

#: Elements of a values() or list() cell.
CELL_CAP = 10_000
#: Parts that a group's values are dealt over before they are cut.
CELL_SALTS = 64
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _conjuncts(node: n.Node | None) -> list[n.Node]:
    if isinstance(node, n.Binary) and node.op == "and":
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [] if node is None else [node]


class Lowering:
    def __init__(self, events: DataFrame, as_of: dt.datetime, models=None, cell_cap: int = CELL_CAP) -> None:
        self.df, self.as_of, self.models, self.cell_cap = events, as_of, models, cell_cap
        self.scope = Scope(tuple(c for c in BASE if c in events.columns))
        self.partitioned = "event_month" in events.columns

    # -- names -------------------------------------------------------------------------------------------------

    def column(self, name: str, pos: int) -> Column:
        live = self.scope.live(name)
        if live is not None:
            return F.col(f"`{live}`")
        if name in self.scope.hidden:
            raise QueryError(f"{name!r} is not a field of the model {self.scope.model}; it has {', '.join(self.scope.columns)}", pos)
        if self.scope.row_level and name not in CARRIED and "raw" in self.df.columns:
            return raw_json.value(F.col("raw"), [name])
        return F.col(f"`{self.scope.need(name, pos)}`")

    def is_time(self, node: n.Node) -> bool:
        return isinstance(node, n.Field) and self.scope.live(node.name) in self.scope.times

    def kind(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("x")).schema[0].dataType

    # -- expressions -------------------------------------------------------------------------------------------

    def predicate(self, node: n.Node) -> Column:
        out = self.expr(node)
        if not isinstance(self.kind(out), T.BooleanType):
            raise QueryError("expected a condition", node.pos)
        return out

    def expr(self, node: n.Node) -> Column:
        return getattr(self, f"_{type(node).__name__.lower()}")(node)

    def _literal(self, node: n.Literal) -> Column:
        return F.lit(node.value)

    def _field(self, node: n.Field) -> Column:
        return self.column(node.name, node.pos)

    def _term(self, node: n.Term) -> Column:
        if not self.scope.row_level or "search_tokens" not in self.df.columns:
            raise QueryError(f"{node.text!r} searches the text of events, which an aggregation has dropped", node.pos)
        return text_fn.has_all(F.col("search_tokens"), node.text)

    def _exists(self, node: n.Exists) -> Column:
        return self.column(node.field, node.pos).isNotNull()

    def _unary(self, node: n.Unary) -> Column:
        if node.op == "not":
            return ~self.predicate(node.operand)
        return -self.number(node.operand)

    def number(self, node: n.Node) -> Column:
        out = self.expr(node)
        kind = self.kind(out)
        if isinstance(kind, (T.BooleanType, T.ArrayType)):
            raise QueryError("expected a number", node.pos)
        return out.cast("double")

    def _binary(self, node: n.Binary) -> Column:
        op = node.op
        if op in ("and", "or"):
            left, right = self.predicate(node.left), self.predicate(node.right)
            return left & right if op == "and" else left | right
        if op in ("+", "-", "*", "/"):
            left, right = self.number(node.left), self.number(node.right)
            return {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[op]
        if op == "%":
            left, right = (self.expr(x).cast("decimal(38,10)") for x in (node.left, node.right))
            return (left % right).cast("double")
        if op == ".":
            return F.concat(*[self.expr(x).cast("string") for x in (node.left, node.right)])
        if op == "like":
            return self.expr(node.left).cast("string").like(self._pattern(node.right))
        return self._compare(node)

    def _pattern(self, node: n.Node) -> str:
        if not isinstance(node, n.Literal) or not isinstance(node.value, str):
            raise QueryError("like needs a quoted pattern", node.pos)
        return node.value

    def _compare(self, node: n.Binary) -> Column:
        op, left, right = node.op, self.expr(node.left), node.right
        if self.is_time(node.left) or (op not in ("=", "!=") and self.is_time(right)):
            return self._apply(op, *[self._time(x) for x in (node.left, right)])
        if op in ("=", "!="):
            if isinstance(right, n.Literal) and isinstance(right.value, str) and any(c in right.value for c in "*?"):
                out = left.cast("string").ilike(text_fn.glob_to_like(right.value))
                return out if op == "=" else ~out
            return self._apply(op, *self._equal_kinds(left, self.expr(right)))
        return self._apply(op, self.number(node.left), self.number(right))

    def _time(self, node: n.Node) -> Column:
        if isinstance(node, n.Literal):
            found = times.literal(node.value, self.as_of)
        elif isinstance(node, n.Unary) and isinstance(node.operand, n.Literal):
            found = times.literal(-node.operand.value, self.as_of)
        elif isinstance(node, n.Field) and node.name.lower() == "now" and not self.scope.live(node.name):
            found = self.as_of
        else:
            return self.expr(node)
        if found is None:
            raise QueryError("expected a time: epoch seconds, now, a step such as -24h, or a timestamp", node.pos)
        return F.lit(found.isoformat(sep=" ")).cast("timestamp_ntz")

    def _equal_kinds(self, left: Column, right: Column) -> tuple[Column, Column]:
        """Text against a number compares as numbers, other differing kinds as text."""
        kinds = self.kind(left), self.kind(right)
        numeric = [isinstance(k, _NUMERIC) for k in kinds]
        if all(numeric) or kinds[0] == kinds[1] or any(isinstance(k, T.NullType) for k in kinds):
            return left, right
        if any(numeric) and any(isinstance(k, T.StringType) for k in kinds):
            return left.try_cast("double"), right.try_cast("double")
        return left.cast("string"), right.cast("string")

    @staticmethod
    def _apply(op: str, left: Column, right: Column) -> Column:
        return {
            "=": left == right,
            "!=": left != right,
            "<": left < right,
            "<=": left <= right,
            ">": left > right,
            ">=": left >= right,
        }[op]

    def _oneof(self, node: n.OneOf) -> Column:
        left = self.expr(node.operand)
        tests = [self._apply("=", *self._equal_kinds(left, self.expr(x))) for x in node.items]
        return reduce(lambda a, b: a | b, tests)

    def _call(self, node: n.Call) -> Column:
        if node.name in ("isnull", "isnotnull"):
            out = self.expr(node.args[0])
            return out.isNull() if node.name == "isnull" else out.isNotNull()
        if node.name == "if":
            return F.when(self.predicate(node.args[0]), self.expr(node.args[1])).otherwise(self.expr(node.args[2]))
        if node.name == "coalesce":
            return F.coalesce(*[self.expr(a) for a in node.args])
        if node.name in ("abs", "ceil", "floor"):
            return getattr(F, node.name)(self.number(node.args[0])).cast("double")
        if node.name == "round":
            places = node.args[1] if len(node.args) > 1 else n.Literal(node.pos, 0)
            if not isinstance(places, n.Literal) or not isinstance(places.value, int):
                raise QueryError("round takes a whole number of places", places.pos)
            return F.round(self.expr(node.args[0]).cast("decimal(38,10)"), places.value).cast("double")
        texts = [self.expr(a).cast("string") for a in node.args]
        if node.name in ("lower", "upper"):
            return getattr(F, node.name)(texts[0])
        if node.name in ("len", "length"):
            return F.length(texts[0])
        if node.name == "trim":
            return F.btrim(texts[0], *(texts[1:] or [F.lit(" ")]))
        if node.name == "replace":
            return F.replace(*texts)
        return self._substr(node, texts[0])

    def _substr(self, node: n.Call, text: Column) -> Column:
        """Places before 1 count towards the length but hold nothing."""
        start = self.expr(node.args[1]).cast("int")
        first = F.greatest(start, F.lit(1))
        if len(node.args) == 2:
            return F.substring(text, first, F.length(text))
        length = self.expr(node.args[2]).cast("int")
        return F.substring(text, first, F.greatest(F.lit(0), start + length - first))

    # -- stages ------------------------------------------------------------------------------------------------

    def run(self, query: n.Query, base: Column | None = None, limit: int | None = None) -> DataFrame:
        if base is not None:
            self.df = self.df.where(base)
        for stage in query.stages:
            getattr(self, f"_do_{type(stage).__name__.lower()}")(stage)
        if self.scope.order:
            self.df = self.df.orderBy(*self.ordering())
        out = self.df.select(*[f"`{c}`" for c in self.scope.columns])
        return out if limit is None else out.limit(limit)

    def ordering(self) -> list[Column]:
        """Nulls come last on the last key; before it ascending keys have them last, descending ones first."""
        out = []
        for i, (name, down) in enumerate(self.scope.order):
            c, last = F.col(f"`{name}`"), i == len(self.scope.order) - 1
            if not down:
                out.append(c.asc_nulls_last())
            else:
                out.append(c.desc_nulls_last() if last else c.desc_nulls_first())
        return out

    def carried(self) -> list[str]:
        return [c for c in (*CARRIED, "cim_models", "event_month") if c in self.df.columns] if self.scope.row_level else []

    def project(self, pairs: list[tuple[str, Column]]) -> None:
        kept = [c for c in self.carried() if c not in {name for name, _ in pairs}]
        self.df = self.df.select(*[c.alias(name) for name, c in pairs], *kept)

    def live_pairs(self) -> list[tuple[str, Column]]:
        return [(c, F.col(f"`{c}`")) for c in self.scope.columns]

    def _do_search(self, stage: n.Search) -> None:
        if stage.predicate is not None:
            self.df = self.df.where(self.predicate(stage.predicate))
            for part in _conjuncts(stage.predicate):
                self._prune_months(part)

    def _do_where(self, stage: n.Where) -> None:
        self._do_search(n.Search(stage.pos, stage.predicate))

    def _prune_months(self, node: n.Node) -> None:
        """A bound on event_time implies one on the month that the store is partitioned by."""
        if not (self.partitioned and self.scope.row_level and isinstance(node, n.Binary) and isinstance(node.left, n.Field)):
            return
        if self.scope.live(node.left.name) != "event_time" or node.op not in ("<", "<=", ">", ">=", "="):
            return
        month = F.date_format(F.date_trunc("month", self._time(node.right)), "yyyy-MM")
        if node.op in (">", ">=", "="):
            self.df = self.df.where(F.col("event_month") >= month)
        if node.op in ("<", "<=", "="):
            self.df = self.df.where(F.col("event_month") <= month)

    def _do_frommodel(self, stage: n.FromModel) -> None:
        if self.models is None:
            raise QueryError("no data models are loaded", stage.pos)
        model = self.models.find(stage.name)
        if model is None:
            raise QueryError(f"unknown data model {stage.name!r}; there are {', '.join(self.models.names())}", stage.pos)
        pairs = self.models.projection(model, self.df.columns)
        self.df = self.df.where(F.array_contains("cim_models", model.tag))
        names = [name for name, _ in pairs]
        self.project(pairs)
        self.scope = replace(
            self.scope, columns=tuple(names), hidden=frozenset(BASE) - set(names), model=model.name, times=frozenset({"event_time"})
        )

    def _do_eval(self, stage: n.Eval) -> None:
        self.scope.check_label(stage.name, stage.pos)
        value, names = self.expr(stage.value), list(self.scope.columns)
        timed = self.is_time(stage.value)
        pairs = [(c, value if c == stage.name else x) for c, x in self.live_pairs()]
        if stage.name not in names:
            names.append(stage.name)
            pairs.append((stage.name, value))
        scope = self.scope.with_columns(names, stage.pos)
        self.project(pairs)
        kept = self.scope.times - {stage.name}
        self.scope = replace(scope, times=kept | {stage.name} if timed else kept)

    def _do_fields(self, stage: n.Fields) -> None:
        if stage.drop:
            gone = {self.scope.need(x, stage.pos) for x in stage.names}
            pairs = [(c, x) for c, x in self.live_pairs() if c not in gone]
        else:
            pairs = []
            for x in stage.names:
                self.scope.check_label(x, stage.pos)
                pairs.append((self.scope.live(x) or x, self.column(x, stage.pos)))
        names = [c for c, _ in pairs]
        if not names:
            raise QueryError("no field would be left", stage.pos)
        scope = self.scope.with_columns(names, stage.pos)
        lost = [c for c, _ in self.scope.order if c not in names]
        if lost and self.scope.named_order:
            raise QueryError(f"the rows are sorted by {lost[0]!r}, which fields would drop", stage.pos)
        self.project(pairs)
        self.scope = replace(
            scope, order=() if lost else scope.order, times=frozenset(t for t in scope.times if t in names)
        )

    def _do_rename(self, stage: n.Rename) -> None:
        to = {}
        for old, new in stage.pairs:
            self.scope.check_label(new, stage.pos)
            live = self.scope.need(old, stage.pos)
            if live in to:
                raise QueryError(f"{old!r} is renamed twice", stage.pos)
            to[live] = new
        pairs = [(to.get(c, c), x) for c, x in self.live_pairs()]
        scope = self.scope.with_columns([c for c, _ in pairs], stage.pos)
        self.project(pairs)
        self.scope = replace(
            scope,
            times=frozenset(to.get(t, t) for t in scope.times),
            order=tuple((to.get(c, c), d) for c, d in scope.order),
        )

    def _do_sort(self, stage: n.Sort) -> None:
        order = tuple((self.scope.need(name, stage.pos), down) for name, down in stage.keys)
        self.scope = replace(self.scope, order=order, named_order=True)

    def _tied(self) -> list[Column]:
        """The order, made total by id while there is one."""
        return self.ordering() + ([F.col("id").asc_nulls_last()] if "id" in self.scope.columns else [])

    def _do_head(self, stage: n.Head) -> None:
        if self.scope.order:
            self.df = self.df.orderBy(*self._tied())
        self.df = self.df.limit(stage.count)

    def _do_dedup(self, stage: n.Dedup) -> None:
        keys = [f"`{self.scope.need(x, stage.pos)}`" for x in stage.names]
        order = self._tied()
        if not order:
            self.df = self.df.dropDuplicates([k.strip("`") for k in keys])
            return
        first = Window.partitionBy(*keys).orderBy(*order)
        self.df = self.df.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")

    def aggregate(self, agg: n.Aggregate) -> Column:
        if agg.field is None:
            return F.count(F.lit(1)).alias(agg.label)
        c = self.column(agg.field, agg.pos)
        out = {
            "count": lambda: F.count(c),
            "dc": lambda: F.count_distinct(c),
            "sum": lambda: F.sum(c.cast("double")),
            "avg": lambda: F.avg(c.cast("double")),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
        }[agg.func]()
        return out.alias(agg.label)

    def _cells(self, keys: list[tuple[str, Column]], agg: n.Aggregate) -> DataFrame:
        """Rows (_k0, ..., cell) of values() or list(): the least different values of each group, or its first ones, null
        among them. A task holds no more of a group than cell_cap for each of CELL_SALTS, however many it has."""
        names = [f"_k{i}" for i in range(len(keys))]
        rows = self.df.select(*[c.alias(k) for k, (_, c) in zip(names, keys, strict=True)], self.column(agg.field, agg.pos).alias("v"))
        rows = rows.distinct().withColumn("r", F.col("v")) if agg.func == "values" else rows.withColumn("r", F.monotonically_increasing_id())
        # a group is dealt over salts that each keep a cell's worth, of which the least are then taken
        each = Window.partitionBy(*names, "_salt").orderBy("r")
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("r"), F.lit(CELL_SALTS))).withColumn("_place", F.row_number().over(each))
        last = Window.partitionBy(*[F.col(k) for k in names] or [F.lit(1)]).orderBy("r")
        some = rows.where(F.col("_place") <= self.cell_cap).withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= self.cell_cap)
        # a struct keeps the null that a list would drop
        cell = F.transform(F.array_sort(F.collect_list(F.struct("_place", "v"))), lambda s: s["v"])
        return some.groupBy(*names).agg(cell.alias("cell"))

    def _aggregated(self, keys: list[tuple[str, Column]], aggregates: tuple[n.Aggregate, ...]) -> DataFrame:
        listed = [a for a in aggregates if a.func in ("values", "list")]
        plain = [self.aggregate(a) for a in aggregates if a not in listed]
        if not listed:
            return self.df.groupBy(*[c.alias(k) for k, c in keys]).agg(*plain)
        mine = [f"_k{i}" for i in range(len(keys))]
        out = self.df.groupBy(*[c.alias(m) for m, (_, c) in zip(mine, keys, strict=True)]).agg(*plain, F.count(F.lit(1)).alias("_rows"))
        for i, a in enumerate(listed):
            side = self._cells(keys, a).select(*[F.col(m).alias(f"_s{i}{m}") for m in mine], F.col("cell").alias(f"_c{i}"))
            if mine:
                met = reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(f"_s{i}{m}")) for m in mine])
                out = out.join(side, met)
            else:  # one row each
                out = out.join(F.broadcast(side))
        cells = {a.label: f"_c{i}" for i, a in enumerate(listed)}
        shown = [F.col(f"`{cells.get(a.label, a.label)}`").alias(a.label) for a in aggregates]
        return out.select(*[F.col(m).alias(k) for m, (k, _) in zip(mine, keys, strict=True)], *shown)

    def _grouped(self, keys: list[tuple[str, Column]], aggregates: tuple[n.Aggregate, ...], pos: int) -> None:
        names = [k for k, _ in keys] + [a.label for a in aggregates]
        scope = self.scope.with_columns(names, pos)
        timed = {k for k, c in keys if k in self.scope.times}
        for a in aggregates:
            if a.func in ("min", "max") and a.field and self.scope.live(a.field) in self.scope.times:
                timed.add(a.label)
        self.df = self._aggregated(keys, aggregates)
        self.scope = replace(scope, row_level=False, order=(), named_order=False, times=frozenset(timed), hidden=frozenset())

    def _do_stats(self, stage: n.Stats) -> None:
        keys = [(self.scope.live(b) or b, self.column(b, stage.pos)) for b in stage.by]
        self._grouped(keys, stage.aggregates, stage.pos)

    def _do_timechart(self, stage: n.Timechart) -> None:
        time = self.scope.need("_time", stage.pos)
        if time not in self.scope.times:
            raise QueryError("timechart needs the time of the events", stage.pos)
        kind = self.df.schema[time].dataType.simpleString()
        keys = [("_time", times.bucket(F.col(time), stage.span.seconds, kind))]
        if stage.by is not None:
            keys.append((self.scope.live(stage.by) or stage.by, self.column(stage.by, stage.pos)))
        self._grouped(keys, stage.aggregates, stage.pos)
        self.scope = replace(self.scope, times=self.scope.times | {"_time"}, order=(("_time", False),), named_order=False)

    def _do_bin(self, stage: n.Bin) -> None:
        live = self.scope.need(stage.field, stage.pos)
        if live not in self.scope.times:
            raise QueryError(f"bin works on times; {stage.field!r} is none", stage.pos)
        label = stage.label or live
        self.scope.check_label(label, stage.pos)
        value = times.bucket(F.col(f"`{live}`"), stage.span.seconds, self.df.schema[live].dataType.simpleString())
        pairs = [(c, value if c == label else x) for c, x in self.live_pairs()]
        if label not in self.scope.columns:
            pairs.append((label, value))
        scope = self.scope.with_columns([c for c, _ in pairs], stage.pos)
        self.project(pairs)
        self.scope = replace(scope, times=scope.times | {label})

    def _do_top(self, stage: n.Top) -> None:
        by = [(self.scope.live(b) or b, self.column(b, stage.pos)) for b in stage.by]
        name = self.scope.live(stage.field) or stage.field
        keys = [*by, (name, self.column(stage.field, stage.pos))]
        scope = self.scope.with_columns([k for k, _ in keys] + ["count", "percent"], stage.pos)
        counted = self.df.groupBy(*[c.alias(k) for k, c in keys]).agg(F.count(F.lit(1)).alias("count"))
        if by:
            total = F.sum("count").over(Window.partitionBy(*[F.col(f"`{k}`") for k, _ in by]))
            counted = counted.withColumn("_total", total)
        else:
            # the grand total is one row: a join with it keeps the groups in their tasks
            counted = counted.join(F.broadcast(counted.agg(F.sum("count").alias("_total"))))
        share = F.round(100 * F.col("count") / F.col("_total"), 2).cast("double")
        first = F.col("count").asc() if stage.rare else F.col("count").desc()
        ties = [F.col(f"`{k}`").asc_nulls_last() for k, _ in keys]
        self.df = counted.withColumn("percent", share).drop("_total").orderBy(first, *ties).limit(stage.count)
        self.scope = replace(
            scope, row_level=False, order=(("count", not stage.rare),), named_order=False, times=frozenset(), hidden=frozenset()
        )

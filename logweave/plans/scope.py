"""What a stage of a query may name: live columns, carried ones, times, the pending order, the model's vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from logweave.errors import QueryError

#: Row-level columns that every stage carries and none outputs.
CARRIED = ("raw", "search_tokens")
ALIASES = {"_time": "event_time", "_raw": "message"}
#: Columns of an event in output order.
BASE = (
    "id event_time vendor product log_type severity action src_ip dst_ip src_port dst_port protocol app user_name host_name "
    "rule_name bytes_total message"
).split()


@dataclass(frozen=True)
class Scope:
    columns: tuple[str, ...]
    times: frozenset[str] = frozenset({"event_time"})
    row_level: bool = True
    order: tuple[tuple[str, bool], ...] = ()
    named_order: bool = False
    hidden: frozenset[str] = field(default_factory=frozenset)  # base columns that a model's vocabulary replaces
    model: str | None = None

    def live(self, name: str) -> str | None:
        """The live column that a name means, after aliases."""
        if name in self.columns:
            return name
        alias = ALIASES.get(name)
        return alias if alias in self.columns else None

    def need(self, name: str, pos: int) -> str:
        found = self.live(name)
        if found is None:
            raise QueryError(f"unknown field {name!r}; there are {', '.join(self.columns)}", pos)
        return found

    def check_label(self, name: str, pos: int) -> None:
        if self.row_level and name in CARRIED:
            raise QueryError(f"{name!r} is reserved until an aggregation", pos)

    def with_columns(self, columns: list[str], pos: int, **changes) -> Scope:
        seen: set[str] = set()
        for c in columns:
            if c.lower() in seen:
                raise QueryError(f"two columns would be named {c!r}", pos)
            seen.add(c.lower())
        return replace(self, columns=tuple(columns), **changes)

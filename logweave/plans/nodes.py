"""Syntax tree of the pipe language. Every node knows its offset in the query text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    pos: int


@dataclass(frozen=True)
class Literal(Node):
    value: str | int | float | bool | None


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class Term(Node):
    """A bare word or number of a search: full text."""

    text: str


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class OneOf(Node):
    operand: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    func: str
    field: str | None
    label: str


@dataclass(frozen=True)
class Span(Node):
    seconds: int


@dataclass(frozen=True)
class Search(Node):
    predicate: Node | None


@dataclass(frozen=True)
class Where(Node):
    predicate: Node


@dataclass(frozen=True)
class Eval(Node):
    name: str
    value: Node


@dataclass(frozen=True)
class Fields(Node):
    drop: bool
    names: tuple[str, ...]


@dataclass(frozen=True)
class Rename(Node):
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Sort(Node):
    keys: tuple[tuple[str, bool], ...]  # (name, descending)


@dataclass(frozen=True)
class Head(Node):
    count: int


@dataclass(frozen=True)
class Dedup(Node):
    names: tuple[str, ...]


@dataclass(frozen=True)
class Stats(Node):
    aggregates: tuple[Aggregate, ...]
    by: tuple[str, ...]


@dataclass(frozen=True)
class Top(Node):
    count: int
    field: str
    by: tuple[str, ...]
    rare: bool


@dataclass(frozen=True)
class Bin(Node):
    span: Span
    field: str
    label: str | None


@dataclass(frozen=True)
class Timechart(Node):
    span: Span
    aggregates: tuple[Aggregate, ...]
    by: str | None


@dataclass(frozen=True)
class FromModel(Node):
    name: str


@dataclass(frozen=True)
class Query:
    stages: tuple[Node, ...]

"""Syntax tree of the graph query language."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that the language does not allow."""


@dataclass
class Node:
    var: str = ""
    kind: str = ""
    props: dict[str, str | list] = field(default_factory=dict)


@dataclass
class Hop:
    var: str = ""
    kinds: list[str] = field(default_factory=list)
    least: int = 1
    most: int = 1
    inverted: bool = False
    clamped: bool = False


@dataclass
class Pattern:
    source: Node
    hop: Hop | None = None
    target: Node | None = None


@dataclass
class Condition:
    """var.prop op value; value is a string, a list for IN, or a Ref for another column."""

    var: str
    prop: str
    op: str
    value: object = ""
    literal: str = "string"  # string, number, bool or null: how the literal was written


@dataclass
class Ref:
    var: str
    prop: str


@dataclass
class Not:
    inner: object


@dataclass
class Both:
    op: str  # AND or OR
    left: object
    right: object


@dataclass
class Item:
    var: str
    prop: str = ""
    agg: str = ""
    distinct: bool = False
    alias: str = ""

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        inner = f"{self.var}.{self.prop}" if self.prop else self.var
        if self.agg:
            return f"{self.agg}({'DISTINCT ' if self.distinct else ''}{inner})"
        return inner


@dataclass
class Query:
    pattern: Pattern
    where: object = None
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    order_by: str = ""
    descending: bool = False
    limit: int | None = None

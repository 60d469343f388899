"""From a parsed query to a DataFrame.

The plan is declarative: scans, joins, one predicate and an aggregate or projection; Catalyst splits the
predicate and pushes its parts down.  Decided here are only what it cannot know: literals typed by their
property, the two-valued logic of the language, and where a walk starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators.paths import reach_counts, reached, reversed_edges
from graphmill.plans import warnings as W
from graphmill.plans.ast import Both, Condition, Item, Node, Not, Query, Ref
from graphmill.plans.parser import parse
from graphmill.schema import EDGE_PROPERTIES, PROPERTIES, property_type

DEFAULT_ROWS, MOST_ROWS = 200, 10_000
MOST_HOPS = 10
NODE_COLUMNS = tuple(dict.fromkeys(PROPERTIES.values()))


@dataclass
class Result:
    """A lazy result and what there is to say about its query."""

    df: DataFrame
    query: Query
    warnings: list[str] = field(default_factory=list)


def _bool(text: str) -> bool | None:
    return {"1": True, "true": True, "0": False, "false": False}.get(str(text).lower())


def _float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def leaf(col: Column, kind: str, op: str, value, ignore_case: bool = False) -> Column:
    """One condition over a column; null counts as false, which a filter sees to, and NOT by `sure`.

    Conditions are plain comparisons where they can be, so that they reach the scan.
    """
    text = col if kind == "text" else col.cast("string")
    never = F.lit(False)
    if op == "IS NULL":
        return col.isNull() | (text == "") if kind == "text" else col.isNull()
    if op == "IS NOT NULL":
        return col.isNotNull() & (text != "") if kind == "text" else col.isNotNull()
    if op == "=~":
        return text.rlike(value)
    if op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
        a, b = (F.lower(text), F.lower(F.lit(value))) if ignore_case else (text, F.lit(value))
        return {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[op](a, b)
    if op == "IN":
        typed = [x for x in (_typed(kind, v) for v in value) if x is not None]
        return col.isin(typed) if typed else never
    typed = _typed(kind, value)
    if op in ("=", "<>"):
        zero = value == "" or (kind == "bool" and typed is False)
        if zero:
            none = typed if kind == "bool" and typed is not None else "" if kind == "text" else None
            if none is None:
                return col.isNull() if op == "=" else col.isNotNull()
            return col.isNull() | (col == F.lit(none)) if op == "=" else col.isNotNull() & (col != F.lit(none))
        if typed is None:
            return never if op == "=" else F.lit(True)
        return col == F.lit(typed) if op == "=" else col.isNull() | (col != F.lit(typed))
    if kind == "bool":
        col, typed = col.cast("int"), _float(value)
    if typed is None:
        return never
    lit = F.lit(typed)
    return {">": col > lit, "<": col < lit, ">=": col >= lit, "<=": col <= lit}[op]


def sure(condition: Column) -> Column:
    """A condition that is false where it is null."""
    return F.coalesce(condition, F.lit(False))


def _typed(kind: str, value):
    if kind == "text":
        return str(value)
    if kind == "bool":
        return _bool(value)
    n = _float(value)
    return int(n) if n is not None and kind == "int" and n == int(n) else n


class Engine:
    """Queries over a symbols table and an edges table of one project, or of all with project='*'."""

    def __init__(self, symbols: DataFrame, edges: DataFrame, project: str = "*", max_rows: int | None = DEFAULT_ROWS, compat: bool = False, include_fixtures: bool = True, unique_edges: bool = False) -> None:
        """include_fixtures=False leaves out nodes in fixture paths where a query shows file_path; unique_edges says that no (from, to, kind) repeats, which saves a shuffle."""
        if not project:
            raise ValueError("a project is needed; name '*' for all of them")
        own = F.lit(True) if project == "*" else F.col("project_id") == project
        self.symbols, self.edges = symbols.filter(own), edges.filter(own)
        self.max_rows = None if max_rows is None else min(max_rows, MOST_ROWS)
        self.compat, self.include_fixtures, self.unique_edges = compat, include_fixtures, unique_edges

    def query(self, text: str) -> Result:
        q = parse(text)
        said = W.static_warnings(q)
        if not self.include_fixtures and any(PROPERTIES.get(i.prop) == "file_path" for i in q.items):
            inner = Engine(self.symbols.filter(~S.is_fixture_path(F.col("file_path"))), self.edges, "*", self.max_rows, self.compat, unique_edges=self.unique_edges)
            return Result(inner._shape(q, inner._rows(q)), q, [*said, "nodes in fixture paths are left out; include_fixtures shows them"])
        return Result(self._shape(q, self._rows(q)), q, said)

    def diagnose(self, result: Result) -> list[str]:
        """Warnings that have to look at the graph: misspelt kinds and, if the result is empty, values that do not occur."""
        q = result.query
        kinds = {r[0] for r in self.symbols.select("kind").distinct().collect()}
        out = W.label_typos(q, kinds)
        if result.df.isEmpty():
            languages = {r[0] for r in self.symbols.select("language").distinct().limit(1000).collect()}
            out += W.unknown_values(q, {"kind": kinds, "language": languages})
            names = [c.value for c in W.conditions(q.where) if c.prop == "name" and c.op == "=" and isinstance(c.value, str)]
            names += [str(n.props["name"]) for n in (q.pattern.source, q.pattern.target) if n and "name" in n.props]
            if names:
                found: dict[str, set[str]] = {}
                for r in self.symbols.filter(F.col("name").isin(names)).select("name", "kind").distinct().collect():
                    found.setdefault(r[0], set()).add(r[1])
                out += W.label_mismatches(q, found)
        return out

    # -- rows: one struct column for each variable ------------------------------------------------
    def _nodes(self, n: Node, name: str) -> DataFrame:
        df = self.symbols
        if n.kind:
            df = df.filter(F.col("kind") == n.kind)
        for key, value in n.props.items():
            column = PROPERTIES.get(key)
            kind = property_type(column) if column else "text"
            typed = _typed(kind, value) if column else None
            df = df.filter(F.lit(False) if typed is None else F.col(column) == F.lit(typed))
        return df.select(F.struct(*NODE_COLUMNS).alias(name))

    def _rows(self, q: Query) -> DataFrame:
        p = q.pattern
        a = p.source.var or "__a"
        if p.hop is None:
            return self._nodes(p.source, a).filter(self._where(q.where, {a}, "", W.is_flat(q.where)))
        b = p.target.var or "__b"
        loop, b = b == a, "__loop" if b == a else b
        if (p.hop.least, p.hop.most) == (1, 1):
            rows = self._joined(q, a, b)
        else:
            rows = self._walked(q, a, b)
        if loop:
            rows = rows.filter(F.col(f"{a}.id") == F.col(f"{b}.id"))
        return rows

    def _joined(self, q: Query, a: str, b: str) -> DataFrame:
        """edges joined with both ends; repeated edges count once, with the best confidence that passes the predicate."""
        p, r = q.pattern, q.pattern.hop.var or "__r"
        e = self.edges.filter(F.col("kind").isin(p.hop.kinds)) if p.hop.kinds else self.edges
        on_edge = any(c.var == p.hop.var for c in W.conditions(q.where)) if p.hop.var else False
        if not on_edge and not self.unique_edges:
            e = e.groupBy("from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence"))
        e = e.select(F.struct("from_id", "to_id", "kind", "confidence").alias(r))
        rows = e.join(self._nodes(p.source, a), F.col(f"{r}.from_id") == F.col(f"{a}.id")).join(self._nodes(p.target, b), F.col(f"{r}.to_id") == F.col(f"{b}.id"))
        rows = rows.filter(self._where(q.where, {a, b}, p.hop.var, False))
        if on_edge and not self.unique_edges:
            best = F.max_by(r, F.struct(F.col(f"{r}.confidence"))).alias(r)
            keys = [F.col(f"{a}.id").alias("__f"), F.col(f"{b}.id").alias("__t"), F.col(f"{r}.kind").alias("__k")]
            rows = rows.groupBy(*keys).agg(best, F.first(a).alias(a), F.first(b).alias(b)).select(r, a, b)
        return rows

    def _walked(self, q: Query, a: str, b: str) -> DataFrame:
        p = q.pattern
        kinds = p.hop.kinds or ["CALLS"]
        e = self.edges.filter(F.col("kind").isin(kinds)).select("from_id", "to_id")
        most = min(p.hop.most, MOST_HOPS)
        parts = W.conjuncts(q.where)
        only = lambda v: [c for c in parts if {x.var for x in W.conditions(c)} == {v}]
        invert = W.is_flat(q.where) and self._has_equality(p.target, only(b)) and not self._has_equality(p.source, only(a))
        start, v = (p.target, b) if invert else (p.source, a)
        begin = self._nodes(start, v)
        for c in only(v):
            begin = begin.filter(self._where(c, {v}, "", False))
        begin = begin.select(F.col(f"{v}.id").alias("start"))
        counted = self._counted(q, a, b, (p.source, a) if invert else (p.target, b), reversed_edges(e) if invert else e, begin, most)
        if counted is not None:
            return counted
        pairs = reached(reversed_edges(e) if invert else e, begin, min(p.hop.least, most), most)
        f, t = ("node", "start") if invert else ("start", "node")
        target = Node(p.target.var, "" if self.compat and not invert else p.target.kind, p.target.props)
        rows = pairs.join(self._nodes(p.source, a), F.col(f) == F.col(f"{a}.id")).join(self._nodes(target, b), F.col(t) == F.col(f"{b}.id"))
        return rows.filter(self._where(q.where, {a, b}, "", False))

    def _counted(self, q: Query, a: str, b: str, end: tuple[Node, str], e: DataFrame, begin: DataFrame, most: int) -> DataFrame | None:
        """(__n): walks of a query that only counts them, by their last node, if no condition needs both ends; they are not joined with nodes one by one."""
        n, v = end
        parts = W.conjuncts(q.where)
        alone = all({x.var for x in W.conditions(c)} in ({a}, {b}) and not any(isinstance(x.value, Ref) for x in W.conditions(c)) for c in parts)
        if not alone or b == "__loop" or not all(i.agg == "COUNT" and not i.prop for i in q.items):
            return None
        # A node that is there twice counts twice, which bits do not tell of starts.
        if begin.count() != begin.distinct().count():
            return None
        nodes = self._nodes(Node(n.var, "" if self.compat and v == b else n.kind, n.props), v)
        for c in parts:
            if W.conditions(c)[0].var == v:
                nodes = nodes.filter(self._where(c, {v}, "", False))
        counts = reach_counts(e, begin, min(q.pattern.hop.least, most), most)
        return counts.join(nodes.select(F.col(f"{v}.id").alias("__id")), F.col("node") == F.col("__id")).select(F.col("n").alias("__n"))

    @staticmethod
    def _has_equality(n: Node, parts: list) -> bool:
        return bool(n.props) or any(isinstance(c, Condition) and c.op == "=" for c in parts)

    # -- predicates -------------------------------------------------------------------------------
    def _where(self, where, bound: set[str], edge: str, drop_unbound: bool) -> Column:
        if where is None:
            return F.lit(True)
        if isinstance(where, Both):
            a, b = (self._where(x, bound, edge, drop_unbound) for x in (where.left, where.right))
            return a & b if where.op == "AND" else a | b
        if drop_unbound and all(c.var not in bound for c in W.conditions(where)):
            return F.lit(True)
        if isinstance(where, Not):
            return ~sure(self._where(where.inner, bound, edge, False))
        if isinstance(where.value, Ref):
            return F.lit(True)
        col, kind = self._column(where.var, where.prop, bound, edge)
        return leaf(col, kind, where.op, where.value, self.compat)

    @staticmethod
    def _column(var: str, prop: str, bound: set[str], edge: str) -> tuple[Column, str]:
        if edge and var == edge and prop in EDGE_PROPERTIES:
            return F.col(f"{var}.{EDGE_PROPERTIES[prop]}"), property_type(prop) if prop == "confidence" else "text"
        if var in bound and prop in PROPERTIES:
            return F.col(f"{var}.{PROPERTIES[prop]}"), property_type(PROPERTIES[prop])
        return F.lit(None).cast("string"), "text"

    # -- result -----------------------------------------------------------------------------------
    def _shape(self, q: Query, rows: DataFrame) -> DataFrame:
        p = q.pattern
        nodes = {n.var for n in (p.source, p.target) if n and n.var}
        edge = p.hop.var if p.hop and (p.hop.least, p.hop.most) == (1, 1) else ""
        limit = DEFAULT_ROWS if q.limit is None else q.limit
        if self.max_rows is None:
            limit = q.limit
        else:
            limit = min(limit, self.max_rows) if q.limit is None else min(limit, MOST_ROWS)

        def value(i: Item) -> Column:
            if i.prop:
                return self._column(i.var, i.prop, nodes, edge)[0]
            if i.var in nodes:
                return F.to_json(F.col(i.var))
            return F.to_json(F.struct(F.col(f"{i.var}.kind"), F.col(f"{i.var}.confidence"))) if edge and i.var == edge else F.lit(None).cast("string")

        def agg(i: Item) -> Column:
            if i.agg == "COUNT" and not i.prop:
                return F.coalesce(F.sum("__n"), F.lit(0).cast("long")) if "__n" in rows.columns else F.count(F.lit(1))
            c = value(i)
            if i.agg == "COUNT":
                return F.countDistinct(c) if i.distinct else F.count(c)
            kind = self._column(i.var, i.prop, nodes, edge)[1]
            number = F.lit(None).cast("double") if kind == "bool" or not i.prop else c.try_cast("double")
            made = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[i.agg](number)
            return F.coalesce(made, F.lit(0.0)) if i.agg == "SUM" else made

        names = [i.name for i in q.items]
        grouping = any(i.agg for i in q.items)
        sort: list[Column] = []
        if grouping:
            keys = [value(i).alias(i.name) for i in q.items if not i.agg]
            rows = rows.groupBy(*keys).agg(*[agg(i).alias(i.name) for i in q.items if i.agg]).select(*[F.col(f"`{n}`") for n in names])
        var, _, prop = q.order_by.partition(".")
        source = {i.alias: i for i in q.items if i.alias}
        turn = (lambda c: c.desc()) if q.descending else (lambda c: c.asc())
        projected = q.order_by in names or any(f"{i.var}.{i.prop}" == q.order_by and not i.agg for i in q.items)
        if grouping:
            if q.order_by:
                shown = q.order_by if q.order_by in names else next((i.name for i in q.items if not i.agg and f"{i.var}.{i.prop}" == q.order_by), None)
                sort = [turn(F.col(f"`{shown}`"))] if shown else []
            sort += [F.col(f"`{n}`").asc() for n in names]
        elif not q.distinct:
            if q.order_by in source and q.order_by not in {f"{i.var}.{i.prop}" for i in q.items}:
                sort = [turn(value(source[q.order_by]))]
            elif prop and (var in nodes or (edge and var == edge)):
                sort = [turn(self._column(var, prop, nodes, edge)[0])]
            ends = [n for n in (p.source.var or "__a", (p.target.var or "__b") if p.target else None) if n and n in rows.columns]
            sort += [F.col(f"{n}.id").asc() for n in ends]
            if limit is not None or q.order_by:
                rows = rows.orderBy(*sort)
            rows = rows.select(*[value(i).alias(i.name) for i in q.items])
            return rows if limit is None else rows.limit(limit)
        else:
            rows = rows.select(*[value(i).alias(i.name) for i in q.items])
            if q.order_by and projected:
                shown = q.order_by if q.order_by in names else next(i.name for i in q.items if f"{i.var}.{i.prop}" == q.order_by)
                sort = [turn(F.col(f"`{shown}`"))]
            sort += [F.col(f"`{n}`").asc() for n in names]
        if q.distinct:
            rows = rows.distinct()
        if sort and (limit is not None or q.order_by):
            rows = rows.orderBy(*sort)
        return rows if limit is None else rows.limit(limit)

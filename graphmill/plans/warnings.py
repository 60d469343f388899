"""What a query says that will not do what it seems to: messages beside the result, never errors."""

from __future__ import annotations

from graphmill.plans.ast import Both, Condition, Not, Query, Ref
from graphmill.plans.parser import one_edit_apart
from graphmill.schema import EDGE_KINDS, EDGE_PROPERTIES, PROPERTIES, property_type


def conditions(where) -> list[Condition]:
    if where is None:
        return []
    if isinstance(where, Condition):
        return [where]
    if isinstance(where, Not):
        return conditions(where.inner)
    return conditions(where.left) + conditions(where.right)


def is_flat(where) -> bool:
    """A chain of conditions joined by AND, each perhaps negated."""
    if where is None or isinstance(where, Condition):
        return True
    if isinstance(where, Not):
        return isinstance(where.inner, Condition)
    return where.op == "AND" and is_flat(where.left) and is_flat(where.right)


def conjuncts(where) -> list:
    if isinstance(where, Both) and where.op == "AND":
        return conjuncts(where.left) + conjuncts(where.right)
    return [] if where is None else [where]


def _bound(q: Query) -> tuple[set[str], str]:
    p = q.pattern
    nodes = {n.var for n in (p.source, p.target) if n and n.var}
    return nodes, p.hop.var if p.hop else ""


def _uses(q: Query) -> list[tuple[str, str, str]]:
    """(variable, property, where) of everything that a query names."""
    out = [(c.var, c.prop, "WHERE") for c in conditions(q.where)]
    out += [(c.value.var, c.value.prop, "WHERE") for c in conditions(q.where) if isinstance(c.value, Ref)]
    out += [(i.var, i.prop, "RETURN") for i in q.items if i.var != "*"]
    return out


def unknown_properties(q: Query) -> list[str]:
    nodes, edge = _bound(q)
    out = []
    for var, prop, where in _uses(q):
        known = EDGE_PROPERTIES if var == edge else PROPERTIES
        if prop and var in nodes | {edge} and prop not in known:
            near = [k for k in known if one_edit_apart(k, prop)]
            out.append(f"{where}: {var}.{prop} is no property" + (f"; did you mean {near[0]}?" if near else f"; known: {', '.join(sorted(known))}"))
    for n in (q.pattern.source, q.pattern.target):
        out += [f"MATCH: {k} is no property, so nothing matches" for k in (n.props if n else {}) if k not in PROPERTIES]
    return out


def unbound_variables(q: Query) -> list[str]:
    nodes, edge = _bound(q)
    known = nodes | ({edge} if edge else set())
    return [f"{where}: {var} is not bound by MATCH" for var, prop, where in _uses(q) if var not in known and (prop or where == "WHERE")]


def column_comparisons(q: Query) -> list[str]:
    return [f"WHERE: {c.var}.{c.prop} {c.op} {c.value.var}.{c.value.prop} compares two columns and is ignored" for c in conditions(q.where) if isinstance(c.value, Ref)]


def _number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def type_mismatches(q: Query) -> list[str]:
    out = []
    for c in conditions(q.where):
        column = PROPERTIES.get(c.prop)
        if column is None or isinstance(c.value, Ref) or c.op in ("IS NULL", "IS NOT NULL"):
            continue
        kind = property_type(column)
        for v in c.value if isinstance(c.value, list) else [c.value]:
            if kind in ("int", "real") and v != "" and c.op in ("=", "<>", "<", ">", "<=", ">=", "IN") and not _number(str(v)):
                out.append(f"WHERE: {c.var}.{c.prop} is a number, {v!r} is not")
            if kind == "bool" and c.op in ("=", "<>") and str(v).lower() not in ("", "0", "1", "true", "false"):
                out.append(f"WHERE: {c.var}.{c.prop} is a boolean, {v!r} is not")
            if kind == "text" and c.op in ("<", ">", "<=", ">=") and c.literal == "number":
                out.append(f"WHERE: {c.var}.{c.prop} is text and is compared as text with {v}")
    return out


def text_aggregates(q: Query) -> list[str]:
    return [
        f"RETURN: {i.name} over a property that holds no numbers"
        for i in q.items
        if i.agg in ("SUM", "AVG", "MIN", "MAX") and i.prop in PROPERTIES and property_type(PROPERTIES[i.prop]) in ("text", "bool")
    ]


def unknown_order(q: Query) -> list[str]:
    if not q.order_by:
        return []
    nodes, edge = _bound(q)
    var, _, prop = q.order_by.partition(".")
    known = q.order_by in {i.name for i in q.items} or (var in nodes and prop in PROPERTIES) or (var == edge and prop in EDGE_PROPERTIES)
    return [] if known else [f"ORDER BY: {q.order_by} is unknown, the result is not sorted"]


def bare_properties(q: Query) -> list[str]:
    nodes, edge = _bound(q)
    return [
        f"RETURN: {i.var} is not bound by MATCH" + (f"; did you mean {min(nodes)}.{i.var}?" if i.var in PROPERTIES and nodes else "")
        for i in q.items
        if not i.prop and i.var not in nodes | {edge, "*"}
    ]


def order_without_groups(q: Query) -> list[str]:
    lone = q.items and all(i.agg for i in q.items)
    return ["ORDER BY has no effect on the one row of an aggregate without groups"] if q.order_by and lone else []


def mixed_aggregates(q: Query) -> list[str]:
    """A whole node beside an aggregate makes every node a group of its own."""
    if not any(i.agg for i in q.items):
        return []
    return [f"RETURN: {i.var} beside an aggregate groups by the whole node" for i in q.items if not i.agg and not i.prop and i.var != "*"]


def repeated_variables(q: Query) -> list[str]:
    p = q.pattern
    return [f"MATCH: {p.source.var} on both ends matches self-loops only"] if p.target and p.source.var and p.source.var == p.target.var else []


def hop_ranges(q: Query) -> list[str]:
    h, out = q.pattern.hop, []
    if h and h.inverted:
        out.append(f"MATCH: the bounds of the hop range were inverted and have been swapped to {h.least}..{h.most}")
    if h and h.clamped:
        out.append("MATCH: a path has one hop at least")
    return out


def unknown_edge_kinds(q: Query) -> list[str]:
    out = []
    for k in q.pattern.hop.kinds if q.pattern.hop else []:
        if k not in EDGE_KINDS:
            near = [x for x in EDGE_KINDS if one_edit_apart(x, k)]
            out.append(f"MATCH: {k} is no known edge kind" + (f"; did you mean {near[0]}?" if near else ""))
    return out


STATIC = (
    unknown_properties, unbound_variables, column_comparisons, type_mismatches, text_aggregates, unknown_order, bare_properties, order_without_groups, mixed_aggregates,
    repeated_variables, hop_ranges, unknown_edge_kinds,
)


def static_warnings(q: Query) -> list[str]:
    return list(dict.fromkeys(w for check in STATIC for w in check(q)))


def label_typos(q: Query, kinds: set[str]) -> list[str]:
    """Kinds of nodes that the graph does not have, though it has one that is spelt much like them."""
    out = []
    for n in (q.pattern.source, q.pattern.target):
        if n and n.kind and n.kind not in kinds:
            near = sorted(k for k in kinds if one_edit_apart(k.lower(), n.kind.lower()))
            out.append(f"MATCH: the graph has no node of kind {n.kind}" + (f"; did you mean {near[0]}?" if near else ""))
    return out


def unknown_values(q: Query, values: dict[str, set[str]]) -> list[str]:
    """Equalities with a value that an enumerated property never has; for results that are empty."""
    out = []
    for c in conditions(q.where):
        column = PROPERTIES.get(c.prop)
        if c.op == "=" and column in values and isinstance(c.value, str) and c.value and c.value not in values[column]:
            same = [v for v in values[column] if v.lower() == c.value.lower()]
            out.append(f"WHERE: no {c.prop} is {c.value!r}" + (f"; there is {same[0]!r}" if same else ""))
    return out


def label_mismatches(q: Query, kinds_of_names: dict[str, set[str]]) -> list[str]:
    """A name that the graph has, but never with the kind that the pattern asks for; for results that are empty."""
    out = []
    for n in (q.pattern.source, q.pattern.target):
        if not n or not n.kind:
            continue
        names = [str(n.props["name"])] if "name" in n.props else []
        names += [c.value for c in conditions(q.where) if c.var == n.var and c.prop == "name" and c.op == "=" and isinstance(c.value, str)]
        for name in names:
            kinds = kinds_of_names.get(name, set())
            if kinds and n.kind not in kinds:
                out.append(f"MATCH: {name!r} is a {', '.join(sorted(kinds))}, not a {n.kind}")
    return out



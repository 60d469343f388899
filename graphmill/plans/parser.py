"""Recursive-descent parser of the graph query language, with an error for everything that it leaves out."""

from __future__ import annotations

import re

from graphmill.plans.ast import Both, Condition, Hop, Item, Node, Not, Pattern, Query, QueryError, Ref
from graphmill.plans.lexer import Token, tokenize
from graphmill.schema import BOOL, PROPERTIES

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
WRITES = {"CREATE", "MERGE", "SET", "DELETE", "REMOVE", "DETACH", "DROP"}
CLAUSES = ("MATCH", "WHERE", "RETURN", "ORDER", "LIMIT")
COMPARISONS = ("=", "<>", ">", "<", ">=", "<=", "=~")
HINTS = {
    "!=": "use <> for inequality",
    "LIKE": "use CONTAINS, STARTS WITH, ENDS WITH or =~ instead of LIKE",
    "ILIKE": "use =~ with (?i) instead of ILIKE",
    "REGEXP": "use =~ instead of REGEXP",
    "RLIKE": "use =~ instead of RLIKE",
    "MATCHES": "use =~ instead of MATCHES",
    "BETWEEN": "use two comparisons joined by AND instead of BETWEEN",
    "+": "arithmetic is not supported", "-": "arithmetic is not supported", "*": "arithmetic is not supported", "/": "arithmetic is not supported", "%": "arithmetic is not supported",
    "(": "functions are not supported in WHERE",
}


def one_edit_apart(a: str, b: str) -> bool:
    """Whether one insertion, deletion or substitution, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def check_regex(pattern: str) -> None:
    """Reject patterns that do not compile or need look-around or back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise QueryError(f"bad regular expression {pattern!r}: look-around and back-references are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from e


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    # -- tokens ---------------------------------------------------------------------------------
    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", -1)

    def take(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind in ("word", "keyword") and t.value.upper() in words

    def is_op(self, *ops: str) -> bool:
        t = self.peek()
        return t.kind == "op" and t.value in ops

    def skip_word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def skip_op(self, op: str) -> bool:
        if self.is_op(op):
            self.at += 1
            return True
        return False

    def need_op(self, op: str, where: str) -> None:
        if not self.skip_op(op):
            found = self.peek().value or "the end of the query"
            raise QueryError(f"expected {op!r} {where}, found {found!r}: unbalanced delimiters?")

    def name(self, what: str) -> str:
        t = self.take()
        if t.kind not in ("word", "keyword"):
            raise QueryError(f"expected {what}, found {t.value or 'the end of the query'!r}")
        return t.value

    # -- clauses --------------------------------------------------------------------------------
    def query(self) -> Query:
        pattern, where, items, q = None, None, None, Query(Pattern(Node()))
        while self.peek().kind != "end":
            t = self.peek()
            word = t.value.upper() if t.kind in ("word", "keyword") else t.value
            if word == "MATCH":
                if pattern is not None:
                    raise QueryError("only one MATCH is supported; run two queries and join their results")
                self.take()
                pattern = self.pattern()
            elif word == "WHERE":
                if items is not None:
                    raise QueryError("WHERE after RETURN (HAVING) is not supported; filter the result instead")
                self.take()
                more = self.disjunction()
                where = more if where is None else Both("AND", where, more)
            elif word == "RETURN":
                self.take()
                q.distinct = self.skip_word("DISTINCT")
                items = self.items()
            elif word == "ORDER":
                self.take()
                if not self.skip_word("BY"):
                    raise QueryError("expected BY after ORDER")
                q.order_by = self.order_key()
                q.descending = self.is_word("DESC")
                self.skip_word("ASC", "DESC")
                if self.is_op(","):
                    raise QueryError("ORDER BY takes one key")
            elif word == "LIMIT":
                self.take()
                q.limit = self.limit()
            elif word == "WITH":
                raise QueryError("WITH is not supported")
            elif word == "OPTIONAL":
                raise QueryError("OPTIONAL MATCH is not supported")
            elif word in WRITES:
                raise QueryError(f"{word} is not supported: queries are read-only")
            elif word in ("UNION", "SKIP", "UNWIND", "CALL"):
                raise QueryError(f"{word} is not supported")
            else:
                near = [c for c in CLAUSES if one_edit_apart(word, c)]
                raise QueryError(f"unexpected {t.value!r}" + (f"; did you mean {near[0]}?" if near else ""))
        if pattern is None:
            raise QueryError("a query needs a MATCH clause")
        if items is None:
            raise QueryError("a query needs a RETURN clause")
        q.pattern, q.where, q.items = pattern, where, items
        return q

    def limit(self) -> int:
        t = self.take()
        if t.kind == "op" and t.value == "-":
            raise QueryError("LIMIT must not be negative")
        if t.kind != "number":
            raise QueryError(f"LIMIT takes a number, not {t.value!r}")
        if "." in t.value:
            raise QueryError("LIMIT takes a whole number")
        return int(t.value)

    def order_key(self) -> str:
        if self.is_word(*AGGREGATES) and self.peek(1).value == "(":
            return self.item().name
        key = self.name("a key after ORDER BY")
        if self.skip_op("."):
            key += "." + self.name("a property")
        return key

    # -- patterns -------------------------------------------------------------------------------
    def pattern(self) -> Pattern:
        p = Pattern(self.node())
        if self.is_op("<-", "<"):
            raise QueryError("inbound arrows are not supported: turn the pattern round")
        if self.is_op("-"):
            self.take()
            p.hop = self.hop() if self.is_op("[") else Hop()
            if self.is_op("-"):
                raise QueryError("an edge needs a direction: ask for -[]-> once from each end")
            self.need_op("->", "after an edge")
            p.target = self.node()
        elif self.is_op("->"):
            self.take()
            p.hop, p.target = Hop(), self.node()
        if self.is_op("-", "->", "<-"):
            raise QueryError("chained edges are not supported: use one hop, or a variable-length one")
        if self.is_op(","):
            raise QueryError("comma-separated patterns are not supported")
        return p

    def node(self) -> Node:
        self.need_op("(", "at the start of a node")
        n = Node()
        if self.peek().kind in ("word", "keyword"):
            n.var = self.take().value
        if self.skip_op(":"):
            n.kind = self.name("a kind")
        if self.skip_op("{"):
            while not self.is_op("}"):
                key = self.name("a property")
                self.need_op(":", "after a property's name")
                n.props[key] = self.literal()[0]
                if not self.skip_op(","):
                    break
            self.need_op("}", "at the end of properties")
        self.need_op(")", "at the end of a node")
        return n

    def hop(self) -> Hop:
        self.need_op("[", "at the start of an edge")
        h = Hop()
        if self.peek().kind in ("word", "keyword"):
            h.var = self.take().value
        if self.skip_op(":"):
            h.kinds.append(self.name("an edge kind").upper())
            while self.skip_op("|"):
                self.skip_op(":")
                h.kinds.append(self.name("an edge kind").upper())
        if self.peek().kind == "hops":
            self.range(h, self.take().value[1:].replace(" ", ""))
        self.need_op("]", "at the end of an edge")
        return h

    @staticmethod
    def range(h: Hop, text: str) -> None:
        """`*` is one hop, `*n` exactly n, `*m..n` a range; inverted bounds are swapped and the least is at least 1."""
        if ".." in text:
            low, high = text.split("..")
            h.least = int(low) if low else 1
            h.most = int(high) if high else max(h.least, 10)
        elif text:
            h.least = h.most = int(text)
        if h.most < h.least:
            h.least, h.most, h.inverted = h.most, h.least, True
        if h.least < 1:
            h.least, h.clamped = 1, True
        h.most = max(h.most, 1)

    # -- conditions -----------------------------------------------------------------------------
    def disjunction(self):
        left = self.conjunction()
        while self.skip_word("OR"):
            left = Both("OR", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.factor()
        while self.skip_word("AND"):
            left = Both("AND", left, self.factor())
        return left

    def factor(self):
        if self.skip_word("NOT"):
            return Not(self.factor())
        if self.skip_op("("):
            inner = self.disjunction()
            self.need_op(")", "at the end of a group")
            return inner
        return self.condition()

    def literal(self) -> tuple[str, str]:
        """A literal in the language's common form: booleans as 1 and 0, null as the empty string."""
        t = self.take()
        if t.kind == "op" and t.value == "-" and self.peek().kind == "number":
            return "-" + self.take().value, "number"
        if t.kind in ("string", "number"):
            return t.value, t.kind
        word = t.value.upper()
        if word in ("TRUE", "FALSE"):
            return ("1" if word == "TRUE" else "0"), "bool"
        if word == "NULL":
            return "", "null"
        if t.kind in ("word", "keyword"):
            return t.value, "word"
        raise QueryError(f"expected a value, found {t.value or 'the end of the query'!r}")

    def condition(self):
        var = self.name("a condition")
        if self.is_op("("):
            raise QueryError(f"{var}(...): " + HINTS["("])
        if not self.skip_op("."):
            raise QueryError(f"expected a property of {var!r}, as in {var}.name")
        prop = self.name("a property")
        t = self.peek()
        word = t.value.upper()
        if t.kind == "op" and t.value in COMPARISONS:
            self.take()
            if self.peek().kind in ("word", "keyword") and self.peek(1).value == "." and self.peek(2).kind in ("word", "keyword"):
                other = Ref(self.take().value, "")
                self.take()
                other.prop = self.take().value
                return Condition(var, prop, t.value, other, "ref")
            value, literal = self.literal()
            if t.value == "=~":
                check_regex(value)
            if self.is_op("+", "-", "*", "/", "%"):
                raise QueryError(HINTS[self.peek().value])
            return Condition(var, prop, t.value, value, literal)
        if word == "CONTAINS":
            self.take()
            return Condition(var, prop, "CONTAINS", *self.literal())
        if word in ("STARTS", "ENDS"):
            self.take()
            if not self.skip_word("WITH"):
                raise QueryError(f"expected WITH after {word}")
            return Condition(var, prop, f"{word} WITH", *self.literal())
        if word == "IS":
            self.take()
            no = self.skip_word("NOT")
            if not self.skip_word("NULL"):
                raise QueryError("expected NULL after IS")
            return Condition(var, prop, "IS NOT NULL" if no else "IS NULL")
        if word == "NOT" and self.is_word("IN", ahead=1):
            self.take()
            return Not(self.in_list(var, prop))
        if word == "IN":
            return self.in_list(var, prop)
        if t.kind in ("op", "word") and word in HINTS:
            raise QueryError(HINTS[word])
        if PROPERTIES.get(prop) in BOOL:
            return Condition(var, prop, "=", "1", "bool")
        raise QueryError(f"expected an operator after {var}.{prop}; only boolean properties stand alone")

    def in_list(self, var: str, prop: str) -> Condition:
        self.take()
        if self.is_op("("):
            raise QueryError("IN takes a list in square brackets")
        self.need_op("[", "after IN")
        values = []
        while not self.is_op("]"):
            values.append(self.literal()[0])
            if not self.skip_op(","):
                break
        self.need_op("]", "at the end of a list")
        if not values:
            raise QueryError("IN takes at least one value")
        return Condition(var, prop, "IN", values, "list")

    # -- results --------------------------------------------------------------------------------
    def items(self) -> list[Item]:
        out = [self.item()]
        while self.skip_op(","):
            out.append(self.item())
        return out

    def item(self) -> Item:
        if self.is_op("*"):
            raise QueryError("RETURN * is not supported: name what to return")
        word = self.name("something to return")
        if self.is_op("("):
            agg = word.upper()
            if agg not in AGGREGATES:
                raise QueryError(f"unknown function {word!r}")
            self.take()
            distinct = self.skip_word("DISTINCT")
            if distinct and agg != "COUNT":
                raise QueryError(f"DISTINCT is only supported in COUNT, not in {agg}")
            if self.skip_op("*"):
                if distinct:
                    raise QueryError("COUNT(DISTINCT *) is not supported: name a property")
                if agg != "COUNT":
                    raise QueryError(f"{agg}(*) is not supported: name a property")
                out = Item("*", agg=agg)
            else:
                var = self.name("a variable")
                prop = self.name("a property") if self.skip_op(".") else ""
                if distinct and not prop:
                    raise QueryError(f"COUNT(DISTINCT {var}) is not supported: name a property")
                out = Item(var, prop, agg, distinct)
            self.need_op(")", f"after {agg}")
        else:
            out = Item(word, self.name("a property") if self.skip_op(".") else "")
        if self.skip_word("AS"):
            out.alias = self.name("an alias")
        return out


def parse(text: str) -> Query:
    return Parser(text).query()

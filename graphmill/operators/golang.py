"""Go sources to rows of symbols, fields, methods of interfaces and references, by a scanner and a descent over declarations.

Names are bare: `Type.Method`, not `package.Type.Method`.  A file that breaks off, or holds what is no Go, gives what
was read up to there and what follows the next declaration at the start of a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from graphmill.operators.extract import Text, edge, register

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>`[^`]*`?|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)"
    r"|(?P<sign>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|[:=!<>+\-*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:~])|(?P<line>\n)",
    re.DOTALL,
)
# The language's keywords, its predeclared names, after which tokens a line ends a statement, and the marks of rationale.
KEYWORDS = frozenset((
    "break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface",
    "map", "package", "range", "return", "select", "struct", "switch", "type", "var",
))
PREDECLARED = frozenset((
    "any", "bool", "byte", "comparable", "complex64", "complex128", "error", "float32", "float64", "int", "int8", "int16", "int32", "int64", "rune",
    "string", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "true", "false", "iota", "nil", "append", "cap", "clear", "close", "complex",
    "copy", "delete", "imag", "len", "make", "max", "min", "new", "panic", "print", "println", "real", "recover", "_",
))
ENDING = frozenset({"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"})
RATIONALE = re.compile(r"^(NOTE|HACK|WHY|FIXME|XXX|TODO|BUG)\b:?\s*(.*)$", re.IGNORECASE)
ASSIGN = frozenset({"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=", "++", "--"})
CLOSING = {"(": ")", "[": "]", "{": "}"}
READ_CONFIDENCE, CALL_CONFIDENCE, NAME_LENGTH = 0.5, 0.7, 72


class Source:
    """Tokens of a file, with the semicolons that line ends stand for, and its comments."""

    def __init__(self, text: str) -> None:
        self.tokens: list[str] = []
        self.kinds: list[str] = []
        self.at: list[tuple[int, int]] = []
        self.comments: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text):
            kind, word = m.lastgroup, m[0]
            if kind == "comment":
                self.comments.append(m.span())
            if kind == "line" or kind == "comment" and "\n" in word:
                if self.tokens and (self.kinds[-1] in ("text", "number") or self.kinds[-1] == "name" and self.tokens[-1] not in KEYWORDS or self.tokens[-1] in ENDING):
                    self._add("sign", ";", m.start(), m.start())
            elif kind != "comment":
                self._add(kind, word, *m.span())
        for _ in range(4):  # so that looking ahead stays inside
            self._add("sign", ";", len(text), len(text))
        self.partner = self._partners()

    def _add(self, kind: str, word: str, start: int, end: int) -> None:
        self.tokens.append(word)
        self.kinds.append(kind)
        self.at.append((start, end))

    def _partners(self) -> dict[int, int]:
        """Where each bracket closes; those left open close at the end."""
        out, open_ = {}, []
        for i, (t, kind) in enumerate(zip(self.tokens, self.kinds, strict=True)):
            if kind == "sign" and t in CLOSING:
                open_.append(i)
            elif kind == "sign" and t in CLOSING.values():
                while open_ and CLOSING[self.tokens[open_[-1]]] != t:
                    out[open_.pop()] = i
                if open_:
                    out[open_.pop()] = i
        return out | dict.fromkeys(open_, len(self.tokens) - 4)

    def is_name(self, i: int) -> bool:
        return self.kinds[i] == "name" and self.tokens[i] not in KEYWORDS

    def type_end(self, i: int) -> int:
        """The place after the type that begins at i, i itself if none does."""
        t = self.tokens[i]
        if t in ("*", "chan", "...", "~"):
            return self.type_end(i + 1 + (t == "chan" and self.tokens[i + 1] == "<-"))
        if t == "<-":
            return self.type_end(i + 2)
        if t == "map":
            return self.type_end(self.partner.get(i + 1, i) + 1)
        if t == "[":
            return self.type_end(self.partner[i] + 1)
        if t == "(":
            return self.partner[i] + 1
        if t in ("struct", "interface"):
            return self.partner.get(i + 1, i) + 1
        if t == "func":
            return self.result_end(self.partner.get(i + 1, i) + 1)
        if not self.is_name(i):
            return i
        if self.tokens[i + 1] == "." and self.is_name(i + 2):
            i += 2
        return self.partner[i + 1] + 1 if self.tokens[i + 1] == "[" and self.tokens[i + 2] != "]" else i + 1

    def result_end(self, i: int) -> int:
        """The place after what a function returns, which may be nothing."""
        return i if self.tokens[i] in ("{", ";", ",", ")", "}", "=") else self.type_end(i)

    def written(self, i: int, end: int) -> str:
        """A type as text: no blanks but after words that need one."""
        out = ""
        for k in range(i, end):
            out += (" " if out and self.kinds[k] == "name" and (out[-1].isalnum() or out[-1] in "_)}") else "") + ("" if self.tokens[k] == ";" else self.tokens[k])
        return out

    def parts(self, i: int, end: int, sign: str) -> Iterator[tuple[int, int]]:
        """Stretches between i and end that a sign outside of brackets parts; empty ones are left out."""
        begin = k = i
        while k < end:
            if self.tokens[k] == sign and self.kinds[k] == "sign":
                if k > begin:
                    yield begin, k
                begin = k + 1
            k = self.partner.get(k, k) + 1
        if end > begin:
            yield begin, end

    def named(self, i: int, end: int) -> list[tuple[str, str]]:
        """(name, type) of parameters between brackets; unnamed ones have no name."""
        entries = list(self.parts(i, end, ","))
        with_names = any(self.is_name(a) and a + 1 < b and self.type_end(a) != b and self.tokens[a + 1] != "." for a, b in entries)
        out, held = [], ""
        for a, b in reversed(entries):
            if not with_names:
                out.append(("", self.written(a, b)))
            else:
                held = self.written(a + 1, b) if b > a + 1 else held
                out.append((self.tokens[a], held))
        return out[::-1]

    def last_name(self, i: int, end: int) -> str:
        """What an embedded type is called: its name without package, star and type arguments."""
        for k in range(i, end):
            if self.is_name(k) and self.tokens[k + 1] != ".":
                return self.tokens[k]
        return ""

    def fields(self, i: int) -> Iterator[tuple[str, str]]:
        """(field, type) of the struct whose brace opens at i; embedded ones by their type's name."""
        for a, b in self.parts(i + 1, self.partner[i], ";"):
            end = b - (self.kinds[b - 1] == "text")  # a tag
            if end <= a:
                continue
            if self.tokens[a] == "*" or end == a + 1 or self.tokens[a + 1] == "." or self.tokens[a + 1] == "[" and self.partner[a + 1] + 1 == end:
                if name := self.last_name(a, end):
                    yield name, self.written(a, end)
                continue
            names = [self.tokens[a]]
            while self.tokens[a + 1] == "," and a + 2 < end:
                a += 2
                names.append(self.tokens[a])
            yield from ((n, self.written(a + 1, end)) for n in names if n != "_" and n[0] != "(")

    def methods(self, i: int) -> list[str]:
        """Methods that the interface whose brace opens at i declares itself."""
        return [self.tokens[a] for a, b in self.parts(i + 1, self.partner[i], ";") if b > a + 1 and self.is_name(a) and self.tokens[a + 1] == "(" and self.tokens[a] != "_"]

    def value_type(self, i: int) -> str | None:
        """The type that an expression plainly has: T{}, &T{}, new(T)."""
        star = "*" if self.tokens[i] == "&" else ""
        i += bool(star)
        if self.tokens[i] == "new" and self.tokens[i + 1] == "(":
            return "*" + self.written(i + 2, self.partner[i + 1])
        if self.is_name(i):
            end = self.type_end(i)
            if self.tokens[end] == "{":
                return star + self.written(i, end)
        return None


def base_type(text: str) -> str:
    return re.sub(r"^[*&]+|\[.*$", "", text)


def _locals(s: Source, begin: int, end: int, held: dict[str, str]) -> dict[str, str]:
    """Names that a body declares, with their types where they are plain: by :=, var and const, range, and parameters of functions inside."""
    held = dict(held)
    for k in range(begin, end):
        t = s.tokens[k]
        if t == ":=":
            names, a = [], k - 1
            while a >= begin and s.is_name(a):
                names.append(s.tokens[a])
                if s.tokens[a - 1] != ",":
                    break
                a -= 2
            kind = s.value_type(k + 1) if len(names) == 1 else None
            held |= {n: held.get(n) or kind or "" for n in names}
        elif t in ("var", "const") and s.kinds[k] == "name":
            for a, b in s.parts(k + 2, s.partner[k + 1], ";") if s.tokens[k + 1] == "(" else [(k + 1, next((x for x in range(k, end) if s.tokens[x] == ";"), end))]:
                held |= {n: kind for n, kind, _, _ in _values(s, a, b)}
        elif t == "func" and s.tokens[k + 1] == "(":
            held |= {n: kind for n, kind in s.named(k + 2, s.partner[k + 1]) if n}
    return held


def _values(s: Source, a: int, b: int) -> list[tuple[str, str, int, int]]:
    """(name, type, start, end) of a specification of variables or constants."""
    names, k = [], a
    while k < b and s.is_name(k):
        names.append(k)
        if s.tokens[k + 1] != "," or k + 1 >= b:
            break
        k += 2
    if not names:
        return []
    first = names[-1] + 1
    end = s.type_end(first) if first < b and s.tokens[first] != "=" else first
    kind = s.written(first, min(end, b))
    if not kind and first < b and len(names) == 1:
        kind = s.value_type(first + 1) or ""
    return [(s.tokens[n], kind, s.at[n][0], s.at[b - 1][1]) for n in names]


def references(s: Source, begin: int, end: int, qn: str, held: dict[str, str], shared: dict[str, str], packages: set[str]) -> Iterator[dict]:
    """CALLS, READS and WRITES of a body, each once; held: its parameters and receiver, shared: the file's variables, by type."""
    own = _locals(s, begin, end, held)
    seen: set[tuple[str, str]] = set()

    def once(kind: str, name: str, confidence: float, receiver: str | None = None) -> Iterator[dict]:
        if (kind, name) not in seen:
            seen.add((kind, name))
            yield edge(kind, qn, name, confidence, receiver)

    k = begin
    while k < end:
        if not s.is_name(k) or s.tokens[k - 1] == ".":
            k += 1
            continue
        head, chain, a = s.tokens[k], [s.tokens[k]], k
        while s.tokens[k + 1] == "." and s.is_name(k + 2):
            k += 2
            chain.append(s.tokens[k])
        k += 1
        opens = s.partner[k] + 1 if s.tokens[k] == "[" and k in s.partner else k
        called = s.tokens[k] == "(" or s.tokens[opens] == "(" and opens > k and s.type_end(k + 1) == opens - 1
        if called:
            if not (len(chain) == 1 and (head in PREDECLARED or head in own)):
                yield from once("CALLS", ".".join(chain), CALL_CONFIDENCE, own.get(head) or shared.get(head) if len(chain) > 1 else None)
        if head in own or head in PREDECLARED or head in packages or len(chain) == 1 and called:
            continue
        if s.tokens[k] == ":" and s.tokens[a - 1] in ("{", ",", ";"):
            continue  # a key of a literal, or a label
        # Assigned to: the name by itself, alone or as one of several on the left.
        left = k
        while len(chain) == 1 and s.tokens[left] == "," and s.is_name(left + 1) and s.tokens[left + 2] in ("=", ","):
            left += 2
        if len(chain) == 1 and s.tokens[left] in ASSIGN and (left == k or s.tokens[left] == "="):
            yield from once("WRITES", head, READ_CONFIDENCE)
            if s.tokens[left] == "=":
                continue
        yield from once("READS", head, READ_CONFIDENCE)


def rationale(t: Text, text: str, s: Source, functions: list[tuple[int, int, str]], package: str) -> Iterator[dict]:
    """One symbol for each group of neighbouring comment lines that begins a line with a mark."""
    groups: list[list[tuple[int, int]]] = []
    for a, b in s.comments:
        joined = groups and text[groups[-1][-1][1] : a].count("\n") <= 1 and not text[groups[-1][-1][1] : a].strip()
        if joined:
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    for group in groups:
        for a, b in group:
            words = re.sub(r"^(//+|/\*+)|\*/$", "", text[a:b]).strip().lstrip("*").strip()
            if m := RATIONALE.match(words.split("\n", 1)[0]):
                body = m[2].strip()
                name = m[1].upper() + (": " + (body if len(body) <= NAME_LENGTH else body[: NAME_LENGTH - 1] + "…") if body else "")
                parent = next((q for x, y, q in functions if x <= a < y), None)
                yield t.symbol("Rationale", name, a, group[-1][1], f"{package}.rationale.L{t.line(a)}", 1.0, parent=parent)
                break


def _specs(s: Source, k: int) -> list[tuple[int, int]]:
    """The specifications of a declaration whose keyword stands at k, in brackets or alone."""
    if s.tokens[k + 1] == "(":
        return list(s.parts(k + 2, s.partner[k + 1], ";"))
    return [next(iter(s.parts(k + 1, len(s.tokens), ";")), (k + 1, k + 1))]


@register("Go")
def extract_go(path: str, text: str) -> Iterator[dict]:
    """Symbols, rows `field` and `method` of structs and interfaces, and edges of a file."""
    t, s = Text(text), Source(text)
    n, k, package = len(s.tokens) - 3, 0, ""
    packages: set[str] = set()
    shared: dict[str, str] = {}
    found: list[tuple[int, int, str, str, dict]] = []
    bodies: list[tuple[int, int, str, dict[str, str]]] = []
    while k < n - 1:
        word, start = s.tokens[k], s.at[k][0]
        if s.kinds[k] != "name" or k and s.tokens[k - 1] != ";" and text[text.rfind("\n", 0, start) + 1 : start].strip():
            k = s.partner.get(k, k) + 1
            continue
        if word == "package":
            package = s.tokens[k + 1]
        elif word == "import":
            for a, b in _specs(s, k):
                if b > a and s.kinds[b - 1] == "text":
                    name = s.tokens[b - 1].strip("`\"")
                    packages.add(s.tokens[a] if b - a > 1 else re.sub(r"/v\d+$", "", name).rsplit("/", 1)[-1])
                    yield edge("IMPORTS", path, name, 1.0)
        elif word in ("var", "const"):
            for a, b in _specs(s, k):
                for name, kind, x, y in _values(s, a, b):
                    if name != "_":
                        shared[name] = kind
                        found.append((x, y, "Variable", name, {"signature": kind or text[x:y].split("\n", 1)[0]}))
        elif word == "type":
            for a, b in _specs(s, k):
                if not s.is_name(a):
                    continue
                at = a + 1
                if s.tokens[at] == "[" and s.type_end(s.partner[at] + 1) <= b and s.partner[at] > at + 2 and s.tokens[s.partner[at] + 1] != ";":
                    at = s.partner[at] + 1  # type parameters
                at += s.tokens[at] == "="
                kind = {"struct": "Class", "interface": "Interface"}.get(s.tokens[at], "Type")
                found.append((start if s.tokens[k + 1] != "(" else s.at[a][0], s.at[b - 1][1], kind, s.tokens[a], {}))
                if kind != "Type" and s.tokens[at + 1] == "{":
                    members = s.fields(at + 1) if kind == "Class" else ((m, "") for m in s.methods(at + 1))
                    row = "field" if kind == "Class" else "method"
                    yield from ({"row": row, "name": m, "parent": s.tokens[a], "receiver_type": of or None} for m, of in dict(members).items())
        elif word == "func":
            at, held, owner = k + 1, {}, None
            if s.tokens[at] == "(" and s.is_name(s.partner[at] + 1):
                receiver = s.named(at + 1, s.partner[at])[:1] or [("", "")]
                owner = base_type(receiver[0][1]) or None
                held |= {receiver[0][0]: re.sub(r"\[.*", "", receiver[0][1])} if receiver[0][0] else {}
                at = s.partner[at] + 1
            if not s.is_name(at):
                k += 1
                continue
            name = s.tokens[at]
            at += 1
            if s.tokens[at] == "[":
                held |= {x: "" for x, _ in s.named(at + 1, s.partner[at])}
                at = s.partner[at] + 1
            after = at
            if s.tokens[at] == "(":
                held |= {x: re.sub(r"^\.\.\.", "[]", of) for x, of in s.named(at + 1, s.partner[at]) if x}
                after = s.partner[at] + 1
                if s.tokens[after] == "(":
                    held |= {x: of for x, of in s.named(after + 1, s.partner[after]) if x}
                after = s.result_end(after)
            end = s.partner[after] if s.tokens[after] == "{" else after - 1
            qn = f"{owner}.{name}" if owner else name
            found.append((start, s.at[end][1], "Method" if owner else "Function", name, {"qn": qn, "parent": owner}))
            if s.tokens[after] == "{":
                bodies.append((after + 1, end, qn, held))
            k = end + 1
            continue
        k += 1
        while k < n - 1 and s.tokens[k] != ";":
            k = s.partner.get(k, k) + 1
    for x, y, kind, name, more in found:
        yield t.symbol(kind, name, x, y, more.pop("qn", name), 1.0, **more)
    yield from rationale(t, text, s, [(x, y, m["parent"] and f"{m['parent']}.{name}" or name) for x, y, kind, name, m in found if kind in ("Method", "Function")], package)
    for begin, end, qn, held in bodies:
        yield from references(s, begin, end, qn, held, shared, packages)

"""Settings of YAML, JSON and HCL sources by their structure: each key and element by its dotted path.

YAML: block mappings and sequences by a stack of indents, block scalars, flow collections over several lines, quoted
keys, anchors, aliases and merge keys, several documents.  An alias stands for what its anchor named, so settings are
those of the same data as JSON; a file in which aliases multiply beyond MOST settings is a failure, not cut short.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from graphmill.operators.extract import Text, edge, register
from graphmill.operators.lexical import RULES, Rule, mask

MOST = 200_000


@dataclass
class Node:
    """A mapping (items: key, place, node), a sequence (items: place, node), a text, or an alias of a name."""

    kind: str
    start: int
    end: int
    value: str = ""
    items: list = field(default_factory=list)


_KEY = re.compile(r"(?:\"(?P<double>(?:\\.|[^\"\\])*)\"|'(?P<single>(?:''|[^'])*)'|(?P<plain>[^\s\-?:,\[\]{}#&*!|>'\"%@`](?:[^:#\n]|:(?=\S)|(?<=\S)#)*?|[?:-](?=\S)[^:\n]*?))[ \t]*:(?=[ \t\n]|\Z)")
_PROPERTY = re.compile(r"(?:&(?P<anchor>[^\s,\[\]{}]+)|!\S*)(?=\s|\Z)[ \t]*")
_BLOCK = re.compile(r"[|>][+-]?\d?[+-]?[ \t]*(?:#[^\n]*)?(?=\n|\Z)")


class Yaml:
    """One document stream; nodes keep where they stand."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.anchors: dict[str, Node] = {}
        #: Lines as (indent, start of what stands in them, end), blank ones, comments and directives left out.
        self.lines: list[list[int]] = []
        self.documents: list[Node] = []
        for m in re.finditer(r"^([ \t]*)([^\n]*)", text, re.MULTILINE):
            self.lines.append([len(m[1].expandtabs()), m.start(2), m.end()])
        self.i = 0

    def _skip(self) -> None:
        """To the next line that holds something."""
        while self.i < len(self.lines):
            indent, a, b = self.lines[self.i]
            rest = self.text[a:b].strip()
            if rest and rest[0] != "#" and not (rest[0] == "%" and indent == 0):
                return
            self.i += 1

    def _marker(self) -> str | None:
        indent, a, b = self.lines[self.i]
        m = re.match(r"(---|\.\.\.)(?=\s|$)", self.text[a:b]) if indent == 0 else None
        return m[1] if m else None

    def parse(self) -> list[Node]:
        begun: int | None = None  # the document that has begun without a marker after it
        while True:
            self._skip()
            if self.i >= len(self.lines):
                return self.documents
            mark = self._marker()
            if mark:
                _, a, b = self.lines[self.i]
                rest = self.text[a + 3 : b]
                begun = None
                if mark == "..." or not rest.split("#")[0].strip():
                    self.i += 1
                    continue
                self.lines[self.i] = [4, a + 3 + len(rest) - len(rest.lstrip()), b]
            elif begun == len(self.documents) - 1:
                raise ValueError(f"line {self.i + 1} goes on with no node")
            begun = len(self.documents)
            self.documents.append(self._block(0))

    def _here(self, least: int) -> bool:
        """Whether the next line that holds something belongs to a node indented by least or more."""
        self._skip()
        return self.i < len(self.lines) and self.lines[self.i][0] >= least and not self._marker()

    def _block(self, least: int) -> Node:
        """The node that begins in the current line, or an empty text."""
        if not self._here(least):
            at = self.lines[self.i - 1][2] if self.i else 0
            return Node("text", at, at)
        indent, a, b = self.lines[self.i]
        anchor, a = self._properties(a)
        if anchor is not None and a >= b:  # an anchor alone on its line
            self.i += 1
            return self._anchored(anchor, self._block(least))
        self.lines[self.i] = [indent if anchor is None else indent, a, b]
        if re.match(r"-(?=\s|$)", self.text[a:b]):
            node = self._sequence(indent)
        elif _KEY.match(self.text, a, b):
            node = self._mapping(indent)
        else:
            node = self._value(a, b, indent - 1 if indent else -1)
        return self._anchored(anchor, node)

    def _properties(self, a: int) -> tuple[str | None, int]:
        """An anchor and a tag before a node, and where the node itself begins."""
        anchor = None
        while m := _PROPERTY.match(self.text, a):
            anchor = m["anchor"] if m["anchor"] else anchor or ""
            a = m.end()
        return anchor, a

    def _anchored(self, anchor: str | None, node: Node) -> Node:
        if anchor:
            self.anchors[anchor] = node
        return node

    def _sequence(self, indent: int) -> Node:
        node = Node("sequence", self.lines[self.i][1], 0)
        while self._here(indent) and self.lines[self.i][0] == indent and re.match(r"-(?=\s|$)", self.text[(a := self.lines[self.i][1]) : self.lines[self.i][2]]):
            b = self.lines[self.i][2]
            rest = self.text[a + 1 : b]
            inner = a + 1 + len(rest) - len(rest.lstrip())
            if inner >= b or self.text[inner] == "#":
                self.i += 1
                child = self._block(indent + 1)
            else:  # what follows the dash stands as if it were a line of its own
                self.lines[self.i] = [indent + inner - a, inner, b]
                child = self._block(indent + 1)
            node.items.append((child.start if child.end > child.start else a, child))
        node.end = node.items[-1][1].end
        return node

    def _mapping(self, indent: int) -> Node:
        node = Node("mapping", self.lines[self.i][1], 0)
        while self._here(indent) and self.lines[self.i][0] == indent:
            _, a, b = self.lines[self.i]
            m = _KEY.match(self.text, a, b)
            if not m:
                break
            key = json.loads(f'"{m["double"]}"') if m["double"] is not None and "\\x" not in m["double"] else m["single"].replace("''", "'") if m["single"] is not None else (m["double"] or m["plain"] or "")
            rest = self.text[m.end() : b]
            anchor, at = self._properties(m.end() + len(rest) - len(rest.lstrip()))
            if at >= b or self.text[at] == "#":
                self.i += 1
                # A sequence may stand as far left as its key.
                same = self._here(indent) and self.lines[self.i][0] == indent and re.match(r"-(?=\s|$)", self.text[self.lines[self.i][1] : self.lines[self.i][2]])
                child = self._sequence(indent) if same else self._block(indent + 1)
                if child.end == child.start:
                    child = Node("text", m.end(), m.end())
            else:
                child = self._value(at, b, indent)
            node.items.append((key.strip(), a, self._anchored(anchor, child)))
        node.end = node.items[-1][2].end
        return node

    def _value(self, a: int, b: int, indent: int) -> Node:
        """A scalar, alias or flow collection that begins at a; lines deeper than indent go on with it."""
        text, c = self.text, self.text[a]
        if c in "{[" and not text.startswith(("{{", "{%"), a):
            node = self._flow(a)
            self._past(node.end)
            return node
        if c == "*":
            self.i += 1
            name = re.match(r"\*([^\s,\[\]{}]+)", text[a:b])
            return Node("alias", a, a + len(name[0]), name[1]) if name else Node("text", a, b, text[a:b])
        if c in "\"'":
            end = self._quoted(a)
            self._past(end)
            return Node("text", a, end, text[a:end])
        block = _BLOCK.match(text, a, b)
        self.i += 1
        end = b
        while self.i < len(self.lines):
            deeper, x, y = self.lines[self.i]
            if text[x:y].strip() and (deeper <= indent or not block and (_KEY.match(text, x, y) or text[x] == "#" or self._marker())):
                break
            end = y if text[x:y].strip() else end
            self.i += 1
        return Node("text", a, end, text[a:end])

    def _past(self, end: int) -> None:
        """On to the line after the one that holds this place."""
        while self.i < len(self.lines) and self.lines[self.i][2] < end:
            self.i += 1
        self.i += 1

    def _quoted(self, a: int) -> int:
        m = re.compile(r'"(?:\\.|[^"\\])*"' if self.text[a] == '"' else r"'(?:''|[^'])*'", re.DOTALL).match(self.text, a)
        if not m:
            raise ValueError(f"an open string at {a}")
        return m.end()

    def _blank(self, a: int) -> int:
        return re.compile(r"(?:\s|(?:(?<=\s)|^)#[^\n]*)*").match(self.text, a).end()

    def _flow(self, a: int) -> Node:
        """A flow node that begins at a: not by recursion, as they may be deeper than the stack."""
        text, open_, key = self.text, [], None
        at = a
        while True:
            at = self._blank(at)
            if at >= len(text):
                raise ValueError(f"an open collection at {a}")
            anchor, at = self._properties(at)
            c = text[at] if at < len(text) else ""
            done = None
            if c in "{[":
                open_.append((Node("mapping" if c == "{" else "sequence", at, at), key, anchor))
                key, at = None, at + 1
                continue
            if c in "}]":
                node, key, anchor = open_.pop() if open_ else (Node("", at, at), None, None)
                if node.kind != ("mapping" if c == "}" else "sequence"):
                    raise ValueError(f"an odd bracket at {at}")
                node.end = at = at + 1
                done = node
            elif c == ",":
                at += 1
                continue
            elif c in "\"'":
                end = self._quoted(at)
                done = Node("text", at, end, text[at:end])
                at = end
            else:
                end = re.compile(r"(?:[^,\[\]{}:#\n]|:(?![\s,\[\]{}]|\Z)|(?<!\s)#)*").match(text, at).end()
                if end == at:
                    raise ValueError(f"an odd sign at {at}")
                done = Node("alias" if c == "*" else "text", at, end, text[at:end].strip().lstrip("*" if c == "*" else ""))
                at = end
            self._anchored(anchor, done)
            if not open_:
                return done
            after = self._blank(at)
            top = open_[-1][0]
            if key is None and after < len(text) and text[after] == ":" and done.kind == "text":
                key, at = (_plain(done), done.start), after + 1
                if (nothing := self._blank(at)) < len(text) and text[nothing] not in ",}]":
                    continue
                done, at = Node("text", at, at), nothing
            if top.kind == "sequence":
                if key is not None:  # [a: 1] holds a mapping of one key
                    done = Node("mapping", key[1], done.end, items=[(*key, done)])
                top.items.append((done.start, done))
            else:
                top.items.append((*(key or (_plain(done), done.start)), done if key else Node("text", done.end, done.end)))
            key = None

    def expanded(self, node: Node, seen: tuple[str, ...] = ()) -> Node:
        """What an alias stands for; one that holds itself is nothing."""
        while node.kind == "alias":
            if node.value in seen or node.value not in self.anchors:
                return Node("text", node.start, node.end, "*" + node.value)
            seen, node = (*seen, node.value), self.anchors[node.value]
        return node


def _plain(node: Node) -> str:
    if node.value[:1] == '"' and len(node.value) > 1:
        return json.loads(node.value)
    return node.value[1:-1].replace("''", "'") if node.value[:1] == "'" and len(node.value) > 1 else node.value


def merged(yaml: Yaml, node: Node, depth: int = 0) -> list[tuple[str, int, Node, int | None]]:
    """(key, place, node, end) of a mapping with what `<<` brings, its own first; an end where the node stands elsewhere."""
    own: list[tuple[str, int, Node, int | None]] = [(k, at, v, None) for k, at, v in node.items if k != "<<"]
    names = {k for k, *_ in own}
    for k, at, v in node.items:
        if k == "<<" and depth < 50:
            source = yaml.expanded(v)
            for one in [yaml.expanded(x) for _, x in source.items] if source.kind == "sequence" else [source]:
                for name, _, value, _ in merged(yaml, one, depth + 1) if one.kind == "mapping" else ():
                    if name not in names:
                        names.add(name)
                        own.append((name, at, value, v.end))
    return own


def settings(yaml: Yaml, t: Text, documents: list[Node], confidence: float) -> Iterator[dict]:
    """A setting for each key and each element, in order; what an alias brings stands where the alias does."""
    count = 0
    waiting: list[tuple[str, Node, int, int | None, tuple]] = []
    for i, d in reversed(list(enumerate(documents))):
        waiting.append((f"doc{i}" if len(documents) > 1 else "", d, d.start, None, ()))
    while waiting:
        qn, node, at, end, seen = waiting.pop()
        if node.kind == "alias":
            if node.value in seen:
                continue
            seen = (*seen, node.value)
        through = end if end is not None or node.kind != "alias" else node.end
        node = yaml.expanded(node)
        if qn:
            count += 1
            if count > MOST:
                raise ValueError(f"more than {MOST} settings")
            parent, _, name = qn.rpartition(".")
            name = name.replace("\x00", ".")
            stop = max(through if through is not None else node.end, at + 1)
            yield t.symbol("Setting", name, at, min(stop, len(t.text)), qn.replace("\x00", "_"), confidence, parent=parent.replace("\x00", "_") or None)
        below = f"{qn}." if qn else ""
        if node.kind == "mapping":
            children = [(below + str(k).replace(".", "\x00"), v, a, stop) for k, a, v, stop in merged(yaml, node)]
        else:
            children = [(f"{below}{i}", v, a, None) for i, (a, v) in enumerate(node.items)]
        waiting += [(q, v, a if through is None else at, stop if through is None else through, seen) for q, v, a, stop in reversed(children)]


@register("YAML")
def extract_yaml(path: str, text: str) -> Iterator[dict]:
    """Settings, and the variables that `{{ name }}` uses."""
    yaml = Yaml(text)
    yield from settings(yaml, Text(text), yaml.parse(), 1.0)
    for name in dict.fromkeys(re.findall(r"\{\{-?\s*([A-Za-z_]\w*)", text)):
        yield edge("USES_VAR", path, name, 0.85)


@register("JSON")
def extract_json(path: str, text: str) -> Iterator[dict]:
    """JSON is YAML of one flow node, once its parser has found it to be sound."""
    json.loads(text)
    yaml = Yaml(text)
    yield from settings(yaml, Text(text), [yaml._flow(0)], 1.0)


# -- HCL ---------------------------------------------------------------------------------------------------
RULES["HCL"] = (
    Rule(r"#|//", r"(?=\n)", ""), Rule(r"/\*", r"\*/", ""), Rule(r"<<-?([A-Za-z_]\w*)(?=\n)", r"^[ \t]*\1\b", "", inner=r"(?<!\$)\$\{"), Rule('"', r'"|(?=\n)', r"\\.|\$\$\{|%%\{", inner=r"[$%]\{"),
)
# Kinds of top-level blocks, and what their names begin with in references.
BLOCKS = {
    "resource": ("Resource", "resource"), "data": ("DataSource", "data"), "module": ("Module", "module"), "variable": ("Variable", "var"), "output": ("Output", "output"), "provider": ("Provider", "provider"),
}
EXPORTED = ("Output", "Resource", "DataSource", "Module", "Setting")
_HEAD = re.compile(r"(?P<name>[A-Za-z_][\w-]*)(?P<labels>(?:[ \t]+(?:\"[^\"\n]*\"|[A-Za-z_][\w-]*))*)[ \t]*(?P<sign>\{|=(?!=)|:)")
_STEPS = re.compile(r"(?<![\w.\"-])([A-Za-z_][\w-]*)((?:\.[A-Za-z_][\w-]*|\[[^\]\n]*\](?=\.))+)")


def _label(text: str) -> str:
    return text.strip('"').replace(".", "_")


class Hcl:
    """Blocks and attributes of a body, with what its expressions refer to."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.text, self.t = path, text, Text(text)
        self.masked = mask(text, "HCL")

    def closing(self, a: int) -> int:
        depth = 0
        for m in re.finditer(r"[{}()\[\]]", self.masked[a:]):
            depth += 1 if m[0] in "{([" else -1
            if depth == 0:
                return a + m.start()
        return len(self.text)

    def body(self, a: int, b: int) -> Iterator[tuple[re.Match, int, int]]:
        """(head, start and end of what it holds) of the blocks and attributes between two places."""
        while m := re.compile(r"[A-Za-z_]").search(self.masked, a, b):
            # Heads are read from the text, as labels are strings.
            head = _HEAD.match(self.text, m.start(), b)
            if not head:
                a = self._line(m.start(), b)
            elif head["sign"] == "{":
                end = self.closing(head.end() - 1)
                yield head, head.end(), end
                a = end + 1
            else:
                end = self._line(head.end(), b)
                yield head, head.end(), end
                a = end

    def _line(self, a: int, b: int) -> int:
        """Where an expression ends: at the end of a line outside of brackets and strings."""
        depth = 0
        for m in re.finditer(r"[{}()\[\]\n]", self.masked[a:b]):
            if m[0] == "\n":
                # A string over lines, as a here document is, goes on behind its first.
                if depth <= 0 and not re.search(r"<<-?\w+$", self.text[self.text.rfind("\n", 0, a + m.start()) + 1 : a + m.start()]):
                    return a + m.start()
                if depth <= 0:
                    closing = re.compile(r"^[ \t]*" + re.search(r"(\w+)$", self.text[a : a + m.start()])[1] + r"\b[^\n]*", re.MULTILINE).search(self.text, a + m.start(), b)
                    return closing.end() if closing else b
            else:
                depth += 1 if m[0] in "{([" else -1
                if depth < 0:
                    return a + m.start()
        return b

    def refers(self, qn: str, a: int, b: int) -> Iterator[dict]:
        """References of an expression, to names as blocks have them."""
        for m in _STEPS.finditer(self.masked, a, b):
            steps = [x for x in re.sub(r"\[[^\]]*\]", "", m[2]).split(".") if x]
            root = m[1]
            if root in ("var", "local", "module"):
                name = f"{root}.{steps[0]}" if steps else None
            elif root == "data":
                name = f"data.{steps[0]}.{steps[1]}" if len(steps) > 1 else None
            else:
                name = f"resource.{root}.{steps[0]}" if len(steps) > 1 and root not in ("each", "count", "self", "path", "terraform") else None
            if name and name != qn:
                yield edge("REFERENCES", qn, name, 1.0)

    def symbol(self, kind: str, name: str, a: int, b: int, qn: str, parent: str | None = None) -> dict:
        return self.t.symbol(kind, name, a, b, qn, 1.0, parent=parent, is_exported=kind in EXPORTED)

    def nested(self, qn: str, top: str, a: int, b: int) -> Iterator[dict]:
        """Blocks in a block; of several with one name each has its number."""
        inside = list(self.body(a, b))
        names = [".".join([h["name"], *map(_label, re.findall(r"\"[^\"]*\"|[\w-]+", h["labels"]))]) for h, _, _ in inside if h["sign"] == "{"]
        met: dict[str, int] = {}
        for h, x, y in inside:
            if h["sign"] != "{":
                yield from self.refers(top, x, y)
                continue
            name = ".".join([h["name"], *map(_label, re.findall(r"\"[^\"]*\"|[\w-]+", h["labels"]))])
            n = met[name] = met.get(name, -1) + 1
            own = f"{qn}.{name}" + (f".{n}" if names.count(name) > 1 else "")
            yield self.symbol("Block", h["name"], h.start(), y + 1, own, qn)
            yield from self.nested(own, top, x, y)

    def rows(self) -> Iterator[dict]:
        for h, x, y in self.body(0, len(self.text)):
            labels = [_label(v) for v in re.findall(r"\"[^\"]*\"|[\w-]+", h["labels"])]
            if h["sign"] != "{":
                yield self.symbol("Setting", h["name"], h.start(), y, h["name"])
            elif h["name"] == "locals":
                for k, a, b in self.body(x, y):
                    yield self.symbol("Local", k["name"], k.start(), b, f"local.{k['name']}")
                    yield from self.refers(f"local.{k['name']}", a, b)
            elif h["name"] in BLOCKS and labels:
                kind, prefix = BLOCKS[h["name"]]
                qn = ".".join([prefix, *labels])
                yield self.symbol(kind, labels[-1], h.start(), y + 1, qn)
                source = next((self.text[a:b].strip() for k, a, b in self.body(x, y) if k["name"] == "source" and k["sign"] == "="), "")
                if kind == "Module" and re.fullmatch(r'"[^"$]+"', source):
                    yield edge("IMPORTS", qn, source.strip('"'), 1.0)
                yield from self.nested(qn, qn, x, y)
            else:
                qn = ".".join([h["name"], *labels])
                yield self.symbol("Block", labels[-1] if labels else h["name"], h.start(), y + 1, qn)
                yield from self.nested(qn, qn, x, y)


@register("HCL")
def extract_hcl(path: str, text: str) -> Iterator[dict]:
    """Blocks by the names that references use, locals, assignments of variable files, and references, each once."""
    seen = set()
    for r in Hcl(path, text).rows():
        key = (r["edge_kind"], r["from_qn"], r["to_name"]) if r["row"] == "edge" else None
        if key is None or key not in seen:
            seen.add(key)
            yield r

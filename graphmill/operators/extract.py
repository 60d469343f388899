"""Files to symbols and deferred edges: a registry of extractors, run over batches of files in Python workers.

An extractor takes (path, text) and yields symbols and edges as dicts.  It never fails a job: a file that it
cannot read gives one row of kind `failure`.  Python files are parsed by the standard library's parser; for
other languages of code there are declarations by pattern, in what an automaton leaves of the text, with blocks
by braces, indents or `end`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.operators.lexical import brace_block, end_block, mask
from graphmill.sources.files import language

SCHEMA = (
    "row string, file_path string, language string, kind string, name string, qualified_name string, start_byte long, end_byte long, start_line int, end_line int, "
    "signature string, docstring string, parent string, complexity int, is_exported boolean, confidence double, edge_kind string, from_qn string, to_name string, receiver_type string"
)
Extractor = Callable[[str, str], Iterator[dict]]
REGISTRY: dict[str, Extractor] = {}
# What counts as a branch.
BRANCHES = ("if ", "else ", "for ", "while ", "switch ", "case ", "catch ", "&&", "||")


def register(*languages: str):
    def add(f: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(languages, f))
        return f

    return add


class Text:
    """A source text with byte and line positions of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.plain = text.isascii()
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def byte(self, at: int) -> int:
        return at if self.plain else len(self.text[:at].encode("utf-8", "surrogatepass"))

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at)

    def symbol(self, kind: str, name: str, start: int, end: int, qn: str | None = None, confidence: float = 0.7, **more) -> dict:
        body = self.text[start:end]
        return {
            "row": "symbol", "kind": kind, "name": name, "qualified_name": qn or name, "start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.line(start),
            "end_line": self.line(max(start, end - 1)), "signature": body.split("\n", 1)[0].strip(), "complexity": 1 + sum(body.count(w) for w in BRANCHES),
            "is_exported": name[:1].isupper() and name[:1].isascii(), "confidence": confidence,
        } | more


def edge(kind: str, from_qn: str, to_name: str, confidence: float = 0.7, receiver: str | None = None) -> dict:
    return {"row": "edge", "edge_kind": kind, "from_qn": from_qn, "to_name": to_name, "confidence": confidence, "receiver_type": receiver}


# -- blocks ------------------------------------------------------------------------------------------
def indent_block(text: str, at: int) -> int:
    first = text.rfind("\n", 0, at) + 1
    indent, end = at - first, len(text)
    begun = text.find("\n", at)
    for m in re.finditer(r"^([ \t]*)\S", text[begun + 1 :], re.MULTILINE) if begun >= 0 else ():
        if len(m[1]) <= indent:
            end = begun + 1 + m.start()
            break
    return end


_CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")
# Words before a bracket that call nothing.
_NO_CALL = frozenset((
    "if", "for", "while", "switch", "return", "catch", "func", "function", "def", "class", "new", "sizeof", "await", "yield", "elif", "match", "with", "print", "assert", "not", "and", "or", "in", "is", "lambda", "do",
    "else", "case",
))


def calls_in(body: str, qn: str) -> Iterator[dict]:
    for name in dict.fromkeys(m[1] for m in _CALL.finditer(body)):
        if name not in _NO_CALL and name.rsplit(".", 1)[-1] != qn.rsplit(".", 1)[-1]:
            yield edge("CALLS", qn, name)


def by_pattern(language: str, patterns: list[tuple[str, str]], imports: str | None, block: Callable[..., int]) -> Extractor:
    """Declarations by (kind, pattern with group `name` and perhaps `owner`), methods named by their owner or the class around them.

    Patterns, blocks and calls are found in the masked text, where comments and strings are blank.
    """
    compiled = [(kind, re.compile(p, re.MULTILINE)) for kind, p in patterns]
    importing = re.compile(imports, re.MULTILINE) if imports else None
    ends = block if block is not end_block else lambda masked, at: end_block(masked, at, language)

    def run(path: str, text: str) -> Iterator[dict]:
        t, masked = Text(text), mask(text, language)
        found, named = [], set()
        for kind, p in compiled:
            for m in p.finditer(masked):
                if m.start("name") in named:
                    continue
                named.add(m.start("name"))
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                found.append((start, ends(masked, m.start("name")), kind, m["name"], m.groupdict().get("owner")))
        found.sort()
        around: list[tuple[int, str]] = []  # the types that are open, with where they end
        for start, end, kind, name, owner in found:
            while around and around[-1][0] <= start:
                around.pop()
            inside = owner or (around[-1][1] if around else None)
            if kind == "Function" and inside:
                kind = "Method"
            qn = f"{inside}.{name}" if inside else name
            if kind in ("Class", "Interface", "Type", "Enum", "Module"):
                around.append((end, name))
            yield t.symbol(kind, name, start, end, qn, parent=inside, complexity=1 + sum(masked.count(w, start, end) for w in BRANCHES))
            if kind in ("Function", "Method"):
                yield from calls_in(masked[start:end], qn)
        for m in importing.finditer(text) if importing else ():
            # What begins in a comment or string imports nothing.
            if masked[m.start() + len(m[0]) - len(m[0].lstrip())] != " ":
                yield edge("IMPORTS", path, m["name"])

    return run


def declared(languages: tuple[str, ...], patterns: list[tuple[str, str]], imports: str | None, block: Callable[..., int]) -> None:
    for name in languages:
        register(name)(by_pattern(name, patterns, imports, block))


declared(("JavaScript", "TypeScript", "JSX", "TSX"), [("Function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<name>\w+)"), ("Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("Interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("Enum", r"^\s*(?:export\s+)?enum\s+(?P<name>\w+)"), ("Function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("Method", r"^\s+(?:async\s+|static\s+|get\s+|set\s+)*(?P<name>(?!if|for|while|switch|return|catch|function)\w+)\s*\([^)]*\)\s*\{")], r"""(?:from|require\(|import)\s*['"](?P<name>[^'"]+)['"]""", brace_block)
declared(("Java", "C#", "Kotlin", "Scala", "Swift", "Dart", "PHP"), [("Class", r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|case)\s+)*(?:class|object|struct|record)\s+(?P<name>\w+)"), ("Interface", r"^\s*(?:(?:public|private|protected|internal)\s+)*(?:interface|trait|protocol)\s+(?P<name>\w+)"), ("Enum", r"^\s*(?:(?:public|private)\s+)*enum\s+(?:class\s+)?(?P<name>\w+)"), ("Function", r"^\s*(?:(?:public|private|protected|internal|static|final|override|suspend|async|virtual|abstract|open)\s+)*(?:fun|func|def|function)\s+(?P<name>\w+)"), ("Method", r"^\s+(?:(?:public|private|protected|static|final|override|async|virtual|synchronized)\s+)+[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws [\w, .]+)?\{")], r"^\s*(?:import|using|use)\s+(?:static\s+)?(?P<name>[\w.\\]+)", brace_block)
declared(("Rust", "C", "C++", "Zig"), [("Function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)"), ("Class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:typedef\s+)?(?:struct|class|union)\s+(?P<name>\w+)\s*[{:<]"), ("Interface", r"^\s*(?:pub\s+)?trait\s+(?P<name>\w+)"), ("Enum", r"^\s*(?:pub\s+)?enum\s+(?:class\s+)?(?P<name>\w+)"), ("Function", r"^(?!\s|return|else|typedef)[\w:*&<> ]+?[ *&](?:(?P<owner>\w+)::)?(?P<name>\w+)\s*\([^;{)]*\)\s*(?:const\s*)?\{")], r"^\s*(?:#include\s*[<\"]|use\s+)(?P<name>[\w./:]+)", brace_block)
declared(("Ruby", "Lua", "Elixir"), [("Class", r"^\s*class\s+(?P<name>[\w:]+)"), ("Module", r"^\s*(?:defmodule|module)\s+(?P<name>[\w.:]+)"), ("Function", r"^\s*(?:def|defp|local function|function)\s+(?:self\.)?(?P<name>[\w.:?!]+)")], r"""^\s*(?:require(?:_relative)?|import|alias)\s*\(?\s*['"]?(?P<name>[\w./:]+)""", end_block)
declared(("R",), [("Function", r"^(?P<name>[\w.]+)\s*(?:<-|=)\s*function\s*\(")], r"^\s*(?:library|require)\((?P<name>\w+)\)", brace_block)
declared(("Bash",), [("Function", r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{"), ("Variable", r"^(?:export\s+)?(?P<name>[A-Z][A-Z0-9_]*)=")], r"^\s*(?:source|\.)\s+(?P<name>\S+)", brace_block)
declared(("SQL",), [("Class", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[\"`]?(?P<name>[\w.]+)"), ("Function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure|trigger)\s+(?P<name>[\w.]+)"), ("Setting", r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>\w+)")], None, brace_block)


@register("Python")
def extract_python(path: str, text: str) -> Iterator[dict]:
    """By the standard parser; where that fails, declarations by pattern with blocks by indent."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from by_pattern("Python", [("Class", r"^\s*class\s+(?P<name>\w+)"), ("Function", r"^\s*(?:async\s+)?def\s+(?P<name>\w+)")], r"^\s*(?:from|import)\s+(?P<name>[\w.]+)", indent_block)(path, text)
        return
    t = Text(text)
    at = lambda n, end=False: t.starts[(n.end_lineno if end else n.lineno) - 1] + len(text[t.starts[(n.end_lineno if end else n.lineno) - 1] :].encode("utf-8", "surrogatepass")[: n.end_col_offset if end else n.col_offset].decode("utf-8", "ignore"))

    def dotted(n: ast.AST) -> str:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute):
            inner = dotted(n.value)
            return f"{inner}.{n.attr}" if inner else n.attr
        return ""

    def visit(n: ast.AST, scope: list[str], in_class: bool) -> Iterator[dict]:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(c, ast.ClassDef)
                kind = "Class" if is_class else "Method" if in_class else "Function"
                qn = ".".join([*scope, c.name])
                yield t.symbol(kind, c.name, at(c), at(c, True), qn, 1.0, parent=".".join(scope) or None, docstring=ast.get_docstring(c), is_exported=not c.name.startswith("_"))
                if not is_class:
                    names = dict.fromkeys(dotted(x.func) for x in ast.walk(c) if isinstance(x, ast.Call))
                    yield from (edge("CALLS", qn, x, 1.0) for x in names if x)
                yield from visit(c, [*scope, c.name], is_class)
            elif isinstance(c, ast.Import):
                yield from (edge("IMPORTS", path, a.name, 1.0) for a in c.names)
            elif isinstance(c, ast.ImportFrom):
                yield edge("IMPORTS", path, "." * c.level + (c.module or ""), 1.0)
            elif isinstance(c, ast.Assign) and not scope:
                for target in c.targets:
                    if isinstance(target, ast.Name):
                        yield t.symbol("Variable", target.id, at(c), at(c, True), target.id, 1.0)
            else:
                yield from visit(c, scope, in_class)

    yield from visit(tree, [], False)


def _settings(value, prefix: str, t: Text) -> Iterator[dict]:
    """Keys and elements of data without places: at the first place of their name."""
    children = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in children:
        qn = f"{prefix}.{str(k).replace('.', '_')}" if prefix else str(k).replace(".", "_")
        at = max(t.text.find(str(k)), 0) if isinstance(value, dict) else 0
        yield t.symbol("Setting", str(k), at, at + len(str(k)), qn, 0.95, parent=prefix or None)
        yield from _settings(v, qn, t)


@register("TOML")
def extract_toml(path: str, text: str) -> Iterator[dict]:
    import tomllib

    yield from _settings(tomllib.loads(text), "", Text(text))


@register("XML")
def extract_xml(path: str, text: str) -> Iterator[dict]:
    t = Text(text)
    if "<!ENTITY" in text:
        raise ValueError("entities are not read")

    # Not by recursion, as documents may be deeper than the stack.
    waiting = [(ElementTree.fromstring(text), "")]
    while waiting:
        e, prefix = waiting.pop()
        name = e.tag.rsplit("}", 1)[-1]
        qn = f"{prefix}.{name}" if prefix else name
        at = max(t.text.find("<" + name), 0)
        yield t.symbol("Block" if len(e) else "Setting", name, at, at + len(name) + 1, qn, 0.9, parent=prefix or None)
        waiting += [(c, qn) for c in reversed(e)]


@register("Markdown")
def extract_markdown(path: str, text: str) -> Iterator[dict]:
    """A section for each heading, what stands before the first as `preamble`, and references by links."""
    t, stack, marks = Text(text), [], []
    fenced = [(m.start(), m.end()) for m in re.finditer(r"^(```|~~~).*?^\1", text, re.MULTILINE | re.DOTALL)]
    for m in re.finditer(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*$", text, re.MULTILINE):
        if not any(a <= m.start() < b for a, b in fenced):
            marks.append((m.start(), len(m[1]), m[2]))
    if text[: marks[0][0] if marks else len(text)].strip():
        yield t.symbol("Section", "preamble", 0, marks[0][0] if marks else len(text), "preamble", 0.8)
    for i, (at, level, title) in enumerate(marks):
        end = next((a for a, n, _ in marks[i + 1 :] if n <= level), len(text))
        slug = re.sub(r"[^\w -]", "", title.lower()).strip().replace(" ", "-") or f"section-{i}"
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, slug))
        qn = ".".join(s for _, s in stack)
        yield t.symbol("Section", title, at, end, qn, 0.8, parent=".".join(s for _, s in stack[:-1]) or None)
        own = text[at : marks[i + 1][0] if i + 1 < len(marks) else len(text)]
        for target in dict.fromkeys(re.findall(r"\]\(([^)\s]+)\)", own)):
            if target.startswith("#"):
                yield edge("REFERENCES", qn, target[1:])
            elif "://" not in target and not target.startswith("mailto:"):
                yield edge("REFERENCES", qn, "doc:" + target)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.links, self.skip = [], None, [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title" or re.fullmatch("h[1-6]", tag):
            self.open = [tag, "", self.getpos()]
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.open and tag == self.open[0]:
            self.found.append(tuple(self.open))
            self.open = None

    def handle_data(self, data):
        if self.open and not self.skip:
            self.open[1] += data


@register("HTML")
def extract_html(path: str, text: str) -> Iterator[dict]:
    """The title as a document, headings as sections, and local links as imports.

    Names decode `&lt;`, `&gt;` and `&amp;` alone: other references, and those without a semicolon, such as one that was
    cut off, stay as they are written.  The parser would decode them, so it gets another character for the ampersand.
    """
    t, p = Text(text), _Page()
    mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)
    p.feed(text.replace("&", mark))
    for i, (tag, words, (line, column)) in enumerate(p.found):
        words = words.replace(mark, "&").replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
        name = re.sub(r"[\t\n\f\r ]+", " ", words).strip(" ")
        at = t.starts[line - 1] + column
        kind = "Document" if tag == "title" else "Section"
        yield t.symbol(kind, name, at, min(len(text), at + len(words) + 4), f"{tag}.{i}.{name}", 0.8)
    for link in dict.fromkeys(unescape(v.replace(mark, "&")) for v in p.links):
        if "://" not in link and not link.startswith(("#", "mailto:", "javascript:", "//")):
            yield edge("IMPORTS", path, re.sub(r"[?#].*$", "", link), 0.8)


@register("Makefile")
def extract_makefile(path: str, text: str) -> Iterator[dict]:
    t = Text(text)
    for m in re.finditer(r"^([A-Za-z0-9_./-]+)\s*:(?![=])([^\n]*)(?:\n\t[^\n]*)*", text, re.MULTILINE):
        if not m[1].startswith("."):
            yield t.symbol("Function", m[1], m.start(), m.end(), m[1], 0.9)
            yield from (edge("CALLS", m[1], x, 0.9) for x in m[2].split("#")[0].split())
    for m in re.finditer(r"^([A-Z_][A-Z0-9_]*)\s*[:?+]?=", text, re.MULTILINE):
        yield t.symbol("Variable", m[1], m.start(), m.end(), m[1], 0.9)
    for m in re.finditer(r"^-?include\s+(\S+)", text, re.MULTILINE):
        yield edge("INCLUDES", path, m[1], 0.9)


@register("Jinja")
def extract_jinja(path: str, text: str) -> Iterator[dict]:
    t = Text(text)
    for m in re.finditer(r"\{%-?\s*(block|macro)\s+(\w+)", text):
        yield t.symbol("Block" if m[1] == "block" else "Function", m[2], m.start(), m.end(), m[2], 0.85)
    for m in re.finditer(r"\{%-?\s*(?:extends|include|import|from)\s+['\"]([^'\"]+)", text):
        yield edge("INCLUDES", path, m[1], 0.85)
    for name in dict.fromkeys(re.findall(r"\{\{\s*([A-Za-z_]\w*)", text)):
        yield edge("USES_VAR", path, name)


def extract_file(path: str, lang: str, text: str) -> list[dict]:
    """All rows of one file; repeated ids get a number, and an error is a row."""
    f = REGISTRY.get(lang)
    if f is None:
        return []
    try:
        rows = list(f(path, text))
    except Exception as e:  # an extractor must not fail a job
        return [{"row": "failure", "name": type(e).__name__, "file_path": path, "language": lang}]
    seen: dict[tuple[str, str], int] = {}
    for r in rows:
        r |= {"file_path": path, "language": lang}
        if r["row"] == "symbol":
            key = (r["qualified_name"], r["kind"])
            seen[key] = seen.get(key, 0) + 1
            if seen[key] > 1:
                r["qualified_name"] += f"~{seen[key]}"
    return rows


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SCHEMA.split(", ")])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [r for path, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True) if lang and text is not None for r in extract_file(path, lang, text)]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def extract(files: DataFrame) -> DataFrame:
    """Rows of symbols, edges and failures of files (path, content, perhaps language)."""
    if "language" not in files.columns:
        files = files.withColumn("language", language(F.col("path"), F.col("content")))
    return files.select("path", "language", "content").mapInArrow(_extract, SCHEMA)


def symbols_of(rows: DataFrame, project: str) -> DataFrame:
    s = rows.filter("row = 'symbol'")
    generated = F.lit(0.0)
    return s.select(
        F.lit(project).alias("project_id"), S.symbol_id(F.col("file_path"), F.col("qualified_name"), F.col("kind")).alias("id"), "file_path", "name", "qualified_name", "kind", "language",
        "start_byte", "end_byte", "start_line", "end_line", "signature", F.lit(None).cast("string").alias("return_type"), "docstring", "parent", "complexity", "is_exported",
        S.is_test_file(F.col("file_path")).alias("is_test"), ((F.col("name") == "main") & F.col("kind").isin("Function", "Method")).alias("is_entry_point"),
        F.lit(None).cast("string").alias("file_hash"), S.composed_confidence(F.col("confidence"), F.col("kind"), F.lit(0.0), F.lit(0.0), generated).alias("extraction_confidence"), F.lit("").alias("branch"),
    )


def pending_of(rows: DataFrame, project: str) -> DataFrame:
    return rows.filter("row = 'edge'").select(
        F.lit(project).alias("project_id"), F.col("file_path").alias("from_file"), F.col("edge_kind").alias("kind"), "from_qn", "to_name", "confidence", "receiver_type", F.lit(None).cast("string").alias("base_type")
    )


def fields_of(rows: DataFrame, project: str) -> DataFrame:
    """The fields of structs and their types, as the resolver of calls takes them."""
    return rows.filter("row = 'field'").select(F.lit(project).alias("project_id"), "file_path", F.col("parent").alias("struct"), F.col("name").alias("field"), F.col("receiver_type").alias("type"))


def interface_methods_of(rows: DataFrame, project: str) -> DataFrame:
    """The methods that interfaces declare, as the search for dead nodes takes them."""
    return rows.filter("row = 'method'").select(F.lit(project).alias("project_id"), "file_path", F.col("parent").alias("interface"), F.col("name").alias("method_name"))


def skeleton(source: str) -> str:
    """A source's outline: declarations, and one line for each run of other lines."""
    keep = re.compile(r"^\s*(?:(?:export|public|private|protected|static|async|abstract|final|pub)\s+)*(?:func|def|class|interface|type|struct|enum|trait|impl|fn|function|module|package|import|from|return)\b|^\s*[})\]]+;?\s*$")
    out, hidden = [], 0
    for line in source.split("\n"):
        if keep.match(line):
            if hidden:
                out.append(f"    ... {hidden} lines")
                hidden = 0
            out.append(line)
        elif line.strip():
            hidden += 1
    return "\n".join([*out, f"    ... {hidden} lines"] if hidden else out)


def register_udtf(spark, name: str = "extract_symbols") -> None:
    """SQL's `extract_symbols(path, language, content)`: a table function over the registry."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="kind string, name string, qualified_name string, start_line int, end_line int")
    class Extracted:
        def eval(self, path: str, lang: str, content: str):
            for r in extract_file(path, lang, content):
                if r["row"] == "symbol":
                    yield r["kind"], r["name"], r["qualified_name"], r["start_line"], r["end_line"]

    spark.udtf.register(name, Extracted)


def python_source_roots(files: DataFrame) -> list[str]:
    """Folders that Python's imports start from: the root, and `src`, `lib` or `python` where they hold packages; a handful at most."""
    top = F.regexp_extract("path", r"^(src|lib|python)/[^/]+/__init__\.py$", 1)
    return [""] + sorted(r[0] for r in files.select(top.alias("r")).filter("r <> ''").distinct().limit(8).collect())


from graphmill.operators import config, golang  # noqa: E402, F401  (register themselves)

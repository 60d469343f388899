"""What of a source is code: an automaton over a table of each language's comments and strings, and where blocks end.

`mask` gives a text of the same length in which comments and strings are blank but for their line ends, so patterns,
brackets and keywords found in it are code.  Strings may hold code again (`${...}`, `#{...}`, `\\(...)`, `{...}`), and
that code strings; a stack tells where each goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A comment or string: its opening, its closing (with \\1 for what the opening's first group matched), and what it may hold."""

    open: str
    close: str
    escape: str = r"\\."
    nested: bool = False
    inner: str | None = None


def _string(mark: str, inner: str | None = None, lines: bool = False, escape: str = r"\\.", prefix: str = "") -> Rule:
    return Rule(prefix + mark, mark if lines else rf"{mark}|(?=\n)", escape, inner=inner)


SLASHES, BLOCK, NESTED = Rule(r"//", r"(?=\n)", ""), Rule(r"/\*", r"\*/", ""), Rule(r"/\*", r"\*/", "", nested=True)
HASH = Rule(r"#", r"(?=\n)", "")
DOUBLE, SINGLE = _string('"'), _string("'")
TRIPLE = Rule('"""', '"""')
CHARACTER = Rule(r"(?<![\w'])'(?=\\.[^'\n]*'|[^\\'\n]')", "'")
HEREDOC = Rule(r"<<[~-]?['\"]?([A-Za-z_]\w*)['\"]?(?=[^\n]*\n)", r"^[ \t]*\1\b", "")

# How each language writes comments and strings; earlier rules are tried first.
RULES: dict[str, tuple[Rule, ...]] = {
    **dict.fromkeys(("JavaScript", "TypeScript", "JSX", "TSX"), (SLASHES, BLOCK, DOUBLE, SINGLE, _string("`", r"\$\{", True), Rule(r"/(?![/*\s])(?=(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/)", r"/[a-z]*", r"\\.|\[(?:\\.|[^\]\n])*\]"))),
    "Java": (SLASHES, BLOCK, TRIPLE, DOUBLE, CHARACTER),
    "C#": (SLASHES, BLOCK, Rule(r"\$*(\"{3,})", r"\1", ""), Rule(r"(?:\$@|@\$)\"", '"', '""', inner=r"\{(?!\{)"), Rule(r"@\"", '"', '""'), _string('"', r"\{(?!\{)", escape=r"\\.|\{\{", prefix=r"\$"), DOUBLE, CHARACTER),
    "Kotlin": (SLASHES, NESTED, Rule('"""', '"""', "", inner=r"\$\{"), _string('"', r"\$\{"), CHARACTER),
    "Scala": (SLASHES, NESTED, Rule('(?<=[sf])"""', '"""', "", inner=r"\$\{"), Rule('"""', '"""', ""), _string('"', r"\$\{", prefix="(?<=[sf])"), DOUBLE, CHARACTER),
    "Swift": (SLASHES, NESTED, Rule(r"(#+)\"", r'"\1', ""), Rule('"""', '"""', inner=r"\\\("), _string('"', r"\\\("),),
    "Dart": (SLASHES, NESTED, Rule(r"\br('''|\"\"\"|'|\")", r"\1", ""), Rule("'''", "'''", inner=r"\$\{"), Rule('"""', '"""', inner=r"\$\{"), _string('"', r"\$\{"), _string("'", r"\$\{")),
    "PHP": (SLASHES, BLOCK, Rule(r"#(?!\[)", r"(?=\n)", ""), Rule(r"<<<['\"]?(\w+)['\"]?", r"^[ \t]*\1\b", ""), _string('"', lines=True), _string("'", lines=True)),
    "Rust": (SLASHES, NESTED, Rule(r"\bb?r(#*)\"", r'"\1', ""), _string('"', lines=True), CHARACTER),
    **dict.fromkeys(("C", "C++"), (Rule(r"//", r"(?<!\\)(?=\n)", ""), BLOCK, Rule(r"R\"([^(\s]*)\(", r'\)\1"', ""), DOUBLE, CHARACTER)),
    "Zig": (SLASHES, Rule(r"\\\\", r"(?=\n)", ""), DOUBLE, CHARACTER),
    "Ruby": (Rule(r"^=begin\b", r"^=end\b", ""), HASH, HEREDOC, _string('"', r"#\{", True), _string("'", lines=True), _string("`", r"#\{"), Rule(r"%[qwi]?\{", r"\}"), Rule(r"%[qwi]?\(", r"\)"), Rule(r"%[wi]\[", r"\]"), Rule(r"(?<![\w)\]}.] )(?<![\w)\]}.])/(?![\s=/])(?=[^\n]*/)", r"/[imxo]*|(?=\n)")),
    "Lua": (Rule(r"--\[(=*)\[", r"\]\1\]", ""), Rule("--", r"(?=\n)", ""), Rule(r"\[(=*)\[", r"\]\1\]", ""), DOUBLE, SINGLE),
    "Elixir": (HASH, Rule('"""', '"""', inner=r"#\{"), Rule("'''", "'''"), Rule(r"~[a-zA-Z]\(", r"\)"), Rule(r"~[a-zA-Z]/", "/"), _string('"', r"#\{", True), _string("'")),
    "R": (HASH, _string('"', lines=True), _string("'", lines=True)),
    "Bash": (Rule(r"(?<![^\s;(])#", r"(?=\n)", ""), HEREDOC, Rule(r"\$?'", "'", ""), _string('"', r"\$\(", True)),
    "SQL": (Rule("--", r"(?=\n)", ""), BLOCK, _string("'", lines=True, escape="''"), Rule(r"(\$\w*\$)", r"\1", "")),
}
#: After which characters and words a slash begins a regular expression.
BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw))\s*$")
BRACKETS = {"{": "}", "(": ")", "[": "]"}


class Automaton:
    """One language's rules, compiled."""

    def __init__(self, rules: tuple[Rule, ...], regex_slash: bool) -> None:
        self.rules, self.regex_slash = rules, regex_slash
        self.openings = [re.compile(r.open, re.MULTILINE) for r in rules]
        #: Where any rule may begin, or a bracket.
        self.next = re.compile("|".join([*(f"(?P<rule{k}>{r.open})" for k, r in enumerate(rules)), r"[{}()\[\]]"]), re.MULTILINE)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """The stretches that are no code, in order."""
        #: (rule, its closing and what else matters inside) of each string that is open, and the brackets of the code in it.
        stack: list[tuple[Rule, re.Pattern]] = []
        depths: list[int] = [0]
        i, n = 0, len(text)
        while i < n:
            m = self.next.search(text, i)
            if not m:
                return
            i = m.start()
            c = text[i]
            rule = self.rules[int(m.lastgroup[4:])] if m.lastgroup else None
            opened = self.openings[int(m.lastgroup[4:])].match(text, i) if rule else None
            if rule and self.regex_slash and rule is self.rules[-1] and not BEFORE_REGEX.search(text, max(0, i - 40), i):
                rule = None
            if rule is None:
                depths[-1] += (c in "{([") - (c in "})]")
                i += 1
                if stack and depths[-1] < 0:  # the code inside a string ends
                    depths.pop()
                    i = yield from self._inside(text, i - 1, i, *stack.pop(), stack, depths)
                continue
            closing = re.sub(r"\\(\d)", lambda g, o=opened: re.escape(o[int(g[1])] or ""), rule.close)
            inside = "|".join(x for x in (rule.inner and f"(?P<inner>{rule.inner})", rule.escape and f"(?P<escape>{rule.escape})", rule.nested and f"(?P<again>{rule.open})", f"(?P<close>{closing})") if x)
            # What an opening is followed by on its line, as after a here document, is code.
            begin = text.find("\n", opened.end()) if rule.close.startswith("^") and "<<" in rule.open and "\n" in text[opened.end() :] else opened.end()
            if begin > opened.end():
                yield i, opened.end()
                yield from ((a + opened.end(), b + opened.end()) for a, b in self.spans(text[opened.end() : begin]))
                i = yield from self._inside(text, begin, begin, rule, re.compile(inside, re.MULTILINE | re.DOTALL), stack, depths)
            else:
                i = yield from self._inside(text, i, begin, rule, re.compile(inside, re.MULTILINE | re.DOTALL), stack, depths)

    def _inside(self, text: str, begin: int, i: int, rule: Rule, inside: re.Pattern, stack: list, depths: list):
        """The rest of a comment or string from i, up to its end or the code that it holds; where to go on."""
        deep = 1
        while m := inside.search(text, i):
            i = max(m.end(), i + (m.end() == m.start() and m.lastgroup != "close"))
            if m.lastgroup == "again":
                deep += 1
            elif m.lastgroup == "inner":
                yield begin, m.end()
                stack.append((rule, inside))
                depths.append(0)
                return i
            elif m.lastgroup == "close":
                deep -= 1
                if not deep:
                    yield begin, m.end()
                    return i
        yield begin, len(text)
        return len(text)


_AUTOMATA: dict[str, Automaton] = {}


def mask(text: str, language: str) -> str:
    """The text with blanks for comments and strings; texts of languages without rules as they are."""
    if language not in RULES:
        return text
    if language not in _AUTOMATA:
        _AUTOMATA[language] = Automaton(RULES[language], language in ("JavaScript", "TypeScript", "JSX", "TSX"))
    out, at = [], 0
    for a, b in _AUTOMATA[language].spans(text):
        if b > at:
            a = max(a, at)
            out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
            at = b
    return "".join([*out, text[at:]])


# -- blocks of masked texts ------------------------------------------------------------------------------
_GOES_ON = re.compile(r"\s*(?:[{.?:&|+*/=<,)\]-]|(?:throws|where|extends|implements|with|noexcept|override|permits)\b|const\s*[{;])")


def brace_block(masked: str, at: int) -> int:
    """Where the declaration around `at` ends: after its braces, at a semicolon, or with a line that nothing goes on from."""
    depth = 0
    for m in re.finditer(r"[{}()\[\];\n]", masked[at:]):
        c, i = m[0], at + m.start()
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return i
            if c == "}" and depth == 0:
                return i + 1
        elif depth == 0 and c == ";":
            return i + 1
        elif depth == 0 and c == "\n" and not re.search(r"[=,(\[{&|+*/<>:.?-]\s*$", masked[max(at, i - 80) : i]) and not _GOES_ON.match(masked, i):
            return i
    return len(masked)


# Words that open a block which `end` closes, and those that do so only where a statement begins.
ENDED = {
    "Ruby": (("def", "class", "module", "begin", "case", "do"), ("if", "unless", "while", "until", "for")),
    "Lua": (("function", "if", "do", "repeat"), ()),
    "Elixir": (("do", "fn"), ()),
}


def end_block(masked: str, at: int, language: str) -> int:
    """Where the block ends whose declaration's name stands at `at`."""
    always, begins = ENDED[language]
    # In Elixir the block of a declaration opens with its `do`; one without is a line.
    depth = 0 if language == "Elixir" else 1
    loop = -1
    if re.match(r"[\w.!?]+(?:\([^()\n]*\))?\s*=(?![=~>])", masked[at:]) and language == "Ruby":
        return _line_end(masked, at)
    for m in re.finditer(r"(?<![\w.:@$])(" + "|".join([*always, *begins, "end", "until"]) + r")(?![\w?!]|:(?!:))", masked[at:]):
        word, i = m[1], at + m.start()
        if depth == 0 and masked.count("\n", at, i) and language == "Elixir" and not masked[at:i].rstrip().endswith((",", "when")):
            return _line_end(masked, at)
        first = masked.rfind("\n", 0, i) + 1
        statement = not masked[first:i].strip() or re.search(r"(?:[=(;,|&]|\b(?:then|else|do|return|and|or|not))\s*$", masked[first:i])
        if word == "end" or word == "until" and language == "Lua":
            depth -= 1
            if depth <= 0:
                return at + m.end()
        elif word in begins:
            if statement:
                depth += 1
                loop = first if word in ("while", "until", "for") else loop
        elif word in always and not (word == "do" and loop == first and language == "Ruby") and not (word == "def" and re.match(r"def\s+[\w.!?]+(?:\([^()\n]*\))?\s*=(?![=~>])", masked[i:])):
            depth += 1
    return len(masked) if depth else _line_end(masked, at)


def _line_end(masked: str, at: int) -> int:
    end = masked.find("\n", at)
    return len(masked) if end < 0 else end

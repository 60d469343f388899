"""What is code, where blocks end, and how settings are read, on sources that are made to mislead."""

import random

import pytest

from graphmill.operators import extract as X
from graphmill.operators import lexical as L

MASKS = [
    ("JavaScript", 'a = `x ${ f("}") + `n}` } y`; b = /[/}"]+/g; c = d / e; // }\n"}"', "a =       f(   ) +          ; b =          ; c = d / e;     \n   "),
    ("JavaScript", "x = a\n/b/g; return /}'/.test(y)", "x = a\n/b/g; return     .test(y)"),
    ("Rust", 'r#"}"}"#; \'}\'; fn f<\'a>(x: &\'a str) { /* a /* } */ } */ "}\n}" }', "        ;    ; fn f<'a>(x: &'a str) {                     \n   }"),
    ("C#", '$"{x["}"]} }} {{"; @"a""}"; """ } "" } """;', "   x[   ]        ;        ;               ;"),
    ("Java", 'a = """\n } " \\""" }\n"""; \'}\' + "\\"}"', "a =    \n           \n   ;     +      "),
    ("Kotlin", '"$x ${ m["}"] } }" /* /* } */ } */', "      m[   ]                      "),
    ("Swift", '"a \\(f("}")) }" #"}"# /* /* } */ */ {', "     f(   )                          {"),
    ("Dart", "'a ${f(\"}\")} }' r'\\' '''\n}'''", "     f(   )              \n    "),
    ("C++", 'R"x( } )" )x" 1\'000 \'}\' // a \\\n } \n}', "              1'000           \n   \n}"),
    ("PHP", "$a = <<<X\n } $b\n X;\n'}' # }\n#[At]", "$a =     \n     \n  ;\n       \n#[At]"),
    ("Ruby", 'x = <<~EOT + "#{y + "}"}"\n  end }\nEOT\nz = %w{a end} # end\na = b / c\n=begin\nend\n=end\n', "x =        +    y +      \n       \n   \nz =                \na = b / c\n      \n   \n    \n"),
    ("Lua", '--[==[ end ]] ]==] x = [[ end ]] -- end\n"end"', "                   x =                 \n     "),
    ("Bash", "a=${b#c}\ncat <<'EOF' | x '}'\n}\nEOF\necho \"$(f \"}\")\" # }\n", "a=${b#c}\ncat         | x    \n \n   \necho    f          \n"),
    ("SQL", "select 'it''s }' , $body$ ; $body$ -- x\n/* ; */", "select           ,                     \n       "),
    ("Elixir", 'a = """\n end #{b("end")} end\n""" <> "end" # end', "a =    \n       b(     )     \n    <>            "),
    ("R", "f <- '}' # }\n\"}\n\"", "f <-        \n  \n "),
    ("Zig", 'a = \\\\ }\n;"}" \'}\'', "a =     \n;       "),
    ("COBOL", '"}"', '"}"'),
]


@pytest.mark.parametrize("language, text, want", MASKS)
def test_masks(language, text, want):
    got = L.mask(text, language)
    assert got.split() == want.split() and got.count("\n") == want.count("\n")


@pytest.mark.parametrize("language", sorted(L.RULES))
def test_masks_keep_lengths_and_lines(language):
    rng = random.Random(language)
    parts = ['"', "'", "`", "/", "*", "\\", "{", "}", "(", ")", "[", "]", "#", "$", "\n", " ", "a", "<<X\n", "X", "--", '"""', "=begin", "r#", "${", "%w(", "@"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        masked = L.mask(text, language)
        assert len(masked) == len(text) and [i for i, c in enumerate(text) if c == "\n"] == [i for i, c in enumerate(masked) if c == "\n"]
        assert all(m in (" ", c) for c, m in zip(text, masked, strict=True))


BLOCKS = {
    "JavaScript": (
        "class A {\n  // }\n  draw() {\n    const s = `}${ `}` }`;\n    return /}/.test(s);\n  }\n  later() {\n  }\n}\nconst f = (x) => x + 1\nconst g = async (x) => {\n  return '}'\n}\nfunction h() {\n}\n",
        [("Class", "A", 1, 9), ("Method", "A.draw", 3, 6), ("Method", "A.later", 7, 8), ("Function", "f", 10, 10), ("Function", "g", 11, 13), ("Function", "h", 14, 15)],
    ),
    "Java": (
        'public class A {\n  /* class X { */\n  public int f(int x) throws E {\n    char c = \'}\';\n    return """\n      } "\n      """.length();\n  }\n  public void g() {\n  }\n}\n',
        [("Class", "A", 1, 11), ("Method", "A.f", 3, 8), ("Method", "A.g", 9, 10)],
    ),
    "Rust": (
        'pub struct S { a: i32 }\npub fn go<\'a>(x: &\'a str) {\n  let s = r#"}"#;\n  /* /* } */ } */\n}\npub trait T {\n  fn m(&self);\n}\n',
        [("Class", "S", 1, 1), ("Function", "go", 2, 5), ("Interface", "T", 6, 8), ("Method", "T.m", 7, 7)],
    ),
    "C#": (
        'public class A {\n  public string F(int x) {\n    return $"{x} }} {x["}"]}" + @"\\";\n  }\n  public void G() {\n  }\n}\n',
        [("Class", "A", 1, 7), ("Method", "A.F", 2, 4), ("Method", "A.G", 5, 6)],
    ),
    "Ruby": (
        "class A\n  # end\n  def f(x)\n    return 1 if x\n    while x do\n      y = \"end #{x ? 'end' : 1}\"\n    end\n    <<~EOT\n      end\n    EOT\n  end\n  def g = 2\n  def h\n    [1].each do |z| z.end end\n    x = if z then 1 else 2 end\n  end\nend\ndef last\nend\n",
        [("Class", "A", 1, 17), ("Method", "A.f", 3, 11), ("Method", "A.g", 12, 12), ("Method", "A.h", 13, 16), ("Function", "last", 18, 19)],
    ),
    "Lua": (
        "function f(x)\n  -- end\n  for i = 1, 2 do\n    if x then y = [[ end ]] end\n  end\n  repeat x = x + 1 until x > 2\n  local g = function() return 'end' end\nend\nlocal function h()\nend\n",
        [("Function", "f", 1, 8), ("Function", "h", 9, 10)],
    ),
    "Elixir": (
        'defmodule M do\n  def f(x) do\n    case x do\n      1 -> "end #{x}"\n    end\n  end\n  def g(x), do: x\n  defp h(x) do\n    Enum.map(x, fn y -> y end)\n  end\nend\n',
        [("Module", "M", 1, 11), ("Method", "M.f", 2, 6), ("Method", "M.g", 7, 7), ("Method", "M.h", 8, 10)],
    ),
    "Bash": ("run() {\n  echo '}' \"$(f \"}\")\" # }\n  cat <<EOF\n}\nEOF\n}\nnext() {\n  :\n}\n", [("Function", "run", 1, 6), ("Function", "next", 7, 9)]),
    "C++": ('int f(int x)\n{\n  auto s = R"(})";\n  return 1\'000;\n}\nvoid A::g() {\n  char c = \'}\';\n}\n', [("Function", "f", 1, 5), ("Method", "A.g", 6, 8)]),
}


@pytest.mark.parametrize("language", sorted(BLOCKS))
def test_blocks_end_where_they_do(language):
    text, want = BLOCKS[language]
    got = [(r["kind"], r["qualified_name"], r["start_line"], r["end_line"]) for r in X.extract_file("f", language, text) if r["row"] == "symbol" and r["kind"] != "Variable"]
    assert got == want


def test_declarations_imports_and_calls_in_text_are_none():
    text = "// import x from 'no'\nimport y from 'yes'\n/* function a() {} */\nconst s = `\nimport z from 'no'\nfunction b() {\n`\nfunction c() {\n  // d()\n  e('f()')\n}\n"
    got = X.extract_file("f", "TypeScript", text)
    assert [r["name"] for r in got if r["row"] == "symbol"] == ["c"]
    assert [(r["edge_kind"], r["to_name"]) for r in got if r["row"] == "edge"] == [("CALLS", "e"), ("IMPORTS", "yes")]


def test_repeated_declarations_are_told_apart():
    got = X.extract_file("f", "JavaScript", "function a() {\n}\nfunction a() {\n}\nclass A {\n a() {\n }\n a() {\n }\n}\n")
    assert [r["qualified_name"] for r in got if r["row"] == "symbol"] == ["a", "a~2", "A", "A.a", "A.a~2"]

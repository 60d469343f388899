"""Names of HTML pages: references and white space."""

import pytest

from graphmill.operators.extract import extract_file


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("Auf&amp", "Auf&amp"),  # cut off: text, as the SQL of html_sections has it
        ("a&lt b &gt;&amp;&lt;", "a&lt b >&<"),
        ("&amp;lt; &ampx; &copy=1 & &# &#x;", "&lt; &ampx; &copy=1 & &# &#x;"),
        ("token = &quot;1&quot; &#65;", "token = &quot;1&quot; &#65;"),
        (" a\n\tb  c ", "a b c"),
        ("a\u00a0b\u2003", "a\u00a0b\u2003"),
        ("\ue000&amp", "\ue000&amp"),
    ],
)
def test_names(raw, name):
    rows = extract_file("p", "HTML", f"<title>{raw}</title>\n<h1>{raw}</h1><a href='/x?a=1&copy=2'>l</a><a href='/y&amp;z'>l</a>")
    assert [(r["kind"], r["name"]) for r in rows if r["row"] == "symbol"] == [("Document", name), ("Section", name)]
    assert [r["to_name"] for r in rows if r["row"] == "edge"] == ["/x", "/y&z"]

"""YAML as the same data as JSON, and HCL blocks with their references."""

import json
import random

import pytest

from graphmill.operators import config as C
from graphmill.operators import extract as X


def names(language, text):
    got = X.extract_file("f", language, text)
    assert not [r for r in got if r["row"] == "failure"], (got, text)
    return [r["qualified_name"] for r in got if r["row"] == "symbol"]


def paths(value, prefix=""):
    """Keys and elements of data, by plain Python."""
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        qn = prefix + str(k).replace(".", "_")
        yield qn
        yield from paths(v, qn + ".")


def indented(value, depth=0, rng=None):
    """Data as YAML in blocks, flow collections here and there."""
    pad = "  " * depth
    if not value or not isinstance(value, (dict, list)):
        return " " + (json.dumps(value) if not isinstance(value, str) or rng.random() < 0.6 or not value.isalnum() else value) + "\n"
    if rng.random() < 0.2:
        return " " + json.dumps(value, indent=rng.choice([None, 1]) and 2 * depth + 2) + "  # flow\n"
    out = "\n"
    for k, v in value.items() if isinstance(value, dict) else enumerate(value):
        if rng.random() < 0.2:
            out += rng.choice(["\n", f"{pad}# a: comment\n", "   \n"])
        if isinstance(value, list):
            body = indented(v, depth + 1, rng)
            out += f"{pad}-" + (" " + body[1:].lstrip(" ") if isinstance(v, dict) and v and body[0] == "\n" and body[1:].lstrip(" ")[:1] not in "\n#" and rng.random() < 0.7 and not body[1:].startswith("\n") else body)
        else:
            out += pad + rng.choice([k, json.dumps(k)]) + ":" + indented(v, depth + 1, rng)
    return out


def data(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice(["x", "a b", "it's: {odd}", "# no", 1, None, True, "", "- a", "{{ v }}", "multi\nline"])
    if kind < 0.75:
        return {rng.choice(["a", "b", "key", "two words", "x-y", "a.b", "http"]) + str(i): data(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [data(rng, depth + 1) for _ in range(rng.randint(0, 4))]


def test_yaml_settings_are_those_of_the_same_data():
    rng = random.Random(9)
    for _ in range(400):
        value = {"top": data(rng), "end": data(rng)}
        text = indented(value, 0, random.Random(rng.random())) if rng.random() < 0.95 else json.dumps(value)
        assert names("YAML", text) == list(paths(value)), text
        assert names("JSON", json.dumps(value, indent=rng.choice([None, 2]))) == list(paths(value))


@pytest.mark.parametrize("text, value", [
    ("a: |\n  b: 1\n   - c\n\n  d\ne: >-\n  f: g\nh: 1\n", {"a": "", "e": "", "h": 1}),
    ("a:\n- b: 1\n  c:\n  - d\n- e\nf:\n", {"a": [{"b": 1, "c": ["d"]}, "e"], "f": None}),
    ("- - a\n  - b\n-\n  c: 1\n", [["a", "b"], {"c": 1}]),
    ("a: plain text\n  goes on\nb: 'it''s: {x'\nc: \"q\\\"}: \n  more\"\n", {"a": "", "b": "", "c": ""}),
    ("a: {b: [1, {c: d, e}], 'f': \"g}\",\n  h: {}, i: }\nj: [k: 1, l]\n", {"a": {"b": [1, {"c": "d", "e": None}], "f": "g", "h": {}, "i": None}, "j": [{"k": 1}, "l"]}),
    ("base: &b\n  x: 1\n  y: {z: 2}\nuse: *b\nlist: [*b, 3]\nmix:\n  <<: *b\n  x: own\n", {"base": {"x": 1, "y": {"z": 2}}, "use": {"x": 1, "y": {"z": 2}}, "list": [{"x": 1, "y": {"z": 2}}, 3], "mix": {"x": "own", "y": {"z": 2}}}),
    ("a: &s 1\nb: !tag\n  c: *s\nd: !!str x\n", {"a": 1, "b": {"c": 1}, "d": "x"}),
    ("url: http://x:80/y#z\ntime: 12:30\n", {"url": "", "time": ""}),
    ("image: {{ .Values.image }}\nname: \"{{ x }}\"\n", {"image": "", "name": ""}),
    ("%YAML 1.2\n---\na: 1\n...\n", {"a": 1}),
])
def test_yaml_forms(text, value):
    assert names("YAML", text) == list(paths(value))


def test_several_documents_and_places():
    assert names("YAML", "a: 1\n---\nb: 2\n--- # c\n- d\n") == ["doc0", "doc0.a", "doc1", "doc1.b", "doc2", "doc2.0"]
    rows = X.extract_file("f", "YAML", "a:\n  b: 1\n  é: {c: 2,\n    d: 3}\ne: |\n  x\n\n  y\nf: 1\n")
    got = {r["qualified_name"]: (r["start_line"], r["end_line"], r["start_byte"], r["end_byte"]) for r in rows if r["row"] == "symbol"}
    assert got["a"] == (1, 4, 0, 32) and got["a.b"][:2] == (2, 2) and got["a.é"][:2] == (3, 4) and got["a.é.d"][:2] == (4, 4) and got["e"][:2] == (5, 8) and got["f"][:2] == (9, 9)
    rows = X.extract_file("f", "JSON", '{"b": {"a": 1},\n "a": "b"}')
    assert [(r["qualified_name"], r["start_line"]) for r in rows] == [("b", 1), ("b.a", 1), ("a", 2)]


def test_what_is_no_yaml_or_multiplies_is_a_failure(monkeypatch):
    monkeypatch.setattr(C, "MOST", 500)
    bomb = "a: &a [x, x, x, x, x, x, x, x, x]\n" + "".join(f"{c}: &{c} [*{p}, *{p}, *{p}, *{p}, *{p}, *{p}]\n" for p, c in zip("abcdef", "bcdefg", strict=True))
    for text in (bomb, "a: {b: [1, 2\n", 'a: "open\n', "a: {b: ]}\n", "a: 1\n? odd\n", "a: 1\n- b\n"):
        assert X.extract_file("f", "YAML", text)[0]["row"] == "failure"
    assert names("YAML", "a: &a\n  b: *a\n") == ["a", "a.b"] and names("YAML", "") == [] and names("YAML", "# only\n") == []
    assert X.extract_file("f", "JSON", "{a: 1}")[0]["row"] == "failure"
    deep = "[" * 5000 + "]" * 5000
    assert X.extract_file("f", "YAML", deep)[0]["row"] in ("symbol", "failure")


def test_yaml_never_fails_a_job():
    rng = random.Random(1)
    whole = "a: &x\n  - b: {c: 1}\n    d: |\n      e\n  - *x\n'f': \"g\"\n---\n<<: *x\n"
    for _ in range(800):
        i, j = sorted((rng.randrange(len(whole)), rng.randrange(len(whole))))
        X.extract_file("f", "YAML", whole[:i] + "".join(rng.choices("{}[]:,-&*|>'\"\n #a", k=rng.randint(0, 4))) + whole[j:])


HCL = '''# resource "no" "no" {}
variable "region" { default = "a-}${"b"}" }
locals {
  name = "${var.region}-x"
  doc  = <<-EOT
    } resource "no" "no" { ${local.name}
  EOT
  list = [for x in var.zones : upper(x)]
}
resource "aws_instance" "web" {
  ami  = data.aws_ami.u.id
  tags = { Name = local.name, "k" = module.vpc.id }
  lifecycle { create_before_destroy = true }
  usb { host = aws_vpc.main.id }
  usb { host = aws_vpc.main["x"].id }
  provisioner "local-exec" {
    command = "echo ${aws_eip.ip.address} }"
    connection { host = self.public_ip }
  }
}
data "aws_ami" "u" {}
module "vpc" {
  source = "./mod"
}
module "other" {
  source = "${var.path}"
}
terraform {
  backend "s3" {}
}
output "ip" { value = aws_instance.web[0].public_ip }
provider "aws" { region = var.region }
'''  # fmt: skip


def test_hcl():
    rows = X.extract_file("m.tf", "HCL", HCL)
    got = {r["qualified_name"]: (r["kind"], r["start_line"], r["end_line"]) for r in rows if r["row"] == "symbol"}
    web = "resource.aws_instance.web"
    assert got == {
        "var.region": ("Variable", 2, 2), "local.name": ("Local", 4, 4), "local.doc": ("Local", 5, 7), "local.list": ("Local", 8, 8), web: ("Resource", 10, 20), f"{web}.lifecycle": ("Block", 13, 13),
        f"{web}.usb.0": ("Block", 14, 14), f"{web}.usb.1": ("Block", 15, 15), f"{web}.provisioner.local-exec": ("Block", 16, 19), f"{web}.provisioner.local-exec.connection": ("Block", 18, 18),
        "data.aws_ami.u": ("DataSource", 21, 21), "module.vpc": ("Module", 22, 24), "module.other": ("Module", 25, 27), "terraform": ("Block", 28, 30), "terraform.backend.s3": ("Block", 29, 29),
        "output.ip": ("Output", 31, 31), "provider.aws": ("Provider", 32, 32),
    }
    refs = {(r["edge_kind"], r["from_qn"], r["to_name"]) for r in rows if r["row"] == "edge"}
    r = lambda a, b: ("REFERENCES", a, b)
    assert refs == {
        r("local.name", "var.region"), r("local.doc", "local.name"), r("local.list", "var.zones"), r(web, "data.aws_ami.u"), r(web, "local.name"), r(web, "module.vpc"), r(web, "resource.aws_vpc.main"),
        r(web, "resource.aws_eip.ip"), ("IMPORTS", "module.vpc", "./mod"), r("module.other", "var.path"), r("output.ip", web), r("provider.aws", "var.region"),
    }
    assert [(x["kind"], x["qualified_name"]) for x in X.extract_file("a.tfvars", "HCL", 'region = "x"\nzones = [\n  "a",\n]\n')] == [("Setting", "region"), ("Setting", "zones")]

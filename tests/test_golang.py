"""Go sources to rows."""

import random

import pytest

from graphmill.operators import extract as X
from graphmill.operators import golang as GO


def rows(text, kind="symbol"):
    got = X.extract_file("w/w.go", "Go", "package widget\n" + text)
    assert not [r for r in got if r["row"] == "failure"]
    return [r for r in got if r["row"] == kind]


def edges(body, before="", kinds=("CALLS", "READS", "WRITES")):
    got = rows(f"{before}\nfunc f(a int, b *Store) (err error) {{\n{body}\n}}\n", "edge")
    return {(r["edge_kind"], r["to_name"]) for r in got if r["edge_kind"] in kinds and r["from_qn"] == "f"}


def test_fields_of_structs():
    text = """type S struct {
	sync.Mutex
	*log.Logger
	Plain
	List[int]
	in, out io.Writer `json:"a;}"`
	m map[string][]*T // comment }
	f func(a int) (string, error)
	c <-chan struct{ x int }
	arr [4]byte
	_ int
}
type G[K comparable, V any] struct { key K; val V }
type E struct{}
"""
    got = {(r["parent"], r["name"]): r["receiver_type"] for r in rows(text, "field")}
    assert got == {
        ("S", "Mutex"): "sync.Mutex", ("S", "Logger"): "*log.Logger", ("S", "Plain"): "Plain", ("S", "List"): "List[int]", ("S", "in"): "io.Writer", ("S", "out"): "io.Writer", ("S", "m"): "map[string][]*T",
        ("S", "f"): "func(a int)(string,error)", ("S", "c"): "<-chan struct{x int}", ("S", "arr"): "[4]byte", ("G", "key"): "K", ("G", "val"): "V",
    }
    assert [(r["kind"], r["qualified_name"]) for r in rows(text)] == [("Class", "S"), ("Class", "G"), ("Class", "E")]


def test_methods_of_interfaces():
    text = "type R interface {\n\tio.Closer\n\tRead(p []byte) (n int, err error)\n\t~int | ~string\n\tclose()\n}\ntype Empty interface{}\ntype Alias = R\n"
    assert [(r["parent"], r["name"]) for r in rows(text, "method")] == [("R", "Read"), ("R", "close")]
    assert [(r["kind"], r["name"]) for r in rows(text)] == [("Interface", "R"), ("Interface", "Empty"), ("Type", "Alias")]


def test_declarations_in_brackets_and_their_types():
    text = "const (\n\tA = iota\n\tB\n)\nvar x, y int = 1, 2\nvar (\n\tcache = &Cache{n: 1}\n\tpool = new(Pool[int])\n\t_ = y\n)\ntype (\n\tID int\n\tF func(int)\n)\n"
    got = {r["name"]: (r["kind"], r["signature"], r["start_line"]) for r in rows(text)}
    assert got == {
        "A": ("Variable", "A = iota", 3), "B": ("Variable", "B", 4), "x": ("Variable", "int", 6), "y": ("Variable", "int", 6), "cache": ("Variable", "*Cache", 8), "pool": ("Variable", "*Pool[int]", 9),
        "ID": ("Type", "ID int", 13), "F": ("Type", "F func(int)", 14),
    }


def test_functions_end_where_they_do():
    text = 'func a() {\n\ts := "}" + `}\n}` + string(\'}\') // }\n\t/* } */\n}\nfunc (s *Store[K, V]) B(n int, o ...Opt) (x, y int) {\n}\nfunc (Store) c() {}\nfunc decl(x int) error\nfunc D[T any, U ~int](t T) {}\n'
    assert [(r["kind"], r["qualified_name"], r["start_line"], r["end_line"]) for r in rows(text)] == [
        ("Function", "a", 2, 6), ("Method", "Store.B", 7, 8), ("Method", "Store.c", 9, 9), ("Function", "decl", 10, 10), ("Function", "D", 11, 11),
    ]


@pytest.mark.parametrize("body, want", [
    ("Cache = make(map[string]int)", {("WRITES", "Cache")}),
    ("Cache = Cache + 1", {("WRITES", "Cache"), ("READS", "Cache")}),
    ("Total += a", {("WRITES", "Total"), ("READS", "Total")}),
    ("Count++", {("WRITES", "Count"), ("READS", "Count")}),
    ("A, B = B, 1", {("WRITES", "A"), ("WRITES", "B"), ("READS", "B")}),
    ("x := Total\nx++", {("READS", "Total")}),
    ("for i, v := range Items {\nuse(i, v)\n}", {("READS", "Items"), ("CALLS", "use")}),
    ("for K = range Items {\n}", {("WRITES", "K"), ("READS", "Items")}),
    ("if Ready {\nreturn Fail\n}", {("READS", "Ready"), ("READS", "Fail")}),
    ("switch Mode {\ncase Fast:\ngo run()\n}", {("READS", "Mode"), ("READS", "Fast"), ("CALLS", "run")}),
    ("go func(z int) {\nHits = z\nhelper(z)\n}(3)", {("WRITES", "Hits"), ("CALLS", "helper")}),
    ("p := Point{X: Origin, Y: len(Grid)}\np.Move()", {("READS", "Point"), ("READS", "Origin"), ("READS", "Grid"), ("CALLS", "p.Move")}),
    ("return fmt.Errorf(\"Not %v a Read\", a)", {("CALLS", "fmt.Errorf")}),
    ("Gen[int](a)", {("CALLS", "Gen")}),
    ("b.q.Drain()\nb.Open().Close()\nstring(a)", {("CALLS", "b.q.Drain"), ("CALLS", "b.Open")}),
    ("var t Task\nt.Run()", {("CALLS", "t.Run"), ("READS", "Task")}),
    ("// Cache = 1\n_ = `Total`", set()),
])
def test_references(body, want):
    assert edges(body, 'import (\n\t"fmt"\n)') == want


def test_receivers_of_calls():
    text = "var shared = &Pool{}\nfunc (s *Store) M(q Queue) {\n\ts.Open()\n\ts.q.Drain()\n\tq.Add()\n\tshared.Get()\n\tt := &Task{}\n\tt.Run()\n\tunknown.Do()\n}\n"
    got = {r["to_name"]: r["receiver_type"] for r in rows(text, "edge") if r["edge_kind"] == "CALLS"}
    assert got == {"s.Open": "*Store", "s.q.Drain": "*Store", "q.Add": "Queue", "shared.Get": "*Pool", "t.Run": "*Task", "unknown.Do": None}


def test_rationale():
    text = """// process is plain, not a NOTE.

// NOTE: one for the file.

func process(x int) int {
	// HACK: clamp until the fix
	// lands upstream.
	return x
}

func (w *Widget) Render() {
	/*
	 * nothing
	 */
	x := 1 // todo cache
	// WHY
}
// FIXME: """ + "y" * 100 + "\n"
    got = [(r["name"], r["parent"], r["start_line"], r["end_line"], r["qualified_name"]) for r in rows(text) if r["kind"] == "Rationale"]
    assert got == [
        ("NOTE: one for the file.", None, 4, 4, "widget.rationale.L4"), ("HACK: clamp until the fix", "process", 7, 8, "widget.rationale.L7"), ("TODO: cache", "Widget.Render", 16, 17, "widget.rationale.L16"),
        ("FIXME: " + "y" * 71 + "…", None, 19, 19, "widget.rationale.L19"),
    ]


def test_imports():
    text = 'import "os"\nimport (\n\t. "a/b"\n\tx "c/d/v2"\n\t_ `e`\n)\n'
    assert [r["to_name"] for r in rows(text, "edge")] == ["os", "a/b", "c/d/v2", "e"]


def test_broken_sources_give_what_they_can():
    whole = "func a() {\n\tb()\n}\n\ntype S struct {\n\tx int\n}\nfunc (s *S) m() { s.x = 1 }\nvar v = map[string][]int{\"a\": {1}}\n"
    rng = random.Random(3)
    assert [r["name"] for r in rows("func broken( {\n" + whole)][:1] == ["broken"]
    assert {r["name"] for r in rows("garbage ) } here\n" + whole)} == {"a", "S", "m", "v"}
    for _ in range(600):
        a, b = sorted((rng.randrange(len(whole)), rng.randrange(len(whole))))
        rows(whole[:a] + "".join(rng.choice("{}()[]\"`/*.,;:=&a1\n ") for _ in range(rng.randint(0, 4))) + whole[b:])
    assert GO.Source("").tokens == [";"] * 4


def test_fields_are_replaced_and_go_with_their_file(spark):
    from graphmill.operators import store as K

    table = "project_id string, file_path string, struct string, field string, type string"
    now = spark.createDataFrame([("p", "a.go", "S", "x", "int"), ("p", "b.go", "T", "y", "int"), ("q", "a.go", "S", "x", "int")], table)
    files = spark.createDataFrame([("p", "a.go")], "project_id string, file_path string")
    new = spark.createDataFrame([("p", "a.go", "S", "z", "*U")], table)
    fields = lambda df: sorted((r.project_id, r.field) for r in df.collect())
    assert fields(K.replace_members(now, new, files)) == [("p", "y"), ("p", "z"), ("q", "x")]
    assert fields(K.replace_members(now, new.limit(0), files)) == [("p", "y"), ("q", "x")]

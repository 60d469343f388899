"""A small graph: the program of a lighthouse station."""

from graphmill.schema import EDGES, SYMBOLS

#: id, name, kind, language, exported, entry point, test, complexity, signature, docstring; the id begins with the file's name.
ROWS = [
    ("lamp.light", "Light", "Method", "Go", True, False, False, 6, "func (l *Lamp) Light() bool", "turns the lamp on"),
    ("lamp.dim", "dim", "Method", "Go", False, False, False, 3, "func (l *Lamp) dim(n int)", ""),
    ("lamp.type", "Lamp", "Class", "Go", True, False, False, 0, "", "a lamp"),
    ("keeper.run", "run", "Function", "Python", False, True, False, 9, "def run(nights)", "keeps watch"),
    ("keeper.log", "write_log", "Function", "Python", False, False, False, 2, "def write_log(line)", ""),
    ("keeper.test", "test_run", "Function", "Python", False, False, True, 4, "def test_run()", ""),
    ("horn.blow", "Blow", "Function", "Go", True, False, False, 1, "func Blow(times int)", ""),
    ("horn.unused", "muffle", "Function", "Go", False, False, False, 2, "func muffle()", ""),
    ("horn.run", "run", "Method", "Go", False, False, False, 5, "func (h *Horn) run()", ""),
    ("tide.table", "TideTable", "Variable", "Python", True, False, False, 0, "", ""),
    ("tide.level", "level", "Variable", "Go", False, False, False, 0, "", ""),
]
LINKS = [
    ("keeper.test", "keeper.run", "CALLS"), ("keeper.run", "lamp.light", "CALLS"), ("keeper.run", "horn.blow", "CALLS"), ("keeper.run", "keeper.log", "CALLS"), ("keeper.log", "keeper.run", "CALLS"),
    ("lamp.light", "lamp.dim", "CALLS"), ("lamp.dim", "tide.level", "WRITES"), ("horn.blow", "tide.level", "READS"), ("keeper.run", "tide.table", "READS"),
]
NAMES = ("id", "name", "kind", "language", "is_exported", "is_entry_point", "is_test", "complexity", "signature", "docstring")
NODES = [dict(zip(NAMES, r, strict=True)) for r in ROWS]


def file_of(node: str, language: str) -> str:
    return f"station/{node.split('.')[0]}.{'go' if language == 'Go' else 'py'}"


def symbols(spark, nodes=NODES):
    columns = [f.split()[0] for f in SYMBOLS.split(", ")]
    fixed = {"project_id": "p", "start_byte": 0, "end_byte": 100, "start_line": 1, "end_line": 5, "extraction_confidence": 1.0, "branch": ""}
    rows = [fixed | n | {"qualified_name": n["name"], "file_path": file_of(n["id"], n["language"])} for n in nodes]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], SYMBOLS)


def edges(spark, links=LINKS, confidence=1.0):
    return spark.createDataFrame([("p", a, b, k, confidence, None, "per_file", "", "EXTRACTED") for a, b, k in links], EDGES)

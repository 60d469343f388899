"""Schemas of the graph store, the property dictionary of the query language and its fixed vocabularies."""

from __future__ import annotations

SYMBOLS = (
    "project_id string, id string, file_path string, name string, qualified_name string, kind string, language string, "
    "start_byte bigint, end_byte bigint, start_line int, end_line int, signature string, return_type string, docstring string, "
    "parent string, complexity int, is_exported boolean, is_test boolean, is_entry_point boolean, file_hash string, "
    "extraction_confidence double, branch string"
)
EDGES = "project_id string, from_id string, to_id string, kind string, confidence double, properties string, source string, branch string, provenance_tier string"
PENDING = "project_id string, from_file string, kind string, from_qn string, to_name string, confidence double, receiver_type string, base_type string"
CALLS = (
    "session_id string, tool string, complexity_tier string, response_bytes bigint, tokens_used bigint, tokens_saved bigint, "
    "tokens_saved_pct double, ts bigint, request_id string"
)
HOOKS = (
    "id bigint, ts bigint, session_id string, tool_name string, file_path string, file_bytes bigint, decision string, suggested_tool string, "
    "suggested_args string, next_tool_within_3 string, took_recommendation int, est_tokens_served bigint, baseline_tokens bigint"
)
LOOPS = "project_id string, loop_name string, seq int, created_at string, claim string, decision string, confidence string, reopen_trigger string, evidence string, watermark string"

#: Property of the query language to column of SYMBOLS.
PROPERTIES = {
    **{c: c for c in (
        "id", "project_id", "file_path", "name", "qualified_name", "kind", "language", "start_byte", "end_byte", "start_line", "end_line", "signature", "return_type",
        "docstring", "parent", "complexity", "is_exported", "is_test", "is_entry_point", "file_hash", "extraction_confidence",
    )},
    "project": "project_id", "qn": "qualified_name", "label": "kind", "confidence": "extraction_confidence",
}
EDGE_PROPERTIES = {"kind": "kind", "confidence": "confidence"}
INT = {"start_byte", "end_byte", "start_line", "end_line", "complexity"}
REAL = {"extraction_confidence", "confidence"}
BOOL = {"is_exported", "is_test", "is_entry_point"}


def property_type(column: str) -> str:
    """int, real, bool or text."""
    return "int" if column in INT else "real" if column in REAL else "bool" if column in BOOL else "text"


# The edge kinds that the language knows, and those that calls are traced over.
EDGE_KINDS = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS", "READS", "WRITES", "IMPORTS", "REFERENCES", "USES_VAR", "INCLUDES", "LOADS")
CALL_FAMILY = ("CALLS", "HTTP_CALLS", "ASYNC_CALLS")

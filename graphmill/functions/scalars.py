"""Scalar functions as Column builders; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def approx_tokens(text: Column) -> Column:
    """About four bytes a token, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("bigint")


def symbol_id(file_path: Column, qualified_name: Column, kind: Column) -> Column:
    return F.concat(file_path, F.lit("::"), qualified_name, F.lit("#"), kind)


def file_of_id(symbol: Column) -> Column:
    return F.when(F.contains(symbol, F.lit("::")), F.substring_index(symbol, "::", 1)).otherwise(F.lit(""))


def name_of_id(symbol: Column) -> Column:
    """The last part of the qualified name in an id."""
    return F.regexp_extract(symbol, r"([^.:#/]*)(?:#[^#]*)?$", 1)


def package_of_file(path: Column) -> Column:
    """Folder of a path, `.` at the root; empty for what is outside of the project."""
    clean = F.regexp_replace(path, r"\\", "/")
    outside = (clean == "") | clean.startswith("@external") | (clean == "external") | clean.startswith("external/")
    return F.when(path.isNull() | outside, F.lit("")).when(~F.contains(clean, F.lit("/")), F.lit(".")).otherwise(F.regexp_replace(clean, "/[^/]*$", ""))


def package_of_id(symbol: Column) -> Column:
    return package_of_file(file_of_id(symbol))


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def risk_label(depth: Column) -> Column:
    return F.when(depth == 1, "CRITICAL").when(depth == 2, "HIGH").when(depth == 3, "MEDIUM").otherwise("LOW")


# What counts as a branch in the estimate of complexity.
BRANCH_WORDS = ("if ", "else ", "for ", "while ", "switch ", "case ", "catch ", "&&", "||")


def complexity(body: Column) -> Column:
    out: Column = F.lit(1)
    for w in BRANCH_WORDS:
        out = out + F.floor((F.length(body) - F.length(F.replace(body, F.lit(w), F.lit("")))) / len(w))
    return out.cast("int")


def is_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


# Baselines of confidence by kind.
KIND_BASELINE = {
    "Function": 1.00, "Method": 1.00, "Class": 1.00, "Interface": 1.00, "Type": 1.00, "Enum": 1.00, "Module": 0.95, "Variable": 0.95, "Setting": 0.95, "Resource": 0.95,
    "DataSource": 0.95, "Output": 0.95, "Provider": 0.95, "Local": 0.95, "Block": 0.85, "Section": 0.80, "Heading": 0.80, "Document": 0.70, "CodeSnippet": 0.70,
}


def composed_confidence(base: Column, kind: Column, path_penalty: Column, ident_bonus: Column, generated: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in KIND_BASELINE.items() for x in (k, v)])
    score = (base + F.coalesce(F.element_at(table, kind), base)) / 2 + path_penalty + ident_bonus + generated
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def is_generated(source: Column) -> Column:
    return F.contains(F.substring(source, 1, 1024), F.lit("Code generated"))


def in_folder(path: Column, folder: str) -> Column:
    return F.array_contains(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), folder)


def corpus_of(language: Column, kind: Column) -> Column:
    return F.when((kind == "Document") | language.isin("Markdown", "HTML"), "docs").when(language.isin("YAML", "JSON", "HCL", "TOML", "XML"), "config").otherwise("code")


def provenance_tier(tier: Column) -> Column:
    t = F.upper(F.trim(tier))
    return F.when(t.isin("EXTRACTED", "INFERRED", "AMBIGUOUS"), t).otherwise("EXTRACTED")


def staleness(seconds: Column) -> Column:
    n = lambda d: F.floor(seconds / d).cast("bigint").cast("string")
    return (
        F.when(seconds < 60, F.concat(n(1), F.lit("s"))).when(seconds < 3600, F.concat(n(60), F.lit("m"))).when(seconds < 86400, F.concat(n(3600), F.lit("h")))
        .otherwise(F.concat(n(86400), F.lit("d")))
    )


def size_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def version_parts(version: Column) -> Column:
    """Four numbers of a version, so that structs compare as versions do."""
    parts = F.split(F.regexp_replace(version, "^v|[-+].*$", ""), r"\.")
    return F.struct(*[F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)).alias(f"v{i}") for i in range(4)])


def saved_pct(used: Column, saved: Column) -> Column:
    return F.when(used + saved > 0, 100.0 * saved / (used + saved))


def savings_signal(used: Column, saved: Column) -> Column:
    """A word for how much was saved."""
    pct = saved_pct(used, saved)
    return (
        F.when(saved.isNull(), "needs_baseline").when(used + saved <= 0, "no_usage").when(pct >= 70, "excellent").when(pct >= 50, "good").when(pct >= 30, "watch")
        .otherwise("improve_query")
    )


def confidence_bucket(c: Column) -> Column:
    return F.when(c < 0.5, "0.0-0.5").when(c < 0.7, "0.5-0.7").when(c < 0.9, "0.7-0.9").otherwise("0.9-1.0")


def canonical_args(args: Column) -> Column:
    """A map of strings as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(args))))


# What makes a path one of a test, or of a fixture.
TEST_FILE = (
    r"_test\.go$|\.test\.(ts|tsx|mjs|cjs|js|jsx)$|\.spec\.(ts|tsx|mjs|cjs|js|jsx)$|(^|/)test_[^/]*\.py$|_test\.py$|_spec\.rb$|_test\.rb$|Test\.java$|Test\.kt$|Spec\.scala$"
    r"|(^|/)(tests|test|spec|__tests__)/"
)
FIXTURE_PATH = r"(^|/)(testdata|__fixtures__|test-fixtures|test_fixtures|fixtures)/"


def is_test_file(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike(TEST_FILE)


def is_fixture_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/").rlike(FIXTURE_PATH)


def under_any(path: Column, prefixes: list[str]) -> Column:
    """A path that is one of the prefixes or lies below it."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p) | path.startswith(p if p.endswith("/") else p + "/")
    return out


def exact_identifier(text: str) -> bool:
    return bool(text) and all(c == "_" or c.isascii() and c.isalnum() for c in text)

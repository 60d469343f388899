"""Source files as a table: a walk with skip rules and ignore files, language detection, byte ranges."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 4 << 20
# Folders and files that are not read.
SKIP_DIRS = (".git", "node_modules", "vendor", ".cache", "dist", "build", "__pycache__", ".venv", "venv", "env", "target", ".next", ".nuxt", "coverage")
LOCKFILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "composer.lock", "cargo.lock", "gemfile.lock", "poetry.lock", "pipfile.lock", "go.sum",
    ".pnp.cjs", ".pnp.js", ".pnp.loader.mjs", ".pnp.data.json",
)
# Languages by extension and by file name.
EXTENSIONS = {
    "bash": "Bash", "c": "C", "cc": "C++", "cjs": "JavaScript", "config": "XML", "cpp": "C++", "cs": "C#", "cxx": "C++", "dart": "Dart", "ddl": "SQL", "ex": "Elixir", "exs": "Elixir",
    "go": "Go", "h": "C", "hcl": "HCL", "hh": "C++", "hpp": "C++", "htm": "HTML", "html": "HTML", "java": "Java", "js": "JavaScript", "json": "JSON", "jsx": "JSX", "kt": "Kotlin",
    "kts": "Kotlin", "lua": "Lua", "mak": "Makefile", "markdown": "Markdown", "md": "Markdown", "mdc": "Markdown", "mdx": "Markdown", "mjs": "JavaScript", "mk": "Makefile", "php": "PHP",
    "py": "Python", "pyw": "Python", "r": "R", "rake": "Ruby", "rb": "Ruby", "rs": "Rust", "sc": "Scala", "scala": "Scala", "sh": "Bash", "sql": "SQL", "swift": "Swift", "tf": "HCL",
    "tfvars": "HCL", "toml": "TOML", "ts": "TypeScript", "tsx": "TSX", "xml": "XML", "xsd": "XML", "xsl": "XML", "xslt": "XML", "yaml": "YAML", "yml": "YAML", "zig": "Zig", "j2": "Jinja",
}
FILENAMES = {"makefile": "Makefile", "gnumakefile": "Makefile", "rakefile": "Ruby", "gemfile": "Ruby"}
SHELLS = ("sh", "bash", "dash", "ash", "ksh", "zsh")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def skipped(path: Column) -> Column:
    """Whether a path is one of a lockfile, minified bundle, source map or skipped folder."""
    base = F.lower(F.substring_index(path, "/", -1))
    folders = path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/")
    return folders | base.isin(list(LOCKFILES)) | base.rlike(r"\.min\.(js|mjs|cjs|jsx|ts|tsx|css)$") | base.endswith(".map")


def language(path: Column, content: Column | None = None) -> Column:
    """By file name, then by extension, then by the shebang of what has neither."""
    base = F.lower(F.substring_index(path, "/", -1))
    extension = F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1))
    out = F.coalesce(F.element_at(_map(FILENAMES), base), F.element_at(_map(EXTENSIONS), extension))
    if content is None:
        return out
    line = F.regexp_replace(F.substring_index(F.substring(content, 1, 512), "\n", 1), r"[\r ]+$", "")
    tool = F.regexp_extract(line, r"^#!\s*(?:\S*/)?(?:env\s+(?:-S\s+)?)?(?:\S*/)?([^\s/]+)", 1)
    return F.coalesce(out, F.when(tool.isin(list(SHELLS)), "Bash"))


def refuse(root: str) -> None:
    """Raise ValueError for a folder that is no project: a root, a home, or where temporary files go."""
    clean = os.path.realpath(re.sub("^file:/+", "/", root)) if re.match("(file:)?/", root) else root.rstrip("/")
    if clean in ("/", os.path.realpath(os.path.expanduser("~")), os.path.realpath(tempfile.gettempdir())) or re.fullmatch(r"\w+://[^/]*", clean):
        raise ValueError(f"{root} is no project: name a folder below it")


def ignore_rule(line: str, folder: str = "") -> tuple[str, bool] | None:
    """(regular expression over paths, whether it takes back) of a line of an ignore file that stands in a folder; None for blanks and comments."""
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
    only_folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[!?[^\]]*\]|\\.|.", line, re.DOTALL):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (("[^" + part[2:] if part.startswith("[!") else part) if len(part) > 2 and part[0] == "[" else re.escape(part[-1]))
    start = re.escape(folder + "/") if folder else ""
    return "^" + start + ("" if anchored else "(?:.*/)?") + out + ("/.*$" if only_folder else "(?:/.*)?$"), back


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    out = F.lit(False)
    for pattern, back in rules:
        out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^" + re.escape(re.sub("^file:/+", "/", root).rstrip("/")) + "/", "")


def ignore_rules(spark: SparkSession, root: str, names: Sequence[str] = (".gitignore",)) -> list[tuple[str, bool]]:
    """The rules of the ignore files in the folders below a root, those of deeper folders after those of higher ones.

    Spark does not list files whose names begin with a dot, so the folders that hold any file are asked for them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = {""}
    for r in listed.select(F.regexp_replace(_relative(F.col("path"), root), "/?[^/]*$", "").alias("folder")).distinct().collect():
        folder = r.folder
        while folder and folder not in below:
            below.add(folder)
            folder = folder.rpartition("/")[0]
    jvm, rules = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in sorted(below, key=lambda x: (x.count("/") + bool(x), x)):
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (root.rstrip("/"), folder, name))))
            if fs.exists(at):
                stream = fs.open(at)
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                rules += [ignore_rule(line, folder) for line in text.split("\n")]
    return [r for r in rules if r]


def _listed(spark: SparkSession, root: str, max_bytes: int, ignore: Sequence[str]) -> DataFrame:
    """All files below a folder, with the reason for which one is not read."""
    refuse(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = raw.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")
    reason = F.when(skipped(F.col("path")), "skipped").when(ignored(F.col("path"), ignore_rules(spark, root, ignore)), "ignored").when(F.col("bytes") > max_bytes, "too_large")
    return files.withColumn("reason", reason)


def left_out(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: Sequence[str] = (".gitignore",)) -> DataFrame:
    """(path, bytes, reason) of the files that walk() does not give: skipped, ignored or too_large."""
    return _listed(spark, root, max_bytes, ignore).filter("reason is not null").select("path", "bytes", "reason")


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, ignore: Sequence[str] = (".gitignore",)) -> DataFrame:
    """(path, bytes, mtime, content, hash, language) of the files below a folder of any file system that Spark reads.

    ignore: names of the files whose rules leave others out.  What is not given, and why, left_out() tells.
    """
    files, text = _listed(spark, root, max_bytes, ignore).filter("reason is null"), F.col("content").cast("string")
    return files.select("path", "bytes", "mtime", text.alias("content"), F.hex(F.xxhash64("content")).alias("hash"), language(F.col("path"), text).alias("language"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose hash is not that of known (path, hash)."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def vanished_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.select("path").join(files.select("path"), "path", "left_anti")


def source_of(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with `source`, their bytes of the file, or null and `stale` where the file has another hash than the symbol."""
    f = files.select(F.col("path").alias("file_path"), F.col("content").cast("binary").alias("__content"), F.col("hash").alias("__hash"))
    out = symbols.join(f, "file_path", "left")
    stale = F.col("__hash").isNull() | (F.col("file_hash").isNotNull() & (F.col("file_hash") != F.col("__hash")))
    part = F.substring(F.col("__content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string")
    return out.withColumn("stale", stale).withColumn("source", F.when(~stale, part)).drop("__content", "__hash")

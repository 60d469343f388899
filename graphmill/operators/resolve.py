"""Deferred edges to edges: names in one file are looked up among the symbols of all files, by chains of left joins.

Every rule joins the pending names with one row for each key, made by an aggregation (a least id, or a name that
only one node has), and the first rule that finds something wins.  A name that very many files use makes the
pending side skewed, which adaptive execution splits, as nothing above the joins needs its rows together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import scalars as S
from graphmill.plans.cut import cut

NOT_CODE = ("Setting", "Section", "Document", "Block", "Rationale")
# Packages of a standard library, whose methods are never those of the project.
STDLIB = (
    "strings", "bytes", "time", "os", "fmt", "io", "ioutil", "errors", "context", "sync", "atomic", "filepath", "path", "exec", "url", "http", "regexp", "sort",
    "strconv", "math", "rand", "log", "slog", "ast", "token", "reflect", "runtime", "unsafe", "unicode", "utf8", "utf16", "binary", "hex", "base64", "csv", "xml", "html",
    "template", "tls", "syscall", "encoding", "hash", "crypto", "sha256", "sha1", "md5", "rsa", "tar", "zip", "gzip", "flate", "bufio", "bits", "big", "cmplx", "list",
    "ring", "heap", "container", "image", "color", "draw", "jpeg", "png", "gif", "mime", "multipart", "smtp", "mail", "net", "tcp", "udp", "ip", "rpc", "jsonrpc",
    "signal", "user", "build", "cgo", "format", "parser", "printer", "scanner", "types", "constant", "doc", "importer", "plugin", "tabwriter", "text", "elliptic",
    "ecdsa", "ed25519", "x509", "pem", "subtle", "sql", "driver", "expvar", "trace", "pprof",
)
# Method names that many types have.
POLYMORPHIC = (
    "String", "Error", "GoString", "Read", "Write", "Close", "Seek", "ReadAt", "WriteAt", "ReadFrom", "WriteTo", "ReadByte", "WriteByte", "ReadString", "WriteString",
    "ReadRune", "WriteRune", "UnreadByte", "UnreadRune", "Lock", "Unlock", "RLock", "RUnlock", "TryLock", "Len", "Less", "Swap", "ServeHTTP", "MarshalJSON",
    "UnmarshalJSON", "MarshalText", "UnmarshalText", "MarshalBinary", "UnmarshalBinary", "MarshalYAML", "UnmarshalYAML", "Format", "Scan", "Now", "Add", "Sub", "Before",
    "After", "Equal", "Deadline", "Done", "Err", "Value", "Is", "As", "Unwrap", "Stats", "Run",
)
# What a build tag adds to a file's name.
PLATFORMS = (
    "aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "js", "linux", "nacl", "netbsd", "openbsd", "plan9", "solaris", "unix", "wasip1",
    "windows", "zos", "386", "amd64", "amd64p32", "arm", "arm64", "armbe", "arm64be", "loong64", "mips", "mips64", "mips64le", "mips64p32", "mips64p32le", "mipsle",
    "ppc", "ppc64", "ppc64le", "riscv", "riscv64", "s390", "s390x", "sparc", "sparc64", "wasm",
)


def first_by(df: DataFrame, keys: list[str], alias: str, order: Column | None = None) -> DataFrame:
    """One row for each key: the id that sorts first."""
    value = F.min("id") if order is None else F.min_by("id", F.struct(order, "id"))
    return df.groupBy(*keys).agg(value.alias(alias))


def only_by(df: DataFrame, keys: list[str], alias: str) -> DataFrame:
    """One row for each key that exactly one node has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias(alias)).filter("__n = 1").drop("__n")


def folder(path: Column) -> Column:
    return S.package_of_file(path)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _from(pending: DataFrame, symbols: DataFrame) -> DataFrame:
    """pending with from_id: the qualified name in the same file, else anywhere, else a bare name."""
    here = first_by(symbols.select("project_id", F.col("file_path").alias("from_file"), F.col("qualified_name").alias("from_qn"), "id"), ["project_id", "from_file", "from_qn"], "f0")
    anywhere = first_by(symbols.select("project_id", F.col("qualified_name").alias("from_qn"), "id"), ["project_id", "from_qn"], "f1")
    bare = first_by(symbols.select("project_id", F.col("name").alias("from_qn"), "id"), ["project_id", "from_qn"], "f2")
    out = pending.join(here, ["project_id", "from_file", "from_qn"], "left").join(anywhere, ["project_id", "from_qn"], "left").join(bare, ["project_id", "from_qn"], "left")
    plain = ~F.contains("from_qn", F.lit("."))
    return out.withColumn("from_id", F.coalesce("f0", "f1", F.when(plain, F.col("f2")))).drop("f0", "f1", "f2")


def _edges(found: DataFrame, kind: str | None = None, confidence: Column | None = None, source: str = "resolve_pass") -> DataFrame:
    out = found.filter("from_id is not null and to_id is not null and from_id <> to_id")
    kind_column = F.lit(kind) if kind else F.col("kind")
    return out.groupBy("project_id", "from_id", "to_id", kind_column.alias("kind")).agg(F.max(confidence if confidence is not None else F.col("confidence")).alias("confidence")).withColumn("source", F.lit(source))


def external_id(name: Column) -> Column:
    return S.symbol_id(F.lit("@external"), name, F.lit("Module"))


def python_candidates(to_name: Column, from_file: Column, roots: list[str]) -> Column:
    """Names that an import may mean, in order: as it is and below each source root; a relative one by the importing file."""
    dots = F.length(F.regexp_extract(to_name, r"^(\.*)", 1))
    rest = F.regexp_replace(to_name, r"^\.+", "")
    parts = F.split(F.regexp_replace(from_file, r"\\", "/"), "/")
    up = F.size(parts) - dots
    base = F.array_join(F.slice(parts, 1, F.greatest(up, F.lit(0))), ".")
    relative = F.when(up < 0, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws(".", F.when(base != "", base), F.when(rest != "", rest))))
    plain = F.array(to_name, *[F.concat(F.lit(r.replace("/", ".") + "."), to_name) for r in roots if r])
    return F.when(dots > 0, relative).otherwise(plain)


def resolve_imports(symbols: DataFrame, pending: DataFrame, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """IMPORTS edges, and the external modules made for what no file of the project defines."""
    p = pending.filter("kind = 'IMPORTS'")
    begin = first_by(symbols.select("project_id", F.col("qualified_name").alias("from_qn"), "id"), ["project_id", "from_qn"], "from_id")
    p = p.join(begin, ["project_id", "from_qn"]).withColumn("row", F.struct("from_file", "from_qn", "to_name"))
    python = F.lower("from_file").rlike(r"\.pyw?$")
    names = F.when(python, python_candidates(F.col("to_name"), F.col("from_file"), roots or [])).otherwise(F.array("to_name"))
    tried = p.select("*", F.posexplode_outer(names).alias("rank", "candidate"))
    target = first_by(symbols.select("project_id", F.col("qualified_name").alias("candidate"), "id"), ["project_id", "candidate"], "hit")
    tried = tried.join(target, ["project_id", "candidate"], "left")
    best = tried.groupBy("project_id", "from_id", "row").agg(F.min_by("hit", F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("hit"), F.max("confidence").alias("confidence"))
    found = best.withColumn("to_id", F.coalesce("hit", external_id(F.col("row.to_name"))))
    externals = found.filter("hit is null").select("project_id", F.col("to_id").alias("id"), F.lit("@external").alias("file_path"), F.col("row.to_name").alias("name"), F.col("row.to_name").alias("qualified_name"), F.lit("Module").alias("kind")).distinct()
    return _edges(found, "IMPORTS"), externals


def resolve_calls(symbols: DataFrame, pending: DataFrame, struct_fields: DataFrame | None = None, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """CALLS edges by the cascade of rules, and one row that counts what was dropped and why.

    struct_fields: (project_id, struct, field, type) of Go types.
    """
    code = symbols.filter(~F.col("kind").isin(list(NOT_CODE)))
    p = _from(pending.filter("kind = 'CALLS'"), symbols)
    language = symbols.select("project_id", F.col("id").alias("from_id"), "language")
    p = p.join(language, ["project_id", "from_id"], "left").withColumn("dir", folder(F.col("from_file"))).withColumn("tail", last_part(F.col("to_name")))
    p = p.withColumn("head", F.substring_index("to_name", ".", 1)).withColumn("dotted", F.contains("to_name", F.lit(".")))
    go, python, js = F.col("language") == "Go", F.col("language") == "Python", F.col("language").isin("JavaScript", "TypeScript", "JSX", "TSX")
    by_qn = lambda alias, key: first_by(code.select("project_id", F.col("qualified_name").alias(key), "id"), ["project_id", key], alias)
    # 1: exact name; for Python also below its source roots.
    p = p.join(by_qn("t1", "to_name"), ["project_id", "to_name"], "left")
    root_hits = []
    for i, r in enumerate(r for r in roots or [] if r):
        p = p.withColumn("__q", F.concat(F.lit(r.replace("/", ".") + "."), "to_name")).join(by_qn(f"r{i}", "__q"), ["project_id", "__q"], "left").drop("__q")
        root_hits.append(F.col(f"r{i}"))
    # 1a: for Python, a dotted name with which one qualified name ends.
    tails = code.filter("language = 'Python'").select("project_id", "qualified_name", "id", F.split("qualified_name", r"\.").alias("q"))
    at = F.sequence(F.lit(2), F.size("q"))
    tails = tails.filter(F.size("q") > 2).select("project_id", "qualified_name", "id", F.explode(F.transform(at, lambda i: F.array_join(F.slice("q", i, F.size("q")), "."))).alias("to_name"))
    tails = tails.groupBy("project_id", "to_name").agg(F.countDistinct("qualified_name").alias("__n"), F.min("id").alias("t1a")).filter("__n = 1").drop("__n")
    p = p.join(tails, ["project_id", "to_name"], "left")
    # The pending names are written between rules, as the driver holds a plan and its changes while it runs: one plan of all rules took its memory.
    p = cut(p)
    # 2: a name of the same folder.
    local = code.select("project_id", folder(F.col("file_path")).alias("dir"), F.col("name").alias("to_name"), "id")
    p = p.join(first_by(local, ["project_id", "dir", "to_name"], "t2"), ["project_id", "dir", "to_name"], "left")
    # 3: a method of the receiver's type, pointer or not, perhaps through one field of it.
    clean = F.regexp_replace(F.coalesce("receiver_type", F.lit("")), r"^\*", "")
    depth = F.size(F.split("to_name", r"\."))
    p = p.withColumn("__m", F.when((clean != "") & (depth <= 2), F.concat(clean, F.lit("."), "tail")))
    p = p.join(by_qn("t3", "__m"), ["project_id", "__m"], "left").drop("__m")
    if struct_fields is not None:
        f = struct_fields.select("project_id", F.col("struct").alias("__s"), F.col("field").alias("__f"), F.regexp_replace("type", r"^\*", "").alias("__t"))
        # recv.field.M, and recv.M where an embedded type has the method.
        f = f.groupBy("project_id", "__s", "__f").agg(F.min("__t").alias("__t"))
        p = p.withColumn("__s", clean).withColumn("__f", F.when(depth == 3, F.get(F.split("to_name", r"\."), F.lit(1)))).join(f, ["project_id", "__s", "__f"], "left")
        p = p.withColumn("__m", F.concat("__t", F.lit("."), "tail")).join(by_qn("t4", "__m"), ["project_id", "__m"], "left").drop("__m", "__s", "__f", "__t")
    else:
        p = p.withColumn("t4", F.lit(None).cast("string"))
    # 4: without a receiver's type, that of the folder's variable on which the call is made, which its signature tells.
    held = code.filter("kind = 'Variable' and signature <> ''") if "signature" in code.columns else code.limit(0).withColumn("signature", F.lit(""))
    held = held.groupBy("project_id", folder(F.col("file_path")).alias("dir"), F.col("name").alias("head")).agg(F.min("signature").alias("__v"))
    p = p.join(held, ["project_id", "dir", "head"], "left")
    single = (clean == "") & (F.size(F.split("to_name", r"\.")) == 2)
    p = p.withColumn("__m", F.when(single, F.concat(F.regexp_replace("__v", r"^[*&]", ""), F.lit("."), "tail"))).join(by_qn("t4v", "__m"), ["project_id", "__m"], "left").drop("__m", "__v")
    p = cut(p)
    # 5: a class by its name, then its method.
    classes = only_by(code.filter("kind in ('Class', 'Interface')").select("project_id", F.col("name").alias("__c"), "id"), ["project_id", "__c"], "class_id")
    named = code.select("project_id", F.col("id").alias("class_id"), F.col("qualified_name").alias("class_qn"))
    p = p.withColumn("__c", clean).join(classes, ["project_id", "__c"], "left").join(named, ["project_id", "class_id"], "left")
    p = p.withColumn("__m", F.concat("class_qn", F.lit("."), "tail")).join(by_qn("t5", "__m"), ["project_id", "__m"], "left").drop("__m", "__c", "class_id", "class_qn")
    # 6: a bare name that one node of the web languages has, or one of the same folder.
    web = code.filter(F.col("language").isin("JavaScript", "TypeScript", "JSX", "TSX"))
    p = p.join(only_by(web.select("project_id", F.col("name").alias("to_name"), "id"), ["project_id", "to_name"], "t6"), ["project_id", "to_name"], "left")
    here = web.select("project_id", folder(F.col("file_path")).alias("dir"), F.col("name").alias("to_name"), "id")
    p = p.join(only_by(here, ["project_id", "dir", "to_name"], "t6d"), ["project_id", "dir", "to_name"], "left")
    # 7: a method that only one type has, unless its name or receiver says nothing.
    methods = only_by(code.filter("kind = 'Method' and language = 'Go'").filter(~S.is_fixture_path(F.col("file_path"))).select("project_id", F.col("name").alias("tail"), "id"), ["project_id", "tail"], "t7")
    p = p.join(methods, ["project_id", "tail"], "left")
    telling = ~F.col("head").isin(list(STDLIB)) & ~F.col("tail").isin(list(POLYMORPHIC))
    bare = ~F.col("dotted")
    to = F.coalesce(
        "t1", *[F.when(python, r) for r in root_hits], F.when(python & F.col("dotted"), F.col("t1a")), F.when(go & bare, F.col("t2")), F.when(go & ~F.col("head").isin(list(STDLIB)), F.coalesce("t3", "t4", "t4v")),
        F.when(js, F.coalesce("t5", F.when(bare, F.coalesce("t6", "t6d")))), F.when(go & F.col("dotted") & telling, F.col("t7")),
    )
    p = cut(p.withColumn("to_id", to))
    drops = p.agg(
        F.count_if(F.col("from_id").isNull()).alias("from_missing"), F.count_if(F.col("from_id").isNotNull() & F.col("to_id").isNull()).alias("to_missing"),
        F.count_if(F.col("from_id") == F.col("to_id")).alias("self_edges"),
    )
    return _edges(with_siblings(p.select("project_id", "from_id", "to_id", "confidence"), code), "CALLS"), drops


def without_platform(path: Column) -> Column:
    """A Go file's path without what a build tag adds to it; null for other files."""
    return F.when(path.endswith(".go"), F.regexp_replace(path, "(_(" + "|".join(PLATFORMS) + r"))?\.go$", ""))


def with_siblings(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """found with, for each target, its twins in files for other platforms."""
    s = symbols.select("project_id", "id", "qualified_name", "file_path", without_platform(F.col("file_path")).alias("stem")).filter("stem is not null")
    pairs = s.join(s.select("project_id", F.col("id").alias("twin"), "qualified_name", F.col("file_path").alias("twin_path"), "stem"), ["project_id", "qualified_name", "stem"]).filter("id <> twin and file_path <> twin_path")
    more = found.join(pairs.select("project_id", F.col("id").alias("to_id"), "twin"), ["project_id", "to_id"]).select("project_id", "from_id", F.col("twin").alias("to_id"), "confidence")
    return found.select("project_id", "from_id", "to_id", "confidence").union(more)


def resolve_reads(symbols: DataFrame, pending: DataFrame) -> DataFrame:
    """READS and WRITES edges to variables of the same language; a function or method that is named as a value becomes a CALLS edge of confidence 0.4."""
    p = _from(pending.filter("kind in ('READS', 'WRITES')"), symbols)
    own = symbols.select("project_id", F.col("id").alias("from_id"), F.col("language").alias("own"))
    p = p.join(own, ["project_id", "from_id"]).withColumn("dir", folder(F.col("from_file")))
    rank = F.when(F.col("kind") == "Variable", 0).when(F.col("kind") == "Function", 1).when(F.col("kind") == "Method", 2).otherwise(3)
    s = symbols.filter("kind in ('Variable', 'Function', 'Method')")
    by_qn = first_by(s.select("project_id", F.col("qualified_name").alias("to_name"), F.col("language").alias("own"), "id", "kind"), ["project_id", "to_name", "own"], "t1", rank)
    near = first_by(s.select("project_id", F.col("name").alias("to_name"), F.col("language").alias("own"), folder(F.col("file_path")).alias("dir"), "id", "kind"), ["project_id", "to_name", "own", "dir"], "t2", rank)
    p = p.join(by_qn, ["project_id", "to_name", "own"], "left").join(near, ["project_id", "to_name", "own", "dir"], "left")
    p = p.withColumn("to_id", F.coalesce("t1", F.when(~F.contains("to_name", F.lit(".")), F.col("t2"))))
    target = symbols.select("project_id", F.col("id").alias("to_id"), F.col("kind").alias("to_kind"), F.col("name").alias("to_short"))
    p = p.join(target, ["project_id", "to_id"])
    callable_ = F.col("to_kind").isin("Function", "Method")
    field = F.contains("to_name", F.lit(".")) & F.coalesce(F.col("receiver_type") != "", F.lit(False))
    values = _edges(p.filter(callable_ & ~F.col("to_short").isin(list(POLYMORPHIC)) & ~field), "CALLS", F.lit(0.4), "binding_pass")
    return _edges(p.filter("to_kind = 'Variable'")).unionByName(values)


def resolve_references(symbols: DataFrame, pending: DataFrame, prefix: str = "doc:") -> DataFrame:
    """REFERENCES edges between sections of Markdown files: by anchor, or to a file's first section."""
    sections = symbols.filter("kind = 'Section' and language = 'Markdown'").select("project_id", F.col("file_path").alias("file"), "qualified_name", "start_byte", "id")
    first = sections.groupBy("project_id", "file").agg(F.min_by("id", F.struct("start_byte", "id")).alias("first_id"))
    exact = first_by(sections.withColumnRenamed("qualified_name", "anchor"), ["project_id", "file", "anchor"], "exact_id")
    tail = first_by(sections.withColumn("anchor", last_part(F.col("qualified_name"))), ["project_id", "file", "anchor"], "tail_id")
    p = pending.filter("kind = 'REFERENCES'")
    begin = p.withColumn("file", F.col("from_file")).withColumn("anchor", F.when(F.coalesce("from_qn", F.lit("")) == "", "preamble").otherwise(F.col("from_qn")))
    begin = begin.join(exact, ["project_id", "file", "anchor"], "left").join(first, ["project_id", "file"], "left").withColumn("from_id", F.coalesce("exact_id", "first_id")).drop("exact_id", "first_id", "file", "anchor")
    outside = F.col("to_name").startswith(prefix)
    raw = F.regexp_replace("to_name", "^" + prefix, "")
    file = F.when(outside, F.substring_index(raw, "#", 1)).otherwise(F.col("from_file"))
    anchor = F.when(outside, F.when(F.contains(raw, F.lit("#")), F.regexp_replace(raw, "^[^#]*#", "")).otherwise("")).otherwise(F.col("to_name"))
    ends = begin.withColumn("file", file).withColumn("anchor", anchor).withColumn("outside", outside)
    ends = ends.join(exact, ["project_id", "file", "anchor"], "left").join(tail, ["project_id", "file", "anchor"], "left").join(first, ["project_id", "file"], "left")
    to = F.when(F.col("anchor") == "", F.col("first_id")).otherwise(F.coalesce("exact_id", F.when(F.col("outside"), F.col("tail_id"))))
    return _edges(ends.withColumn("to_id", to), "REFERENCES")


def resolve_file_edges(symbols: DataFrame, pending: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """INCLUDES or LOADS edges between files: from and to a module of each file, made where a file has none."""
    modules = first_by(symbols.filter("kind = 'Module'").select("project_id", F.col("file_path").alias("file"), "id"), ["project_id", "file"], "module")
    p = pending.filter(F.col("kind") == kind)
    end = lambda df, column, out: (
        df.withColumn("file", F.col(column)).join(modules, ["project_id", "file"], "left")
        .withColumn(out, F.coalesce("module", S.symbol_id(F.col("file"), F.col("file"), F.lit("Module")))).withColumn(f"{out}_made", F.col("module").isNull()).drop("module", "file")
    )
    found = end(end(p, "from_file", "from_id"), "to_name", "to_id")
    made = lambda i, f: found.filter(f"{i}_made").select("project_id", F.col(i).alias("id"), F.col(f).alias("file_path"), F.lit("Module").alias("kind"))
    return _edges(found, kind), made("from_id", "from_file").union(made("to_id", "to_name")).distinct()


VAR_FILE = r"(^|/)(group_vars|host_vars|vars)/.*\.ya?ml$|/defaults/.*\.ya?ml$"


def resolve_uses_var(symbols: DataFrame, pending: DataFrame) -> DataFrame:
    """USES_VAR edges: from a module of that name, else the file's first symbol, else a module made for it; to a setting in a file of variables."""
    p = pending.filter("kind = 'USES_VAR'")
    module = first_by(symbols.filter("kind = 'Module'").select("project_id", F.col("qualified_name").alias("from_qn"), "id"), ["project_id", "from_qn"], "f0")
    any_ = first_by(symbols.select("project_id", F.col("file_path").alias("from_file"), "id"), ["project_id", "from_file"], "f1")
    settings = symbols.filter((F.col("kind") == "Setting") & F.regexp_replace("file_path", r"\\", "/").rlike(VAR_FILE))
    target = first_by(settings.select("project_id", F.col("name").alias("to_name"), "id"), ["project_id", "to_name"], "to_id")
    p = p.join(module, ["project_id", "from_qn"], "left").join(any_, ["project_id", "from_file"], "left").join(target, ["project_id", "to_name"])
    return _edges(p.withColumn("from_id", F.coalesce("f0", "f1", S.symbol_id(F.col("from_file"), F.col("from_file"), F.lit("Module")))), "USES_VAR")

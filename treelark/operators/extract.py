"""Facts from source text by pattern: imports, exports, variables, markers, events, configuration, purposes.

Every extractor takes files(file, text) and gives rows; alternatives of one pattern are alternatives of one expression, so
that a text is scanned once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t

C_LIKE = (".c", ".cjs", ".go", ".js", ".jsx", ".mjs", ".rs", ".ts", ".tsx")
SCRIPT = (".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx")
PYTHON = (".py", ".pyi")
NAME = "[A-Z][A-Z0-9_]*"
ENV = {
    SCRIPT: rf"""\b(?:(?:process|Bun)\.env\.|import\.meta\.env\.|process\.env\[["']|Deno\.env\.get\(["'])({NAME})\b""",
    (".py",): rf"""\bos\.(?:environ\[|environ\.get\(|getenv\()["']({NAME})["']""",
    (".go",): rf"""\bos\.(?:Getenv|LookupEnv)\(["']({NAME})["']""",
    (".rs",): rf"""\b(?:std::env::var|env!)\(["']({NAME})["']""",
}
COMMON_ENV = ("HOME", "LANG", "NODE_ENV", "PATH", "PWD", "SHELL", "TERM", "USER")
TEST_FILE = r"\.(?:spec|test)\.(?:cjs|go|js|jsx|mjs|py|rs|ts|tsx)\z"
MARKER = r"(?<![A-Za-z0-9_])(FIXME|HACK|TODO|XXX)\b\s*(?:\(([^)]{1,40})\))?\s*:\s*(.+?)(?=\*/|\z)"
NOISY = ("Array", "console", "JSON", "Math", "Object", "Promise", "String")
FRAMEWORKS = (("next", "Next.js"), ("@nestjs/core", "NestJS"), ("@angular/core", "Angular"), ("svelte", "Svelte"), ("vue", "Vue"), ("react", "React"), ("express", "Express"), ("fastify", "Fastify"))


def ext_is(*endings: str) -> Column:
    return t.extension(F.col("file")).isin(*endings)


def without_comments(text: Column, kind: str) -> Column:
    """Block and line comments of C-like text (not the slashes of an address), or # comments."""
    if kind == "python":
        return F.regexp_replace(text, r"(?m)(^|[^$])#.*$", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1")


def stripped(files: DataFrame) -> DataFrame:
    return files.withColumn("text", F.when(ext_is(*C_LIKE), without_comments(F.col("text"), "c")).when(ext_is(*PYTHON), without_comments(F.col("text"), "python")).otherwise(F.col("text")))


def _matches(files: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    return files.select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("match"))


def environment(files: DataFrame) -> DataFrame:
    """(file, name) of environment variables; test files and common names are left out; .env examples give their keys."""
    own = files.where(~F.col("file").rlike(TEST_FILE))
    parts = [_matches(own.where(ext_is(*ends)), p) for ends, p in ENV.items()]
    parts.append(_matches(own.where(t.basename(F.col("file")).isin(".env.example", ".env.template")), rf"(?m)^\s*(?:export\s+)?({NAME})\s*="))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(~F.col("match").isin(*COMMON_ENV)).select("file", F.col("match").alias("name")).distinct()


def markers(files: DataFrame) -> DataFrame:
    """(file, line, marker, author, body) of work markers; those inside a string (an odd number of quotes before) go."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hit = lines.where(F.col("line").rlike(MARKER))
    part = lambda i: F.regexp_extract("line", MARKER, i)
    before = F.split_part("line", F.regexp_extract("line", MARKER, 0), F.lit(1))
    quotes = F.regexp_count(before, F.lit("[\"']"))
    body = F.trim(F.regexp_replace(part(3), r"\*/\s*\z", ""))
    rows = hit.where(quotes % 2 == 0).select("file", (F.col("at") + 1).alias("line"), part(1).alias("marker"), F.nullif(part(2), F.lit("")).alias("author"), body.alias("body"))
    ok = (F.length("body") >= 3) & ~F.startswith("body", F.lit(":")) & ~F.col("body").rlike("^https?://")
    return rows.where(ok).withColumn("body", F.when(F.length("body") > 120, F.concat(F.substring("body", 1, 120), F.lit("…"))).otherwise(F.col("body")))


def events(files: DataFrame) -> DataFrame:
    """(file, label) of event calls; calls on well-known objects are noise."""
    name = r"""\(\s*["']([^"']{1,64})["']"""
    js = stripped(files.where(ext_is(*SCRIPT)))
    named = rf"(\b[A-Za-z_$][A-Za-z0-9_$]*)\.(on|emit|once|addListener|addEventListener){name}"
    bare = r"(\b[A-Za-z_$][A-Za-z0-9_$]*\$?)\.(next|subscribe)\("
    signal = r"\b([A-Za-z_][A-Za-z0-9_]*)\.(send|connect|disconnect)\("

    def rows(source: DataFrame, p: str, third: bool) -> DataFrame:
        each = source.select("file", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
        target, verb = F.regexp_extract("m", p, 1), F.regexp_extract("m", p, 2)
        what = F.concat(F.lit('("'), F.regexp_extract("m", p, 3), F.lit('")')) if third else F.lit("()")
        link = F.when(verb == "addEventListener", " on ").otherwise(" via ")
        return each.where(~target.isin(*NOISY)).select("file", F.concat(verb, what, link, target).alias("label"))

    out = rows(js, named, True).unionByName(rows(js, bare, False)).unionByName(rows(stripped(files.where(ext_is(".py"))), signal, False))
    return out.where(F.length("label") <= 96).distinct()


def internal_dependencies(files: DataFrame) -> DataFrame:
    """(file, target) of relative imports."""
    s = stripped(files)
    js = s.where(ext_is(*SCRIPT))
    out = _matches(js, r"""(?s)import\s+.*?\s+from\s+["'](\.[^"']+)["']""").unionByName(_matches(js, r"""require\(["'](\.[^"']+)["']\)"""))
    out = out.unionByName(_matches(s.where(ext_is(".py")), r"from\s+(\.[a-zA-Z0-9_.]+)\s+import"))
    rust = _matches(s.where(ext_is(".rs")), r"use\s+crate::([a-zA-Z0-9_]+)").withColumn("match", F.concat(F.lit("crate::"), "match"))
    return out.unionByName(rust).select("file", F.col("match").alias("target")).distinct()


def import_bindings(files: DataFrame) -> DataFrame:
    """(file, path, symbols sorted) of named, default, namespace and side-effect imports of relative modules, and of Python's."""
    js = stripped(files.where(ext_is(*SCRIPT)))
    rows = []
    braces = r"""(?s)(?:import|export)\s+(?:type\s+)?(?:[A-Za-z_$][\w$]*\s*,\s*)?\{([^}]*)\}\s*from\s+["'](\.[^"']+)["']"""
    each = js.select("file", F.explode(F.regexp_extract_all("text", F.lit(braces), F.lit(0))).alias("m"))
    names = F.filter(F.transform(F.split(F.regexp_extract("m", braces, 1), ","), lambda x: F.regexp_replace(F.trim(x), r"^type\s+", "")), lambda x: x != "")
    rows.append(each.select("file", F.regexp_extract("m", braces, 2).alias("path"), F.explode(names).alias("symbol")))
    for p, shape in ((r"""import\s+(?!type\b)([A-Za-z_$][\w$]*)\s*(?:,\s*\{[^}]*\}\s*)?from\s+["'](\.[^"']+)["']""", "default as "), (r"""import\s+\*\s+as\s+(\w+)\s+from\s+["'](\.[^"']+)["']""", "* as ")):
        m = js.select("file", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
        rows.append(m.select("file", F.regexp_extract("m", p, 2).alias("path"), F.concat(F.lit(shape), F.regexp_extract("m", p, 1)).alias("symbol")))
    bare = js.select("file", F.explode(F.regexp_extract_all("text", F.lit(r"""import\s+["'](\.[^"']+)["']"""), F.lit(1))).alias("path"))
    rows.append(bare.select("file", "path", F.lit("(side effect)").alias("symbol")))
    py = stripped(files.where(ext_is(".py")))
    p = r"(?m)^\s*from\s+(\.[\w.]*)\s+import\s+\(?([\w\s,*]+?)\)?\s*$"
    m = py.select("file", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
    rows.append(m.select("file", F.regexp_extract("m", p, 1).alias("path"), F.explode(F.filter(F.transform(F.split(F.regexp_extract("m", p, 2), ","), lambda s: F.trim(s)), lambda x: x != "")).alias("symbol")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("file", "path").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


_EXPORTS = {
    SCRIPT: r"(?m)^export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)",
    (".py",): r"(?m)^(?:async\s+)?(?:def|class)\s+([A-Za-z][\w]*)",
    (".go",): r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Z]\w*)",
    (".rs",): r"(?m)^pub(?:\([^)]*\))?\s+(?:async\s+)?(?:fn|struct|enum|trait|const|type|mod)\s+([A-Za-z_]\w*)",
}
_DECLARED = {SCRIPT: r"(?m)^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const)\s+([A-Za-z_$][\w$]*)", (".py",): r"(?m)^(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)", (".go",): r"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)([A-Za-z]\w*)", (".rs",): r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_]\w*)"}


def _declared(files: DataFrame, patterns: dict) -> DataFrame:
    out = None
    for ends, p in patterns.items():
        part = _matches(files.where(ext_is(*ends)), p).select("file", F.col("match").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def exports(files: DataFrame) -> DataFrame:
    return _declared(stripped(files), _EXPORTS)


def internals(files: DataFrame) -> DataFrame:
    """Declarations that aren't exports."""
    return _declared(stripped(files), _DECLARED).join(exports(files), ["file", "name"], "left_anti")


def data_models(files: DataFrame) -> DataFrame:
    """(file, name, fields): interfaces, object types and typed classes, 8 fields each, types cut at 40 characters."""
    js = stripped(files.where(ext_is(".ts", ".tsx")))
    p = r"(?s)\b(?:interface|class|type)\s+([A-Z]\w*)[^{;=]*=?\s*\{([^{}]*)\}"
    m = js.select("file", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m"))
    field = r"(?:^|[;\n])\s*(?:readonly\s+|public\s+|private\s+)*([A-Za-z_]\w*\??\s*:\s*[^;,\n]{1,40})"
    ts = m.select("file", F.regexp_extract("m", p, 1).alias("name"), F.slice(F.transform(F.regexp_extract_all(F.regexp_extract("m", p, 2), F.lit(field), F.lit(1)), lambda s: F.trim(s)), 1, k.CAPS["model_fields"]).alias("fields"))
    q = r"(?m)^(?:@(?:dataclass|attr\.s|define)[^\n]*\n)?class\s+([A-Z]\w*)[^\n]*:\n((?:[ \t]+[^\n]*\n|\n)+)"
    n = files.where(ext_is(".py")).select("file", F.explode(F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(q), F.lit(0))).alias("m"))
    py = n.select("file", F.regexp_extract("m", q, 1).alias("name"), F.slice(F.transform(F.regexp_extract_all(F.regexp_extract("m", q, 2), F.lit(r"(?m)^[ \t]+([a-z_]\w*\s*:\s*[^=\n#]{1,40})"), F.lit(1)), lambda s: F.trim(s)), 1, k.CAPS["model_fields"]).alias("fields"))
    return ts.unionByName(py).where(F.size("fields") > 0)


def requirements(files: DataFrame) -> DataFrame:
    """(dir, source, packages): the first manifest that lists some, at most 30 packages."""
    base = t.basename(F.col("file"))
    js = F.concat(F.coalesce(F.json_object_keys(F.get_json_object("text", "$.dependencies")), F.array().cast("array<string>")), F.coalesce(F.json_object_keys(F.get_json_object("text", "$.devDependencies")), F.array().cast("array<string>")))
    kinds = [("package.json", js), ("requirements.txt", F.regexp_extract_all("text", F.lit(r"(?m)^\s*([A-Za-z0-9][\w.\-]*)"), F.lit(1))), ("Cargo.toml", F.regexp_extract_all(F.regexp_extract("text", r"(?s)\[dependencies\](.*?)(?:\n\[|\z)", 1), F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="), F.lit(1))), ("go.mod", F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)+)\s+v"), F.lit(1)))]
    rank, found = F.lit(9), F.array().cast("array<string>")
    for i, (name, e) in reversed(list(enumerate(kinds))):
        rank, found = F.when(base == name, i).otherwise(rank), F.when(base == name, e).otherwise(found)
    rows = files.where(base.isin(*(n for n, _ in kinds))).select(t.dirname(F.col("file")).alias("dir"), base.alias("source"), rank.alias("rank"), F.slice(found, 1, 30).alias("packages")).where(F.size("packages") > 0)
    return rows.groupBy("dir").agg(F.min_by(F.struct("source", "packages"), "rank").alias("x")).select("dir", "x.source", "x.packages")


def framework(packages: Column) -> Column:
    """The framework of highest priority among packages."""
    out = F.lit(None).cast("string")
    for name, label in reversed(FRAMEWORKS):
        out = F.when(F.array_contains(packages, name), label).otherwise(out)
    return out


def config_facts(files: DataFrame) -> DataFrame:
    """(dir, fact) from well-known configuration files."""
    base, text = t.basename(F.col("file")), F.col("text")
    known = {"tsconfig.json": "TypeScript", ".eslintrc.json": "ESLint", "eslint.config.js": "ESLint", ".prettierrc": "Prettier", "vite.config.ts": "Vite", "webpack.config.js": "webpack", "Dockerfile": "Docker", "Makefile": "make", "pyproject.toml": "pyproject", "tox.ini": "tox", "package-lock.json": "npm lockfile", "yarn.lock": "yarn lockfile", "pnpm-lock.yaml": "pnpm lockfile", "poetry.lock": "poetry lockfile", "Cargo.lock": "cargo lockfile", "go.sum": "go sums"}
    label = F.lit(None).cast("string")
    for n, v in known.items():
        label = F.when(base == n, v).otherwise(label)
    facts = F.array_compact(F.array(label, F.when((base == "tsconfig.json") & text.rlike(r'"strict"\s*:\s*true'), "TypeScript strict"), F.when(base == ".nvmrc", F.concat(F.lit("node "), F.regexp_extract(text, r"\S+", 0))), F.when(base == ".python-version", F.concat(F.lit("python "), F.regexp_extract(text, r"\S+", 0)))))
    return files.select(t.dirname(F.col("file")).alias("dir"), F.explode(facts).alias("fact")).distinct()


def testing_facts(files: DataFrame) -> DataFrame:
    """(dir, fact): frameworks named in manifests, their configuration files, and how tests are named."""
    base = t.basename(F.col("file"))
    tools = ("ava", "cypress", "jest", "mocha", "playwright", "pytest", "vitest")
    manifest = base.isin("package.json", "pyproject.toml", "requirements.txt")
    facts = F.array_compact(F.array(*(F.when(manifest & F.col("text").rlike(rf"\b{x}\b"), f"framework {x}") for x in tools), *(F.when(base.rlike(rf"^{x}\.config\.|^{x}\.ini\z"), f"configured {x}") for x in tools), F.when(base.rlike(r"\.(test|spec)\.[jt]sx?\z"), "name.test files"), F.when(base.rlike(r"^test_.*\.py\z"), "test_name files"), F.when(base.rlike(r"_test\.go\z"), "name_test files")))
    return files.select(t.dirname(F.col("file")).alias("dir"), F.explode(facts).alias("fact")).distinct()


def is_test(file: Column) -> Column:
    return t.basename(file).rlike(r"[._-](test|spec)\.|^test_|_test\.") | file.rlike(r"(^|/)(__tests__|tests?|spec)/")


def purpose(file: Column) -> Column:
    """What a file is for, by its name."""
    base = F.lower(F.regexp_replace(t.basename(file), r"\.[^.]*$", ""))
    return (
        F.when(is_test(file), "tests").when(base.isin("index", "main", "mod", "__init__", "app", "lib"), "entry point").when(base.rlike("types?$|schema|models?$"), "type definitions").when(base.rlike("config|settings"), "configuration")
        .when(base.rlike("utils?|helpers?"), "utilities").when(base.rlike("constants?"), "constants").when(base.rlike("routes?|router|controller|handler"), "request handling").when(t.extension(file).isin(".md", ".rst", ".txt"), "documentation").otherwise("source")
    )


_DIRS = {"api": "API endpoints", "assets": "static assets", "bin": "executables", "cli": "command line", "commands": "commands", "components": "interface components", "config": "configuration", "core": "core logic", "db": "database access", "docs": "documentation", "hooks": "hooks", "i18n": "translations", "lib": "library code", "middleware": "middleware", "migrations": "schema migrations", "models": "data models", "pages": "pages", "routes": "routes", "schemas": "schemas", "scripts": "scripts", "services": "services", "src": "source code", "store": "state", "styles": "styles", "templates": "templates", "test": "tests", "tests": "tests", "types": "type definitions", "utils": "utilities", "views": "views"}


def summaries(files: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """(dir, summary, source): a project's description, the entry file's leading comment, the directory's name, what most
    files are for (half or more), or a count."""
    base = F.regexp_replace(t.basename(F.col("file")), r"\.[^.]*$", "")
    doc = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("text", r'(?s)\A\s*(?:"""|/\*\*?)\s*(.*?)(?:\n|"""|\*/)', 1), F.lit("")), F.lit("")), r"^\*\s*", ""))
    entry = F.when(base.isin("index", "main", "mod", "__init__", "lib"), F.nullif(doc, F.lit("")))
    kind = F.when(purpose(F.col("file")) != "source", purpose(F.col("file")))
    per = files.select(t.dirname(F.col("file")).alias("dir"), entry.alias("entry"), kind.alias("kind"), F.col("file"))
    agg = per.groupBy("dir").agg(F.count("*").alias("n"), F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("file"))).alias("entry"), F.mode("kind", True).alias("kind"))
    most = per.join(agg.select("dir", F.col("kind").alias("k")), "dir").groupBy("dir").agg(F.count_if(F.col("kind") == F.col("k")).alias("m"))
    named = F.lit(None).cast("string")
    for name, v in _DIRS.items():
        named = F.when(F.lower(t.basename(F.col("dir"))) == name, v).otherwise(named)
    rows = agg.join(most, "dir").join(described if described is not None else files.sparkSession.createDataFrame([], "dir string, description string"), "dir", "left")
    major = F.when(F.col("m") * 2 >= F.col("n"), F.concat(F.lit("mostly "), "kind"))
    back = F.concat(F.col("n").cast("string"), F.lit(" files"))
    return rows.select("dir", F.coalesce("description", "entry", named, major, back).alias("summary"), F.when(F.col("description").isNotNull(), "project").when(F.col("entry").isNotNull(), "docstring").when(named.isNotNull(), "name").when(major.isNotNull(), "pattern").otherwise("fallback").alias("source"))


def hrefs(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def assemble(fresh: DataFrame, authored: DataFrame, derived: list[str]) -> DataFrame:
    """Scope records from extracted facts; fields a person wrote stay; derived_fields lists those that were filled in."""
    names = [c for c in fresh.columns if c != "scope"]
    a = authored.select("scope", *(F.col(c).alias(f"_{c}") for c in names if c in authored.columns))
    j = fresh.join(a, "scope", "full")
    pick = [F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if f"_{c}" in a.columns else F.col(c) for c in names]
    filled = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & (F.col(f"_{c}").isNull() if f"_{c}" in a.columns else F.lit(True)), c) for c in names if c in derived)))
    return j.select("scope", *pick, filled.alias("derived_fields"))


def overlay(machine: DataFrame, generated: DataFrame, machine_wins: list[str]) -> DataFrame:
    """Generated text over machine facts: the listed fields keep the machine's value where it has one."""
    names = [c for c in machine.columns if c != "scope"]
    g = generated.select("scope", *(F.col(c).alias(f"_{c}") for c in names if c in generated.columns))
    pick = [F.col(c) if f"_{c}" not in g.columns else (F.coalesce(F.col(c), F.col(f"_{c}")) if c in machine_wins else F.coalesce(F.col(f"_{c}"), F.col(c))).alias(c) for c in names]
    return machine.join(g, "scope", "left").select("scope", *pick)


def prompt(scope: Column, parts: list[Column], limit: int = 8000) -> Column:
    """A generator's input, cut at a number of characters."""
    return F.substring(F.concat_ws("\n\n", F.concat(F.lit("Directory "), scope), *parts), 1, limit)

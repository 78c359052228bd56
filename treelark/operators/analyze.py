"""Symbols, imports and import-bound references of source files.

Python is read with the standard parser; TypeScript and JavaScript with a tokenizer and a stack of scopes. A file's rows are
its own business, so the work is a mapInArrow over (file, text): no shuffle, a file's memory at a time.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text as t
from . import graph

SCHEMA = "file string, row string, name string, kind string, exported boolean, line int, end_line int, at long, raw string, signature string, lang string, mode string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
SCRIPT = (".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx")


def _row(file: str, row: str, **c) -> dict:
    return {n: None for n in _NAMES} | {"file": file, "row": row} | c


def python_rows(file: str, text: str) -> Iterator[dict]:
    """Top-level functions and classes, import edges, and uses of names that an import binds."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield _row(file, "error", lang="python", mode="parse_error")
        return
    starts = [0]
    for x in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(x.encode()))
    place = lambda n: starts[n.lineno - 1] + n.col_offset
    for n in tree.body:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            head = text.splitlines()[n.lineno - 1].strip().rstrip(":")
            yield _row(file, "symbol", name=n.name, kind="class" if isinstance(n, ast.ClassDef) else "function", exported=not n.name.startswith("_"), line=n.lineno, end_line=n.end_lineno, at=place(n), signature=head, lang="python")
    bound: dict[str, tuple[str, str]] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            raw = "." * n.level + (n.module or "")
            yield _row(file, "import", raw=raw, name=",".join(a.name for a in n.names), kind="py_from", line=n.lineno, lang="python")
            if n in tree.body:
                bound |= {a.asname or a.name: (raw, a.name) for a in n.names if a.name != "*"}
        elif isinstance(n, ast.Import):
            for a in n.names:
                yield _row(file, "import", raw=a.name, name="", kind="py_import", line=n.lineno, lang="python")

    def binds(body: list) -> set[str]:
        """Names bound in a function or class body, not in those inside it."""
        out, todo = set(), list(body)
        while todo:
            n = todo.pop()
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.add(n.name)
                continue
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del):
                out.add(n.id)
            elif isinstance(n, ast.ImportFrom | ast.Import):
                out |= {(a.asname or a.name).split(".")[0] for a in n.names}
            elif isinstance(n, ast.ExceptHandler) and n.name:
                out.add(n.name)
            elif isinstance(n, ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                continue
            todo += list(ast.iter_child_nodes(n))
        return out

    def visit(n: ast.AST, hidden: frozenset) -> Iterator[dict]:
        if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in bound and n.id not in hidden:
            raw, name = bound[n.id]
            yield _row(file, "reference", name=name, raw=raw, line=n.lineno, at=place(n), kind="identifier_use", lang="python")
            return
        inner = hidden
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            a = n.args
            outside = [*a.defaults, *[d for d in a.kw_defaults if d], *getattr(n, "decorator_list", []), *[x.annotation for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x is not None and x.annotation], *([n.returns] if getattr(n, "returns", None) else [])]
            for x in outside:
                yield from visit(x, hidden)
            inner = hidden | {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x is not None} | (binds(n.body) if isinstance(n.body, list) else set())
            for x in n.body if isinstance(n.body, list) else [n.body]:
                yield from visit(x, inner)
            return
        if isinstance(n, ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            inner = hidden | {x.id for g in n.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
        elif isinstance(n, ast.ClassDef):
            inner = hidden | binds(n.body)
        for x in ast.iter_child_nodes(n):
            yield from visit(x, inner)

    top = binds([n for n in tree.body if not isinstance(n, ast.ImportFrom | ast.Import)])
    for n in tree.body:
        if not isinstance(n, ast.ImportFrom | ast.Import):
            yield from visit(n, frozenset(top))


_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<dots>\.\.\.)|(?P<mark>.)""", re.S)
_KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "const"}


def script_rows(file: str, text: str) -> Iterator[dict]:
    """Declarations at the top, imports and re-exports, and uses of names that an import binds and no inner scope hides."""
    tokens = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "template":  # code inside ${} counts
            for inner in re.finditer(r"\$\{([^{}`]*)\}", m.group()):
                tokens += [(x.lastgroup, x.group(), m.start() + inner.start(1) + x.start()) for x in _TOKEN.finditer(inner.group(1)) if x.lastgroup != "skip"]
        elif m.lastgroup != "skip":
            tokens.append((m.lastgroup, m.group(), m.start()))
    lines = [i for i, ch in enumerate(text) if ch == "\n"]
    from bisect import bisect_left

    line = lambda at: bisect_left(lines, at) + 1
    offset = lambda at: len(text[:at].encode())
    word = lambda i: tokens[i][1] if 0 <= i < len(tokens) else ""
    bound: dict[str, tuple[str, str]] = {}
    skip: set[int] = set()

    def clause(i: int) -> tuple[list[tuple[str, str]], int]:
        """Names in braces from token i on: (imported, local), and where they end."""
        out, i = [], i + 1
        while i < len(tokens) and word(i) != "}":
            if word(i) == "type" and tokens[i + 1][0] == "name" and word(i + 1) != "as":
                i += 1
            name = local = word(i)
            if word(i + 1) == "as":
                local = word(i + 2)
                i += 2
            if name != ",":
                out.append((name, local))
            i += 1
            if word(i) == ",":
                i += 1
        return out, i

    i = depth = 0
    while i < len(tokens):
        kind, w, at = tokens[i]
        depth += (w in "{([" and kind == "mark") - (w in "})]" and kind == "mark")
        if depth == 0 and w == "import" and word(i + 1) not in ("(", "."):
            j, names, shape = i + 1, [], "es_import"
            if word(j) == "type" and word(j + 1) != "from":
                j, shape = j + 1, "es_import_type"
            if tokens[j][0] == "name" and word(j) != "from":
                names.append(("default", word(j)))
                j += 1 + (word(j + 1) == ",")
            if word(j) == "*":
                names.append(("*", word(j + 2)))
                j += 3
            elif word(j) == "{":
                more, j = clause(j)
                names, j = names + more, j + 1
            if word(j) == "from":
                j += 1
            if j < len(tokens) and tokens[j][0] == "string":
                raw = word(j)[1:-1]
                yield _row(file, "import", raw=raw, name=",".join(n for n, _ in names), kind=shape if names else "es_side_effect", line=line(at), lang="ts")
                bound |= {local: (raw, name) for name, local in names if name != "*"}
                skip |= set(range(i, j + 1))
                i = j + 1
                continue
        elif depth == 0 and w == "export":
            j = i + 1 + (word(i + 1) == "type" and word(i + 2) in "{*")
            if word(j) in ("{", "*"):
                names = []
                end = j
                if word(j) == "{":
                    names, end = clause(j)
                elif word(j + 1) == "as":
                    end = j + 2
                if word(end + 1) == "from" and tokens[end + 2][0] == "string":
                    raw = word(end + 2)[1:-1]
                    yield _row(file, "import", raw=raw, name=",".join(n for n, _ in names) or "*", kind="es_reexport", line=line(at), lang="ts")
                    for name, _ in names:
                        yield _row(file, "reference", name=name, raw=raw, line=line(at), at=offset(tokens[j][2]), kind="identifier_use", lang="ts")
                    skip |= set(range(i, end + 3))
                    i = end + 3
                    continue
                for name, local in names:
                    yield _row(file, "symbol", name=local, kind="const", exported=True, line=line(at), end_line=line(at), at=offset(at), signature=f"export {{ {name} }}", lang="ts")
            else:
                j += word(j) == "default"
                default = word(j - 1) == "default"
                while word(j) in ("async", "abstract", "declare"):
                    j += 1
                if word(j) in _KINDS:
                    n = j + 1 + (word(j + 1) == "*") + (word(j) == "const" and word(j + 1) == "enum")
                    name = word(n) if tokens[n][0] == "name" else "default"
                    head = re.split(r"\{|=>|=(?!=)|\n", text[at:], maxsplit=1)[0].strip()
                    yield _row(file, "symbol", name=name, kind=_KINDS[word(j)], exported=True, line=line(at), end_line=line(at), at=offset(tokens[min(n, len(tokens) - 1)][2]), signature=head, lang="ts")
                    if default and name != "default":
                        yield _row(file, "symbol", name="default", kind="default", exported=True, line=line(at), end_line=line(at), at=offset(at), signature=head, lang="ts")
                elif default:
                    yield _row(file, "symbol", name="default", kind="default", exported=True, line=line(at), end_line=line(at), at=offset(at), signature="export default", lang="ts")
        elif depth == 0 and w in _KINDS and word(i - 1) not in ("export", "default", "async", ".") and i + 1 < len(tokens) and tokens[i + 1][0] == "name" and kind == "name":
            yield _row(file, "symbol", name=word(i + 1), kind=_KINDS[w], exported=False, line=line(at), end_line=line(at), at=offset(tokens[i + 1][2]), signature=re.split(r"\{|=>|=(?!=)|\n", text[at:], maxsplit=1)[0].strip(), lang="ts")
        i += 1

    # scopes: every brace opens one; names declared in it, and parameters before it, hide imports inside it
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, (kind, w, _) in enumerate(tokens):
        if kind == "mark" and w in "({[":
            stack.append(i)
        elif kind == "mark" and w in ")}]" and stack:
            match[stack.pop()] = i
    close_to_open = {b: a for a, b in match.items()}
    hidden: list[tuple[int, int, str]] = []
    braces = sorted((a, b) for a, b in match.items() if tokens[a][1] == "{")

    def enclosing(i: int) -> tuple[int, int]:
        best = (-1, len(tokens))
        for a, b in braces:
            if a > i:
                break
            if a < i < b:
                best = (a, b)
        return best

    for i, (kind, w, _) in enumerate(tokens):
        if i in skip or kind != "name" or w not in bound:
            continue
        before = word(i - 1)
        if before in ("const", "let", "var", "function", "class"):
            hidden.append((*enclosing(i), w))
    for a, b in match.items():
        if tokens[a][1] != "(":
            continue
        after = b + 1
        if word(after) == ":":  # a return type
            while after < len(tokens) and word(after) not in ("{", "=>", ";", ",", ")"):
                after += 1
        if word(after) == "=>":
            start = after + 1
            end = match.get(start, None) if word(start) in "{([" and word(start) else None
            span = (a, end if end is not None else next((j for j in range(start, len(tokens)) if word(j) in (";", ")", ",")), len(tokens)))
        elif word(after) == "{" and word(a - 1) not in ("if", "for", "while", "switch", "catch", "with"):
            span = (a, match.get(after, len(tokens)))
        elif word(a - 1) == "catch":
            span = (a, match.get(after, len(tokens)))
        else:
            continue
        for j in range(a + 1, b):
            if tokens[j][0] == "name" and tokens[j][1] in bound and word(j - 1) in ("(", ",", "...", "{", "[") and word(j + 1) in (")", ",", ":", "?", "=", "}", "]"):
                hidden.append((*span, tokens[j][1]))
                skip.add(j)
    for i, (kind, w, at) in enumerate(tokens):
        if kind != "name" or w not in bound or i in skip or word(i - 1) in (".", "const", "let", "var", "function", "class"):
            continue
        if word(i + 1) == ":" and word(i - 1) in ("{", ",") and not close_to_open.get(i - 1):
            continue  # a property's key
        if any(a < i < b and name == w for a, b, name in hidden):
            continue
        raw, name = bound[w]
        yield _row(file, "reference", name=name, raw=raw, line=line(at), at=offset(at), kind="identifier_use", lang="ts")


def analyze(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA (row: symbol, import, reference or error) of files(file, text); other languages give none."""

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not file or text is None:
                    continue
                if file.endswith((".py", ".pyi")):
                    out += python_rows(file, text)
                elif file.endswith(SCRIPT):
                    out += script_rows(file, text)
            if out:
                kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds[c.split()[1]]) for n, c in zip(_NAMES, SCHEMA.split(", "))], names=_NAMES)

    return files.select("file", "text").mapInArrow(run, SCHEMA)


def build_index(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports (resolved), references (by symbol id) and dir_edges of a source tree's files(file, text)."""
    from pyspark.sql import functions as F

    rows = analyze(files)
    symbols = rows.where("row = 'symbol'").select(F.concat("file", F.lit("#"), "name", F.lit("@"), F.col("at").cast("string")).alias("id"), "file", "name", "kind", "exported", "line", "end_line", "at", "signature", "lang")
    edges = rows.where("row = 'import'").select(F.col("file").alias("from_file"), "raw", F.when(F.col("name") == "", F.array().cast("array<string>")).otherwise(F.split("name", ",")).alias("symbols"), "kind", "line", "lang")
    script = graph.resolve(edges.where("lang = 'ts' AND startswith(raw, '.')"), files, graph.script_candidates(F.col("from_file"), F.col("raw")))
    python = graph.resolve(edges.where("lang = 'python'"), files, graph.python_candidates(F.col("from_file"), F.col("raw")))
    other = edges.where("lang = 'ts' AND NOT startswith(raw, '.')").withColumn("resolved_to", F.lit(None).cast("string"))
    imports = script.unionByName(python).unionByName(other).withColumns({"from_dir": t.dirname(F.col("from_file")), "to_dir": t.dirname(F.col("resolved_to"))})
    tentative = rows.where("row = 'reference'").select("file", "raw", "name", "at")
    return {"symbols": symbols, "imports": imports, "references": graph.backfill(tentative, imports, symbols), "dir_edges": graph.dir_edges(imports)}

"""Labelled cases: names used through an import, by target file and symbol."""

import collections

from treelark.operators import analyze

TS = {
    "math.ts": "export function add(a: number, b: number) { return a + b }\nexport const scale = 2\nexport default class Engine {}\nexport interface Shape { side: number }\n",
    "text.ts": "export function upper(s: string): string { return s }\n",
}
PY = {"core.py": "def add(a, b):\n    return a + b\n\nclass Box:\n    pass\n\ndef _own():\n    pass\n", "words.py": "def upper(s):\n    return s\n"}
TS_CASES = {
    "plain.ts": ("import { add } from './math'\nadd(1, 2)\n", {("math.ts", "add"): 1}),
    "alias.ts": ("import { add as plus, scale as k } from './math'\nplus(k, 1)\n", {("math.ts", "add"): 1, ("math.ts", "scale"): 1}),
    "default.ts": ("import Engine from './math'\nconst e = new Engine()\n", {("math.ts", "default"): 1}),
    "space.ts": ("import * as m from './math'\nm.add(1, 2)\n", {}),
    "shadow.ts": ("import { add } from './math'\nfunction inner(add: number) { return add + 1 }\nconst f = () => { const add = 3; return add }\nadd(1, 2)\n", {("math.ts", "add"): 1}),
    "again.ts": ("export { upper } from './text'\n", {("text.ts", "upper"): 1}),
    "side.ts": ("import './math'\n", {}),
    "types.ts": ("import type { Shape } from './math'\nlet s: Shape\n", {("math.ts", "Shape"): 1}),
    "strings.ts": ("import { add } from './math'\nconst s = 'add'; // add\n/* add */ add(1, `${s} add`)\n", {("math.ts", "add"): 1}),
    "unused.ts": ("import { add } from './math'\n", {}),
    "three.ts": ("import { add } from './math'\nconst o = { add: add(1, 2) }\nexport const t = add(o.add, `${add(1, 1)}`)\n", {("math.ts", "add"): 3}),
}
PY_CASES = {
    "plain.py": ("from core import add\nadd(1, 2)\n", {("core.py", "add"): 1}),
    "alias.py": ("from core import add as plus\nplus(1, 2)\n", {("core.py", "add"): 1}),
    "module.py": ("import core\ncore.add(1, 2)\n", {}),
    "shadow.py": ("from core import add\ndef f(add):\n    return add\nadd(1, 2)\n", {("core.py", "add"): 1}),
    "star.py": ("from core import *\nadd(1, 2)\n", {}),
    "hint.py": ("from core import Box\ndef f(b: Box) -> Box:\n    return b\n", {("core.py", "Box"): 2}),
    "doc.py": ('from core import add\n"""add"""\nadd(1, 2)  # add\n', {("core.py", "add"): 1}),
    "unused.py": ("from core import add\n", {}),
}


def _found(spark, sources):
    files = spark.createDataFrame([(f, x) for f, x in sources.items()], "file string, text string")
    index = analyze.build_index(files)
    got = index["references"].join(index["symbols"].selectExpr("id AS symbol_id", "file AS target", "name"), "symbol_id")
    out = collections.defaultdict(collections.Counter)
    for r in got.select("file", "target", "name").collect():
        out[r.file][(r.target, r.name)] += 1
    return index, out


def _rates(found, cases):
    hit = sum(min(n, found[f][k]) for f, (_, want) in cases.items() for k, n in want.items())
    actual = sum(sum(found[f].values()) for f in cases)
    return hit / max(actual, 1), hit / sum(sum(w.values()) for _, w in cases.values())


def test_script_references(spark):
    index, found = _found(spark, TS | {f: x for f, (x, _) in TS_CASES.items()})
    precision, recall = _rates(found, TS_CASES)
    assert precision >= 0.95 and recall >= 0.7, found
    names = {(r.name, r.kind, r.exported) for r in index["symbols"].where("file = 'math.ts'").collect()}
    assert names == {("add", "function", True), ("scale", "const", True), ("Engine", "class", True), ("default", "default", True), ("Shape", "interface", True)}


def test_python_references(spark):
    index, found = _found(spark, PY | {f: x for f, (x, _) in PY_CASES.items()})
    precision, recall = _rates(found, PY_CASES)
    assert precision >= 0.9 and recall >= 0.7, found
    names = {(r.name, r.exported) for r in index["symbols"].where("file = 'core.py'").collect()}
    assert names == {("add", True), ("Box", True), ("_own", False)}


def test_broken_files_are_reported(spark):
    files = spark.createDataFrame([("a.py", "def ("), ("b.ts", "import {"), ("c.go", "package x"), ("d.py", None)], "file string, text string")
    assert [(r.file, r.mode) for r in analyze.analyze(files).where("row = 'error'").collect()] == [("a.py", "parse_error")]

"""TypeScript facts: lexing, resolution and odd files."""

import time

import pytest

from graphloom.operators.typescript import blanked, symbols_of, typescript_facts


def facts(text, kind):
    return [f for f in symbols_of(text, "r:a.ts", "a.ts") if f["kind"] == kind]


@pytest.mark.parametrize("text", ["", "}", "((", "`${", "'", "/*", "class A {", "class", "function f(", "import x from 'y", "const f = (", "a = b / c / d"])
def test_broken_files(text):
    assert len(blanked(text)) == len(text)
    symbols_of(text, "r:a.ts", "a.ts")


def test_blanked_keeps_code():
    text = "a('x{'); // }\n/* { \n */ b = `q ${ c({}) + `in ${d}` } }` + /[/}]\\//g.e / f;"
    got = blanked(text)
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    assert "".join(got.split()) == "a();b=c({})+d+.e/f;"


def test_complexity_is_capped():
    assert facts("function f() { " + "if (a) {} " * 80 + "}", "Function")[0]["complexity"] == 50


def test_names_in_nested_scopes_are_no_symbols():
    assert [f["name"] for f in facts("function f() { function g() {} const h = () => 1; class K {} }", "Function")] == ["f"]


def test_unknown_callees_have_no_edge():
    assert facts("import { a } from 'm';\nfunction f() { z(); b.c(); if (x) {} a(); a(); new Q(); }", "CALLS") == [
        {"kind": "CALLS", "owner": "r:fn:a.ts:f@2", "target": "a@m", "resolved": False}
    ]


def test_time_is_linear():
    unit = "export class C%d extends B { m(a: string): void { if (a) { this.m(`x${a}`); } } }\nconst f%d = (a: T) => a.b(c);\n"
    began = time.time()
    assert len(facts("".join(unit % (i, i) for i in range(3000)), "Class")) == 3000
    assert time.time() - began < 30


def test_files_without_facts(spark):
    files = spark.createDataFrame([("r", "a.ts", None), ("r", "b.ts", ""), ("r", "c.py", "class A: pass"), ("r", "d.js", "class A {}"), ("r", None, "class A {}")], "repo_url string, path string, content string")
    assert [(r["path"], r["name"]) for r in typescript_facts(files).collect()] == [("d.js", "A")]

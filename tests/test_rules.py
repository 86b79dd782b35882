"""Smells, security rules, quality and docstring tools on hand-written texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusreview import constants as K
from corpusreview.operators import js_structure as JS
from corpusreview.operators import metrics as M
from corpusreview.operators import prompts
from corpusreview.operators import quality as Q
from corpusreview.operators import security as SEC
from corpusreview.operators import smells as SM
from tests.conftest import values


def numbers(files, line, name="a.java"):
    out = SM.line_smell(files({name: line}), SM.magic_number)
    return [re.search(r"number (\S+) ", r["description"]).group(1) for r in out.collect()]


@pytest.mark.parametrize(
    "line, want",
    [
        ("x = 10", []), ("x=10", ["10"]), ("x ==  42", ["42"]), ("f(1, 2, 10)", ["10"]), ("y * 1.25", ["25"]),
        ("0x44 55px 1_000", []), ("# 99", []), ("  // 99", []), ("/* 99", []), ("* 99", []), ("a 12 13;14", ["12", "13", "14"]),
        ("s = 'call 911'", ["911"]), ("x = 10 + 20", ["20"]), ("٤٢", ["٤٢"]), ("5", []),
    ],
)
def test_magic_number(files, line, want):
    assert numbers(files, line) == want


def test_line_rules_by_language(files):
    code = "var x = 1;\n// console.log var y\nconsole.log(1); var z = 2;\n  * var q\nvariable = 1"
    out = SM.all_smells(files({"a.js": code, "b.java": code, "c.py": "var x = 1"}))
    got = sorted((r["path"], r["rule"], r["line"]) for r in out.collect())
    assert got == [("a.js", "console_log", 3), ("a.js", "var_usage", 1), ("a.js", "var_usage", 3)]


def test_long_file(files):
    out = SM.all_smells(files({"a.java": "x\n" * 300, "b.java": "x\n" * 301}))
    assert [tuple(r) for r in out.collect()] == [
        ("r", "b.java", "long_file", 1, "warning", "File is 301 lines long (>300). Consider splitting.")
    ]


def scan(files, code):
    return [(r["type"], r["line"], r["match"]) for r in SEC.security_scan(files({"a.py": code})).orderBy("seq").collect()]


def test_security_rules(files):
    code = (
        'password = "0123456789"\nAPI_KEY =\n  \'abcdefghij-+_\'\ntoken = "short"\n'
        "eval(x); exec(y)\nretrieval(x)\nsubprocess.Popen(c, shell = True)\nchild_process.exec(q)\n"
        "rows = updated + delta\nq = 'select a' + b\nSELECT\n+ x\npickle.loads(b); yaml.load(s); yaml.safe_load(s)"
    )
    assert scan(files, code) == [
        ("hardcoded_secret", 1, 'password = "0123456789"'),
        ("hardcoded_secret", 2, "API_KEY =\n  'abcdefghij-+_'"),
        ("unsafe_execution", 5, "eval"),
        ("unsafe_execution", 5, "exec"),
        ("unsafe_execution", 7, "subprocess.Popen(c, shell = True"),
        ("unsafe_execution", 8, "child_process.exec"),
        ("sql_injection", 9, "update" + "d + "),
        ("sql_injection", 10, "select a' + "),
        ("insecure_deserialization", 13, "pickle.loads"),
        ("insecure_deserialization", 13, "yaml.load"),
    ]


def test_security_matches_are_cut(files):
    code = 'secret = "' + "a" * 80 + '"'
    assert [len(m) for _, _, m in scan(files, code)] == [K.MATCH_CHARS]


def test_security_equals_a_plain_loop(files):
    """Random texts against a direct loop over matches."""
    rng = random.Random(3)
    words = ["eval", "exec(", "password", " = ", "'abcdefghijkl'", "\n", "\n\n", "SELECT", "+", "x", " ", "yaml.load", "é", ".", "\r"]
    texts = {f"f{i}.py": "".join(rng.choices(words, k=rng.randint(0, 60))) for i in range(150)}
    out = SEC.security_scan(files(texts)).collect()
    got = sorted((r["path"], r["seq"], r["type"], r["line"], r["match"]) for r in out)
    want = []
    for path, code in texts.items():
        n = 0
        for name, pattern in K.SECURITY_RULES:
            python = re.compile(re.sub(r"^\(\?(i?)[a-zA-Z]*\)", lambda m: "(?i)" if m.group(1) else "", pattern))
            for m in python.finditer(code):
                n += 1
                want.append((path, n, name, code.count("\n", 0, m.start()) + 1, m.group(0)[:50]))
    assert got == sorted(want)


def test_sql_rule_is_linear_on_one_line(files):
    import time

    scan(files, "warm")
    start = time.perf_counter()
    assert scan(files, "select " * 7000) == []
    assert len(scan(files, "select " * 7000 + "+ x")) == 1
    assert time.perf_counter() - start < 6


def test_code_quality(files):
    code = "x" * 121 + " TODO\nok\n# FIXME\n# todo"
    out = {r["path"]: r for r in Q.code_quality(files({"a.py": code, "b.py": '"""doc"""', "c.py": ""})).collect()}
    assert out["a.py"]["issues_detected"] == [
        "Line 1 exceeds 120 characters (126 chars).",
        "Line 1 contains developer comment placeholder (TODO/FIXME).",
        "Line 3 contains developer comment placeholder (TODO/FIXME).",
    ]
    assert out["b.py"]["issues_detected"] == [K.NO_QUALITY_ISSUE] and out["b.py"]["has_docstrings"]
    assert out["c.py"]["line_count"] == 0 and not out["c.py"]["has_docstrings"]


def tools(spark, **call):
    names = ("tool", "code", "language", "file_path", "element_type", "complexity_score")
    schema = "tool string, code string, language string, file_path string, element_type string, complexity_score int"
    return Q.run_tools(spark.createDataFrame([tuple(call.get(n) for n in names)], schema)).first()


def test_run_tools(spark):
    deep = "\n".join(["x"] * 50 + [" " * 16 + "y"])
    assert tools(spark, tool="suggest_refactoring", code=deep, complexity_score=6)["suggestions"] == [
        K.REFACTOR_LONG, K.REFACTOR_COMPLEX, K.REFACTOR_DEEP,
    ]
    assert tools(spark, tool="suggest_refactoring", code="x")["suggestions"] == [K.REFACTOR_NONE]
    assert tools(spark, tool="suggest_refactoring", code="x", complexity_score=5)["suggestions"] == [K.REFACTOR_NONE]
    assert tools(spark, tool="nope")["error"] == "Unknown tool: nope"
    quality = tools(spark, tool="analyze_code_quality")["quality"]
    assert (quality["file_path"], quality["language"], quality["line_count"]) == ("unknown", "unknown", 0)
    scan = tools(spark, tool="detect_security_vulnerability", code="eval(x)")
    assert scan["scan_status"] == "Success" and scan["rules_scanned"] == SEC.rules_scanned()
    assert [v["type"] for v in scan["vulnerabilities"]] == ["unsafe_execution"]


def test_docstrings(spark):
    code = "def go(a: int, b=2,  , *args):\n    pass"
    text = tools(spark, tool="generate_docstring", code=code)["docstring"]
    assert text == (
        '"""Function go.\n\nDetailed function description goes here.\n    Args:\n        a: Description of a.\n'
        "        b: Description of b.\n        *args: Description of *args.\n\n    Returns:\n"
        '        Description of return value.\n    """'
    )
    assert tools(spark, tool="generate_docstring", code="x", element_type="class")["docstring"].startswith('"""Class element.')
    odd = tools(spark, tool="generate_docstring", code=code, element_type="method")["docstring"]
    assert "Args" not in odd and odd.startswith('"""Function go.')
    two = tools(spark, tool="generate_docstring", code="def f(\n a)", element_type="function")["docstring"]
    assert "Args" not in two


JS_CODE = """
import React from 'react';
import './style.css';
const fs = require( 'fs');
function plain(a) { return a; }
const arrow = async (x, y) => x;
let other = (z) => z;
class Box extends Base { open(a, f(b)) { } }
items.map(function (x) { return x; });
if (a) { } for (;;) { } while (b) { } switch (c) { }
// class Ghost
a?.b ?? c
broken(call(
"""


def test_js_structure(files):
    df = files({"a.js": JS_CODE, "b.py": JS_CODE})
    assert values(JS.js_functions(df).orderBy("seq"), "name") == ["plain", "arrow", "other", "open", "function"]
    assert values(JS.js_classes(df).orderBy("seq"), "name") == ["Box", "Ghost"]
    # the style sheet import starts a match that must reach "from" on its own line, so it is not one
    assert values(JS.js_imports(df).orderBy("seq"), "import_text") == ["import React from", "require("]
    assert JS.js_complexity(df).first()["complexity"] == 1 + 4 + 1 + 2


def test_js_functions_survive_an_unclosed_parenthesis(files):
    out = JS.js_functions(files({"a.js": "f(" + "(a)" * 3000 + " " + "x(" * 3000})).collect()
    assert out == []


def test_js_functions_equal_a_plain_loop(files):
    rng = random.Random(5)
    words = ["function ", "f", "(", ")", " {", "const ", "a", " = ", "async ", "=>", "\n", " ", "if", "$x", "(a)", "let y = "]
    texts = {f"f{i}.ts": "".join(rng.choices(words, k=rng.randint(0, 30))) for i in range(300)}
    plain = re.compile(
        r"\b(?:function\s+([a-zA-Z0-9_$]+)\s*\()|\b(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?\(.*?\)\s*=>"
        r"|\b([a-zA-Z0-9_$]+)\s*\((?:[^()]|\([^()]*\))*\)\s*\{"
    )
    out = JS.js_functions(files(texts)).orderBy("path", "seq").collect()
    got: dict[str, list[str]] = {}
    for r in out:
        got.setdefault(r["path"], []).append(r["name"])
    for path, code in texts.items():
        names = [next(g for g in m.groups() if g) for m in plain.finditer(code)]
        assert got.get(path, []) == [n for n in names if n not in K.JS_NOT_FUNCTIONS], code


def test_file_metrics(files):
    code = "import os\n\ndef f(a):\n    if a and a:\n        return 1\n\nclass C:\n    def g(self):\n        'd'\n        return 12\n"
    row = M.file_metrics(files({"a.py": code})).first().asDict()
    row = {k: row[k] for k in (*M.SCALARS, "smell_count")}
    assert row == {
        "lines_of_code": 10, "non_blank_lines": 8, "function_count": 2, "class_count": 1, "import_count": 1,
        "avg_function_length": 3.0, "total_complexity": 4, "smell_count": 2,
    }
    java = M.file_metrics(files({"a.java": "class A { int f() { return 77; } }"})).first()
    assert (java["function_count"], java["class_count"], java["total_complexity"], java["smell_count"]) == (0, 0, 0, 1)


def test_review_prompt_parts(files):
    df = files({"a.js": "var x = 77;\n" * 201, "b.java": "ok"})
    prompt = {r["path"]: r["prompt"] for r in prompts.review_prompts(df).collect()}
    assert "  - lines_of_code: 201" in prompt["a.js"] and "[1 more lines truncated]" in prompt["a.js"]
    assert "  - [warning] L201: Uses 'var'" in prompt["a.js"] and "(none detected)" in prompt["b.java"]


def test_readme_prompt_limits(files):
    texts = {f"f{i:03}.py": "x" * 600 for i in range(60)}
    df = files(texts)
    prompt = prompts.readme_prompts(df, df).first()["prompt"]
    assert prompt.count("- f") == 50 and prompt.count("### f") == 5 and "x" * 500 in prompt and "x" * 501 not in prompt
    assert "- f000.py (python, 600 bytes)" in prompt and "f050.py" not in prompt


def test_infer_isolates_failures(spark):
    def model(texts, temperature):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id int, prompt string").coalesce(1)
    out = prompts.infer(df, model).orderBy("id").collect()
    assert [(r["raw"], r["error"]) for r in out] == [("A", None), (None, "RuntimeError: no answer"), ("C", None)]

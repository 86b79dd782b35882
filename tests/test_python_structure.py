"""Python structure against an independent recursive twin."""

import ast
import os
import random

from corpusreview.operators import py_structure as PY
from corpusreview.operators import smells as SM
from corpusreview.plans.templates import PY_BLOCKS

BRANCHES = ("If", "For", "While", "Try", "ExceptHandler", "With", "Assert", "BoolOp")
LEVELS = ("If", "For", "While", "With", "Try")


def kind(node):
    return type(node).__name__


def all_below(node):
    """Breadth-first, the node itself first."""
    queue = [node]
    for n in queue:
        queue.extend(ast.iter_child_nodes(n))
    return queue


def depth(node, at=0):
    return max([at] + [depth(c, at + (kind(c) in LEVELS)) for c in ast.iter_child_nodes(node)])


def twin(code):
    out = []
    for f in all_below(ast.parse(code)):
        if kind(f) in ("FunctionDef", "AsyncFunctionDef"):
            below = all_below(f)
            cx = 1 + sum(kind(n) in BRANCHES for n in below)
            cx += sum(kind(x) == "If" for n in below if kind(n) == "If" for x in n.orelse)
            out.append(
                (f.name, f.lineno, f.end_lineno, f.end_lineno - f.lineno + 1, [a.arg for a in f.args.args],
                 ast.get_docstring(f, clean=False) is not None, cx, depth(f), kind(f) == "AsyncFunctionDef")
            )
    return out


SNIPPETS = [
    "if a:\n    pass\nelif b:\n    pass\nelse:\n    if c:\n        pass",
    "for x in y:\n    while x and y or z:\n        break\nelse:\n    pass",
    "try:\n    a()\nexcept E:\n    b()\nexcept F:\n    pass\nfinally:\n    c()",
    "with a as b, c:\n    assert b",
    "async def g(q, *a, k=1, **kw):\n    'doc'\n    async with q:\n        pass\n    async for i in q:\n        pass",
    "def h(x=lambda: a or b, /, y=2):\n    return [i for i in x if i and y]",
    "class C(B, m.D):\n    'd'\n    x = 1\n    def m(self):\n        def n():\n            if a: pass\n        return n",
    "match a:\n    case 1 if b and c:\n        pass",
    "@deco(a and b)\ndef d():\n    'x' + 'y'",
    "import a.b as c, d\nfrom .. import e\nfrom .f import g as h, i",
]


def indent(text, by):
    return "\n".join(" " * by + line for line in text.split("\n"))


def random_code(rng, level=0):
    parts = []
    for i in range(rng.randint(1, 3)):
        part = rng.choice(SNIPPETS)
        if level < 3 and rng.random() < 0.6:
            part = f"def fn{level}{i}(p{i}):\n" + indent(random_code(rng, level + 1), 4)
        parts.append(part)
    return "\n".join(parts)


def test_functions_equal_twin(files):
    rng = random.Random(11)
    texts = {f"f{i}.py": random_code(rng) for i in range(120)} | {f"b{i}.py": b for i, b in enumerate(PY_BLOCKS)}
    # async statements are only valid in async functions: unfit combinations stay in as unparsable files
    want = {}
    for path, code in texts.items():
        try:
            want[path] = twin(code)
        except SyntaxError:
            want[path] = []
    assert sum(map(len, want.values())) > 100
    got: dict[str, list] = {path: [] for path in texts}
    for r in PY.py_functions(files(texts).coalesce(3)).collect():
        got[r["path"]].append(tuple(r)[2:])
    assert got == want


def test_classes_and_imports(files):
    df = files({"a.py": SNIPPETS[6] + "\n" + SNIPPETS[9]})
    c = PY.py_classes(df).first()
    assert (c["name"], c["line"], c["methods"], c["has_docstring"]) == ("C", 1, ["m", "n"], True)
    assert c["bases"] == ["Name(id='B', ctx=Load())", "Attribute(value=Name(id='m', ctx=Load()), attr='D', ctx=Load())"]
    modules = [r["module"] for r in PY.py_imports(df).orderBy("seq").collect()]
    assert modules == ["a.b", "d", ".e", "f.g", "f.i"]


def test_unparsable_files(files):
    texts = {"bom.py": "\ufeffdef f(): pass", "nul.py": "x\0y", "bad.py": "def (", "ok.py": "x = 1", "no.js": "def f(): pass"}
    rows = {r["path"]: r["py_has_errors"] for r in PY.with_py_structure(files(texts)).collect()}
    assert rows == {"bom.py": True, "nul.py": True, "bad.py": True, "ok.py": False, "no.js": None}
    assert SM.function_smell(files(texts), SM.missing_docstring).count() == 0


def test_deep_text_does_not_fail_the_job(files):
    rows = PY.py_complexity(files({"a.py": "(" * 5000 + ")" * 5000, "b.py": "x = " + "-" * 20000 + "1"})).collect()
    assert all(r["function_count"] == 0 for r in rows)


def test_lack_of_memory_fails_the_job():
    """Only what depends on the text alone is an error of the file."""
    import subprocess
    import sys

    code = (
        "import ast\n"
        "import pyarrow as pa\n"
        "from corpusreview.operators import py_structure as PY\n"
        "run = PY._tree_udf().func\n"
        "real = ast.parse\n"
        "def parse(text, fails={'deep': 'Parser stack overflowed - Python source too complex to parse', 'full': ''}):\n"
        "    if text in fails:\n"
        "        raise MemoryError(fails[text])\n"
        "    return real(text)\n"
        "ast.parse = parse\n"
        "out = next(run(iter([pa.array(['deep', 'x = 1'])]))).to_pylist()\n"
        "assert [r['has_errors'] for r in out] == [True, False], out\n"
        "try:\n"
        "    next(run(iter([pa.array(['full'])])))\n"
        "except MemoryError:\n"
        "    print('raised')\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark_home = "from pyspark.sql import SparkSession\nSparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
    out = subprocess.run([sys.executable, "-c", spark_home + code], cwd=root, capture_output=True, text=True, timeout=120)
    assert "raised" in out.stdout, out.stderr[-2000:]


def test_function_smells(files):
    body = "\n".join(["    x = 1"] * 50)
    code = f"def long():\n{body}\ndef short():\n    'd'\n" + "\n".join("    " * (i + 1) + "if a:" for i in range(5)) + "\n" + " " * 24 + "pass"
    out = SM.all_smells(files({"a.py": code})).collect()
    assert [(r["rule"], r["line"]) for r in out] == [("long_function", 1), ("missing_docstring", 1), ("deep_nesting", 52)]
    assert out[2]["description"] == "Function 'short' has nesting depth 5 (>4). Refactor to reduce nesting."


def test_complexity_of_elif_and_nested(files):
    code = "def a():\n    if x:\n        pass\n    elif y:\n        pass\n    def b():\n        for i in j: pass\nif z: pass"
    row = PY.py_complexity(files({"a.py": code})).first()
    # a: 1 + two ifs + one elif + the loop of b; b: 1 + its loop; the module-level if counts nothing
    assert (row["function_count"], row["total_complexity"]) == (2, 5 + 2)


def test_copies_of_a_text_are_parsed_once(spark, monkeypatch):
    import ast

    import pyarrow as pa

    from corpusreview.operators.py_structure import _tree_udf

    seen, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda code, *more: seen.append(code) or parse(code, *more))
    texts = pa.array(["def f():\n    pass", None, "x = (", "def f():\n    pass", "x = (", "", None])
    (found,) = _tree_udf().func(iter([texts]))
    assert sorted(seen) == ["", "def f():\n    pass", "x = ("]
    assert found.field("has_errors").to_pylist() == [False, None, True, False, True, False, None]
    names = [[n["name"] for n in row["nodes"] or []] for row in found.to_pylist()]
    assert names == [["f"], [], [], ["f"], [], [], []]

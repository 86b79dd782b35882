"""Patterns that search a line for a far end: the matches of the plain patterns, in time that grows with the text."""

import random
import time

import pytest

from corpusreview import constants as K
from corpusreview.operators import js_structure as JS
from corpusreview.operators import security as SEC

CALLS = ("subprocess.Popen(", "shell=True", "shell = \n True", "shell=Truex", "eval", "exec(", "child_process.exec", "xeval", " ", "\n", "a", ")", "\u0004", "\u0005", "é", "_")
ARROWS = ("var a = (", "let b=async (", "const c =\n(", "x", ")", ") =>", ")\n=>", "=> {", "function f(", "g(", "h (1) {", "if (", "{", " ", "\n", ";", "var (x) {", "\u0004", "\u0005")


def texts(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_unsafe_calls_equal_the_plain_pattern(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(CALLS, 3000, 3))], "id int, content string")
    plain = dict(K.SECURITY_RULES)["unsafe_execution"]
    # control characters that mark places read as another one in either form
    shown = lambda rows: [(r["line"], r["match"].translate({4: "\u0002", 5: "\u0002"})) for r in rows]
    rows = df.select("content", SEC.located(df["content"], "unsafe_execution", plain).alias("want"), SEC.vulnerabilities(df["content"]).alias("got")).collect()
    for r in rows:
        assert shown([x for x in r["got"] if x["type"] == "unsafe_execution"]) == shown(r["want"]), repr(r["content"])
    assert sum(len(r["want"]) for r in rows) > 1000 and sum("\n" in x["match"] for r in rows for x in r["want"]) > 10


def test_functions_equal_the_plain_pattern(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(ARROWS, 4000, 4))], "id int, content string")
    group = lambda i: F.regexp_extract_all("content", F.lit(K.JS_FUNCTION), F.lit(i))
    both = lambda a, b: F.concat(a, b)
    plain = F.zip_with(F.zip_with(group(1), group(2), both), group(3), both)
    plain = F.filter(plain, lambda n: (n != "") & ~n.isin(list(K.JS_NOT_FUNCTIONS)))
    rows = df.select("content", plain.alias("want"), JS.function_names(df["content"]).alias("got")).collect()
    for r in rows:
        assert r["got"] == r["want"], repr(r["content"])
    assert sum(len(r["want"]) for r in rows) > 1000


@pytest.mark.parametrize("line", ["subprocess.Popen( ", "subprocess.Popen( eval( ", "var a = (1); ", "let b = async (1); f(2) { "])
def test_time_on_one_long_line(spark, line):
    code = line * (400_000 // len(line))
    df = spark.createDataFrame([(code[:2000],), (code,)], "content string")
    found = df.select(SEC.vulnerabilities(df["content"]).alias("v"), JS.function_names(df["content"]).alias("f"))
    found.limit(1).collect()
    start = time.perf_counter()
    rows = found.collect()
    assert time.perf_counter() - start < 8  # eight times the length that took minutes
    assert len(rows[1]["v"]) == code.count("eval") and len(rows[1]["f"]) == code.count("f(2) {")


def test_plain_texts_are_searched_once_for_a_rule(spark, files):
    """The patterns of plain texts stand once in the plan, and match what the patterns of all texts match."""
    from pyspark.sql import functions as F

    token = ["password", "=", "'abcdefghij1'", "eval", "subprocess.Popen(", "shell=True", "SELECT a", "+", "x", " ", "\n", "_", "yaml.load", "exec(", "pickle.loads"]
    texts = ["".join(token[(i * 7 + k * k * (i % 5 + 1) + k) % len(token)] for k in range(3 + i % 40)) for i in range(600)]
    texts += ["subprocess.Popen(a, shell=True) eval\n" * 150, "api_key =\n 'abcdefghij_9' SELECT", "\u0001eval\u0003 SELECT+x", "", "\u0004exec"]
    df = files({f"f{i}.py": text for i, text in enumerate(texts)})
    for rule, pattern in K.SECURITY_RULES:
        whole, plain = SEC._found(F.col("content"), rule, pattern), SEC.vulnerabilities(F.col("content"), [(rule, pattern)])
        assert df.filter(~whole.eqNullSafe(plain)).count() == 0
    plan = SEC.security_scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?id)(?=[apst])(password") == 1
    assert plan.count("(?d)(?=[py])") == 1

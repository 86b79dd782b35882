"""Selection, decoding, lines, truncation, Markdown."""

import random

import pytest
from pyspark.sql import functions as F

from corpusreview import constants as K
from corpusreview.functions import paths as P
from corpusreview.functions import scores as S
from corpusreview.functions import text as T
from corpusreview.functions import urls as U
from corpusreview.operators import lines as L
from corpusreview.operators import selection as SEL
from tests.conftest import values

BREAKS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def texts():
    rng = random.Random(7)
    some = ["", "\n", "a", "a\n", "a\n\nb", "\r\n\r\n", "a\rb", "x\x0by", "p\u2028q", "no end\n\n"]
    alphabet = BREAKS + ["a", "é", " ", "\t", "1", "\x1f"]
    return some + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]


def frame(spark, rows, column="content"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], f"id int, {column} string")


def test_lines_split_as_in_python(spark):
    rows = texts()
    got = T.with_lines(frame(spark, rows)).orderBy("id").collect()
    assert [r["lines"] for r in got] == [t.splitlines() for t in rows]


def test_explode_lines_numbers_from_one(spark):
    out = L.explode_lines(frame(spark, ["a\nb\n", "", "c"]), keys=("id",)).orderBy("id", "line_no")
    assert values(out, "id", "line_no", "line") == [(0, 1, "a"), (0, 2, "b"), (2, 1, "c")]


def test_line_counts(spark):
    rows = texts()
    got = L.line_counts(frame(spark, rows), keys=("id",)).orderBy("id").collect()
    want = [(len(t.splitlines()), sum(bool(x.strip()) for x in t.splitlines())) for t in rows]
    assert [(r["lines_of_code"], r["non_blank_lines"]) for r in got] == want


@pytest.mark.parametrize("limit", [1, 3, 200])
def test_truncation(spark, limit):
    long = ["".join(f"line {i}{end}" for i in range(n)) for n in (199, 200, 201, 450) for end in ("\n", "\r\n")]
    rows = texts() + long + ["\n".join(map(str, range(201))), "a\u2028b\nc\x0bd\re"]
    df = T.with_lines(frame(spark, rows))
    got = df.orderBy("id").select(T.truncated(F.col("content"), F.col("lines"), limit).alias("t")).collect()

    def twin(t):
        kept = t.splitlines(keepends=True)
        rest = len(kept) - limit
        return t if rest <= 0 else "".join(kept[:limit]) + f"\n# ... [{rest} more lines truncated] ...\n"

    assert [r["t"] for r in got] == [twin(t) for t in rows]


def test_decode(spark):
    raw = [b"a\r\nb\rc", "é\n".encode(), b"x\xff\xfey", b"\xef\xbb\xbfbom", b"\xe2\x82"]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "id int, raw binary")
    got = values(df.orderBy("id").select(T.decode(F.col("raw")).alias("t")), "t")
    want = [r.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for r in raw]
    assert got == want


def test_size_guard_boundary(spark):
    df = spark.createDataFrame([("a", 51200), ("b", 51201)], "path string, size bigint")
    kept, skipped = SEL.size_guard(df)
    assert values(kept, "path") == ["a"]
    assert values(skipped, "path", "skip_reason") == [("b", K.SKIP_REASON)]


PATHS = [
    "a.py", "pkg/__init__.py", "_u.py", "a.PY", ".eslintrc.js", "x/node_modules/a.js", "node_modules.js", "build/a.py",
    "Build/a.py", "src/.hidden/a.ts", "a.test.tsx", "Makefile", "name.", "dist.py", "venv", "a/b.java", "x/dist/y.py", "...py",
]


def test_selection(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    listed = SEL.drop_vendored(SEL.with_extension(df))
    want = [
        "a.py", "pkg/__init__.py", "_u.py", "a.PY", "node_modules.js", "Build/a.py", "a.test.tsx", "dist.py", "a/b.java",
    ]
    assert values(listed, "path") == want
    assert values(df.select(P.suffix(F.col("path")).alias("s")), "s")[:5] == [".py", ".py", ".py", ".PY", ".js"]
    languages = dict(values(SEL.with_language(df), "path", "language"))
    assert languages["a.PY"] == "python" and languages["a.test.tsx"] == "typescript" and languages["Makefile"] == "unknown"


def test_custom_extensions_are_not_lowered(spark):
    df = spark.createDataFrame([("a.MD",), ("b.md",)], "path string")
    assert values(SEL.with_extension(df, [".MD"]), "path") == []
    assert values(SEL.with_extension(df, [".md"]), "path") == ["a.MD", "b.md"]


def test_languages_and_paths(spark):
    df = spark.createDataFrame([("a", "python"), ("b", "Java"), ("c", "go")], "path string, language string")
    assert values(SEL.filter_languages(df, ["PYTHON", "java"]), "path") == ["a", "b"]
    assert values(SEL.filter_languages(df, []), "path") == []
    assert values(SEL.restrict_paths(df, []), "path") == ["a", "b", "c"]
    assert values(SEL.restrict_paths(df, None), "path") == ["a", "b", "c"]
    assert values(SEL.restrict_paths(df, ["c", "zz"]), "path") == ["c"]
    wanted = spark.createDataFrame([("b",), ("b",)], "path string")
    assert values(SEL.restrict_paths(df, wanted), "path") == ["b"]
    assert SEL.restrict_paths(df, wanted.filter("false")).count() == 3


def test_markdown_blocks(spark):
    doc = "# T\n## S\n### P\n#### deep\n- i\n* j\n\n  \ntext\n``` py \ncode\n# not a title\n```\nafter\n```\n```\n```js\nlost"
    df = spark.createDataFrame([("d", doc), ("e", "")], "path string, doc string")
    out = L.markdown_blocks(df).orderBy("path", "line_no")
    assert values(out, "path", "line_no", "kind", "lang", "text") == [
        ("d", 0, "h1", "", "T"), ("d", 1, "h2", "", "S"), ("d", 2, "h3", "", "P"), ("d", 3, "paragraph", "", "#### deep"),
        ("d", 4, "item", "", "i"), ("d", 5, "item", "", "j"), ("d", 6, "blank", "", ""), ("d", 7, "blank", "", ""),
        ("d", 8, "paragraph", "", "text"), ("d", 12, "code", "py", "code\n# not a title"), ("d", 13, "paragraph", "", "after"),
        ("d", 15, "code", "", ""), ("e", 0, "blank", "", ""),
    ]


def test_sizes_and_rounding(spark):
    sizes = [0, 1023, 1024, 1100, 1280, 1331, 1048575, 1048576, 1572864, 5 * 1024**3]
    df = spark.createDataFrame([(n,) for n in sizes], "size bigint").select(S.file_size_text(F.col("size")).alias("t"))
    want = ["0 B", "1023 B", "1.0 KB", "1.1 KB", "1.2 KB", "1.3 KB", "1024.0 KB", "1.0 MB", "1.5 MB", "5120.0 MB"]
    assert values(df, "t") == want
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.4,), (-0.5,)], "x double")
    assert values(halves.select(S.round_half_up(F.col("x")).alias("r")), "r") == [1, 2, 2, 0]


def test_urls(spark):
    rows = {
        "https://github.com/a/b": ("a/b", True),
        "https://github.com/a/b.git": ("a/b", True),
        "https://github.com/a/b/": ("a/b", True),
        "https://github.com/a/b/tree/x?y=1#z": ("a/b", True),
        "https://github.com/a": (None, False),
        "https://www.github.com/a/b": ("a/b", False),
        "HTTPS://GitHub.COM/a/b": ("a/b", True),
        "": (None, True),
        "github.com/a/b": ("github.com/a", False),
        "https://github.com:443/a/b": ("a/b", True),
        "https://github.com//a//b": ("a/", True),
    }
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    out = df.select("url", U.repo_slug(F.col("url")).alias("slug"), U.is_repo_url(F.col("url")).alias("ok"))
    assert {r["url"]: (r["slug"], r["ok"]) for r in out.collect()} == rows


def test_score_scales(spark):
    df = spark.createDataFrame([(float(x),) for x in (39.9, 40, 50, 60, 75, 80, 90)], "s double")
    out = df.select(
        S.dial_class(F.col("s")).alias("d"), S.chip_class(F.col("s")).alias("c"), S.quality_label(F.col("s")).alias("q")
    )
    assert values(out, "d", "c", "q") == [
        ("poor", "bad", "poor"), ("fair", "bad", "poor"), ("fair", "warn", "needs improvement"),
        ("good", "warn", "needs improvement"), ("good", "warn", "good"), ("excellent", "good", "good"),
        ("excellent", "good", "excellent"),
    ]

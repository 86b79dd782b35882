"""Per-file metrics and the per-language breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview.functions import text as T
from corpusreview.operators.js_structure import is_js, with_js_structure
from corpusreview.operators.py_structure import is_python, mean_length, with_py_structure
from corpusreview.operators.smells import with_smells

SCALARS = (
    "lines_of_code", "non_blank_lines", "function_count", "class_count", "import_count", "avg_function_length",
    "total_complexity",
)


def _by_language(python: Column, js: Column) -> Column:
    language = F.col("language")
    return F.when(is_python(language), python).when(is_js(language), js).otherwise(F.lit(0))


def with_metrics(df: DataFrame) -> DataFrame:
    """Add the seven scalars and ``smells`` to ``(…, language, content)``; row-local, so the text never moves."""
    d = with_smells(with_js_structure(with_py_structure(T.with_lines(df))))
    fns = F.col("py_functions")
    python_complexity = F.aggregate(fns, F.lit(0), lambda acc, f: acc + f["complexity"])
    out = d.withColumns(
        {
            "lines_of_code": F.size("lines"),
            "non_blank_lines": T.non_blank(F.col("lines")),
            "function_count": _by_language(F.size(fns), F.size("js_functions")),
            "class_count": _by_language(F.size("py_classes"), F.size("js_classes")),
            "import_count": _by_language(F.size("py_imports"), F.size("js_imports")),
            "avg_function_length": F.when(is_python(F.col("language")), mean_length(fns)).otherwise(F.lit(0.0)),
            "total_complexity": _by_language(python_complexity, F.col("js_complexity")),
        }
    )
    return out.select(*df.columns, *SCALARS, "smells")


def file_metrics(df: DataFrame, keys=("repo", "path", "language")) -> DataFrame:
    """One row per file: the scalars and how many smells it has (their rows are ``all_smells``)."""
    return with_metrics(df).select(*keys, *SCALARS, F.size("smells").alias("smell_count"))


def language_breakdown(files: DataFrame, reviews: DataFrame | None = None, by: str = "run_id") -> DataFrame:
    """Files, bytes and mean score per run and language."""
    sizes = files.groupBy(by, "language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    if reviews is None:
        return sizes
    mean = F.avg(F.col("score").cast("decimal(18,6)"))
    scores = reviews.groupBy(by, "language").agg(F.bround(mean, 1).cast("double").alias("mean_score"))
    return sizes.join(scores, [by, "language"], "left")

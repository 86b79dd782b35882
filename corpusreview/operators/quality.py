"""Code-quality summary, refactoring hints, docstring templates and the table of tool calls that uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import text as T
from corpusreview.functions.arrays import numbered_rows
from corpusreview.operators import security


def _contains_any(text: Column, marks: tuple[str, ...]) -> Column:
    out = text.contains(marks[0])
    for mark in marks[1:]:
        out = out | text.contains(mark)
    return out


def is_long_line(line: Column) -> Column:
    return F.char_length(line) > K.LONG_LINE_CHARS


def has_todo(line: Column) -> Column:
    return _contains_any(line, K.TODO_MARKERS)


def quality_issues(lines: Column) -> Column:
    """Texts in line order, the length remark before the marker remark; a default text when there are none."""

    def per_line(line: Column, i: Column) -> Column:
        too_long = F.when(is_long_line(line), T.format_text(K.LONG_LINE_TEXT, i + 1, F.char_length(line)))
        marker = F.when(has_todo(line), T.format_text(K.TODO_TEXT, i + 1))
        return F.array_compact(F.array(too_long, marker))

    # most lines have no remark, so lines are dropped before texts are built
    found = F.flatten(F.transform(lines, per_line))
    bound = F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(K.NO_QUALITY_ISSUE))))
    return bound[0]


def has_docstrings(code: Column) -> Column:
    return _contains_any(code, K.DOC_MARKERS)


def line_rule(df: DataFrame, rule, keys=("repo", "path")) -> DataFrame:
    """Lines that satisfy ``rule`` with their number and length."""
    lines = numbered_rows(T.with_lines(df), keys, F.col("lines"), "line", "line_no").filter(rule(F.col("line")))
    return lines.select(*keys, "line_no", F.char_length("line").alias("chars"))


def code_quality(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    return T.with_lines(df).select(
        *keys,
        "language",
        F.size("lines").alias("line_count"),
        quality_issues(F.col("lines")).alias("issues_detected"),
        has_docstrings(F.col("content")).alias("has_docstrings"),
    )


def refactoring_hints(lines: Column, complexity: Column) -> Column:
    deep = F.exists(lines, lambda x: x.startswith(" " * K.REFACTOR_INDENT))
    hints = F.array_compact(
        F.array(
            F.when(F.size(lines) > K.REFACTOR_LINES, F.lit(K.REFACTOR_LONG)),
            F.when(complexity > K.REFACTOR_COMPLEXITY, F.lit(K.REFACTOR_COMPLEX)),
            F.when(deep, F.lit(K.REFACTOR_DEEP)),
        )
    )
    bound = F.transform(F.array(hints), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(K.REFACTOR_NONE))))
    return bound[0]


def suggest_refactoring(df: DataFrame, complexity: str | None = None, keys=("repo", "path")) -> DataFrame:
    """One row per hint; ``complexity`` names a column, missing values count 1."""
    score = F.coalesce(F.col(complexity), F.lit(1)) if complexity else F.lit(1)
    return numbered_rows(T.with_lines(df), keys, refactoring_hints(F.col("lines"), score), "hint")


def element_name(code: Column) -> Column:
    name = F.regexp_extract(code, K.ELEMENT_NAME, 2)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("element"))


def element_params(code: Column) -> Column:
    """Names between the first parentheses that open and close on one line."""
    pieces = F.filter(F.split(F.regexp_extract(code, K.ELEMENT_PARAMS, 1), ",", -1), lambda p: ~T.is_blank(p))
    return F.transform(pieces, lambda p: T.strip(F.substring_index(F.substring_index(T.strip(p), ":", 1), "=", 1)))


def docstring_template(code: Column, kind: Column) -> Column:
    """Template text; ``kind`` NULL means function, an unknown kind gets the function text without parameters."""
    name = element_name(code)
    kind = F.coalesce(kind, F.lit("function"))
    params = F.transform(element_params(code), lambda p: T.format_text(K.DOCSTRING_ARG, p, p))
    section = F.array_join(params, "\n")
    args = F.when((kind == "function") & (section != ""), F.concat(F.lit(K.DOCSTRING_ARGS), section)).otherwise("")
    return (
        F.when(kind == "class", T.format_text(K.DOCSTRING_CLASS, name))
        .when(kind == "module", T.format_text(K.DOCSTRING_MODULE, name))
        .otherwise(T.format_text(K.DOCSTRING_FUNCTION, name, args))
    )


def register_tool_results(calls: DataFrame, name: str = "tool_results") -> None:
    """Make the results of a table of calls available to SQL."""
    run_tools(calls).createOrReplaceTempView(name)


def run_tools(calls: DataFrame) -> DataFrame:
    """Result of each tool call ``(tool, code, language, file_path, element_type, complexity_score)``.

    One projection: CASE branches are lazy, so a call pays for its own tool only and no call is moved.
    """
    code = F.coalesce(F.col("code"), F.lit(""))
    tool = F.col("tool")
    quality, scan, docstring, refactor = (tool == name for name in K.TOOLS)
    lines = F.col("lines")
    coded = T.with_lines(calls.withColumn("code", code), text="code")
    analysis = F.struct(
        F.coalesce("file_path", F.lit("unknown")).alias("file_path"),
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.size(lines).alias("line_count"),
        quality_issues(lines).alias("issues_detected"),
        has_docstrings(F.col("code")).alias("has_docstrings"),
    )
    hints = refactoring_hints(lines, F.coalesce("complexity_score", F.lit(1)))
    return coded.select(
        *[c for c in ("call_id",) if c in calls.columns],
        "tool",
        F.lit("executed").alias("status"),
        F.when(quality, analysis).alias("quality"),
        F.when(scan, security.vulnerabilities(F.col("code"))).alias("vulnerabilities"),
        F.when(scan, F.lit("Success")).alias("scan_status"),
        F.when(scan, F.array(*[F.lit(r) for r in security.rules_scanned()])).alias("rules_scanned"),
        F.when(docstring, docstring_template(F.col("code"), F.col("element_type"))).alias("docstring"),
        F.when(refactor, hints).alias("suggestions"),
        F.when(~tool.isin(list(K.TOOLS)), T.format_text(K.UNKNOWN_TOOL, tool)).alias("error"),
    )

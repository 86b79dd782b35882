"""Code smells.

Each rule is an expression that turns the ``lines`` (or Python functions) of one row into an array of
``(rule, line, severity, description)``.  The tables explode the arrays; prompts and metrics read them in place, so a
file's text never has to be joined back to its findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import text as T
from corpusreview.functions.arrays import rows_of
from corpusreview.operators.js_structure import is_js
from corpusreview.operators.py_structure import is_python, with_py_structure

SMELL = "struct<rule:string,line:int,severity:string,description:string>"


def _smell(rule: str, line: Column, severity: str, description: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        line.cast("int").alias("line"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
    )


def none() -> Column:
    return F.array().cast(f"array<{SMELL}>")


def is_comment(line: Column) -> Column:
    return line.rlike(rf"\A[{K.WHITE_SPACE}]*+(?:#|//|/\*|\*)")


def is_js_comment(line: Column) -> Column:
    return line.rlike(rf"\A[{K.WHITE_SPACE}]*+(?://|/\*|\*)")


def long_file(lines: Column) -> Column:
    smell = _smell("long_file", F.lit(1), "warning", T.format_text(K.SMELL_TEXT["long_file"], F.size(lines)))
    return F.when(F.size(lines) > K.LONG_FILE_LINES, F.array(smell)).otherwise(none())


def magic_number(lines: Column) -> Column:
    def per_line(line: Column, i: Column) -> Column:
        hits = F.regexp_extract_all(line, F.lit(K.MAGIC_NUMBER), F.lit(1))
        smells = F.transform(
            hits, lambda m: _smell("magic_number", i + 1, "info", T.format_text(K.SMELL_TEXT["magic_number"], m))
        )
        # most lines have no two characters in a row that may be digits; they are left out before the dear pattern runs
        return F.when(line.rlike(r"[0-9\x{80}-\x{10ffff}]{2}") & ~is_comment(line), smells)

    return F.flatten(F.array_compact(F.transform(lines, per_line)))


def _js_line_smells(lines: Column, *rules) -> Column:
    def per_line(line: Column, i: Column) -> Column:
        hits = F.array_compact(F.array(*[rule(line, i) for rule in rules]))
        # a plain substring test leaves out most lines before comments and patterns are looked at
        word = line.contains(K.CONSOLE_LOG) | line.contains("var")
        return F.when(word & ~is_js_comment(line), hits)

    return F.flatten(F.array_compact(F.transform(lines, per_line)))


def _console_log(line: Column, i: Column) -> Column:
    smell = _smell("console_log", i + 1, "info", F.lit(K.SMELL_TEXT["console_log"]))
    return F.when(line.contains(K.CONSOLE_LOG), smell)


def _var_usage(line: Column, i: Column) -> Column:
    smell = _smell("var_usage", i + 1, "warning", F.lit(K.SMELL_TEXT["var_usage"]))
    return F.when(line.contains("var") & line.rlike(K.VAR_DECLARATION), smell)


def console_log(lines: Column) -> Column:
    return _js_line_smells(lines, _console_log)


def var_usage(lines: Column) -> Column:
    return _js_line_smells(lines, _var_usage)


def js_smells(lines: Column) -> Column:
    return _js_line_smells(lines, _console_log, _var_usage)


def _long_function(f: Column) -> Column:
    smell = _smell(
        "long_function", f["line"], "warning", T.format_text(K.SMELL_TEXT["long_function"], f["name"], f["length"])
    )
    return F.when(f["length"] > K.LONG_FUNCTION_LINES, smell)


def _missing_docstring(f: Column) -> Column:
    smell = _smell("missing_docstring", f["line"], "info", T.format_text(K.SMELL_TEXT["missing_docstring"], f["name"]))
    return F.when(~f["has_docstring"], smell)


def _deep_nesting(f: Column) -> Column:
    smell = _smell(
        "deep_nesting", f["line"], "warning", T.format_text(K.SMELL_TEXT["deep_nesting"], f["name"], f["nesting"])
    )
    return F.when(f["nesting"] > K.MAX_NESTING, smell)


def _function_smells(fns: Column, *rules) -> Column:
    return F.flatten(F.transform(fns, lambda f: F.array_compact(F.array(*[rule(f) for rule in rules]))))


def long_function(fns: Column) -> Column:
    return _function_smells(fns, _long_function)


def missing_docstring(fns: Column) -> Column:
    return _function_smells(fns, _missing_docstring)


def deep_nesting(fns: Column) -> Column:
    return _function_smells(fns, _deep_nesting)


def python_smells(fns: Column) -> Column:
    return _function_smells(fns, _long_function, _missing_docstring, _deep_nesting)


def with_smells(df: DataFrame) -> DataFrame:
    """Add ``smells`` to files that have ``lines`` and ``py_functions``: whole-file, numbers, then by language."""
    lines, language = F.col("lines"), F.col("language")
    by_language = (
        F.when(is_python(language), python_smells(F.col("py_functions")))
        .when(is_js(language), js_smells(lines))
        .otherwise(none())
    )
    return df.withColumn("smells", F.concat(long_file(lines), magic_number(lines), by_language))


def _table(df: DataFrame, smells: Column, keys) -> DataFrame:
    return rows_of(df, keys, smells, "rule")


def line_smell(df: DataFrame, rule, keys=("repo", "path")) -> DataFrame:
    """Rows of one of the any-language line rules."""
    return _table(T.with_lines(df), rule(F.col("lines")), keys)


def js_line_smell(df: DataFrame, rule, keys=("repo", "path")) -> DataFrame:
    return line_smell(df.filter(is_js(F.col("language"))), rule, keys)


def function_smell(df: DataFrame, rule, keys=("repo", "path")) -> DataFrame:
    """Rows of one of the Python function rules; files that do not parse have none."""
    structured = with_py_structure(df.filter(is_python(F.col("language"))))
    return _table(structured, rule(F.col("py_functions")), keys)


def all_smells(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    """Every rule in one pass over the files; Python that does not parse keeps the line rules only."""
    return _table(with_smells(with_py_structure(T.with_lines(df))), F.col("smells"), keys)

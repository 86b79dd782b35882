"""Functions, classes, imports and complexity of JavaScript / TypeScript texts, by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions.arrays import numbered_rows


def is_js(language: Column) -> Column:
    return F.lower(language).isin("javascript", "typescript")


#: Control characters around what is left of a line behind a start without an arrow.
_OPEN, _CLOSE = "\u0004", "\u0005"


def without_open_starts(code: Column) -> Column:
    """The text with the same functions in it, in which few starts look for an arrow in vain.

    A start of an arrow function searches the rest of its line.  Where there is no arrow, the further starts of that line
    need not search it again: their keywords are replaced, so the time grows with the text and not with its square.
    """
    clean = F.replace(F.replace(code, F.lit(_OPEN), F.lit("\u0002")), F.lit(_CLOSE), F.lit("\u0002"))
    marked = F.regexp_replace(clean, K.JS_ARROW, f"$1$2{_OPEN}$3{_CLOSE}")

    def piece(text: Column, i: Column) -> Column:
        rest = F.substring_index(text, _CLOSE, 1)
        hidden = F.regexp_replace(rest, K.JS_KEYWORD, "_")
        return F.when(i == 0, text).otherwise(F.concat(hidden, F.substring(text, F.length(rest) + 2, F.length(text))))

    pieces = F.split(F.replace(marked, F.lit(_OPEN + _CLOSE), F.lit("")), _OPEN, -1)
    return F.when(code.rlike(K.JS_ARROW), F.array_join(F.transform(pieces, piece), "")).otherwise(code)


def function_names(code: Column) -> Column:
    """Names in order of appearance.  The text is scanned once; each match is taken apart on its own."""

    def name(match: Column) -> Column:
        return F.regexp_replace(match, K.JS_FUNCTION, "$1$2$3")  # exactly one group is there

    found = F.transform(F.regexp_extract_all(without_open_starts(code), F.lit(K.JS_FUNCTION), F.lit(0)), name)
    return F.filter(found, lambda n: (n != "") & ~n.isin(list(K.JS_NOT_FUNCTIONS)))


def class_names(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(K.JS_CLASS), F.lit(1))


def import_texts(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(K.JS_IMPORT), F.lit(0))


def complexity(code: Column) -> Column:
    return F.regexp_count(code, F.lit(K.JS_BRANCH)) + 1


def with_js_structure(df: DataFrame) -> DataFrame:
    """Add ``js_functions, js_classes, js_imports, js_complexity``; NULL for other languages."""
    js, code = is_js(F.col("language")), F.col("content")
    return df.withColumns(
        {
            "js_functions": F.when(js, function_names(code)),
            "js_classes": F.when(js, class_names(code)),
            "js_imports": F.when(js, import_texts(code)),
            "js_complexity": F.when(js, complexity(code)),
        }
    )


def _listed(df: DataFrame, values: Column, name: str, keys) -> DataFrame:
    return numbered_rows(df.filter(is_js(F.col("language"))), keys, values, name)


def js_functions(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    """One row per function; each counts as complexity 1."""
    return _listed(df, function_names(F.col("content")), "name", keys).withColumn("complexity", F.lit(1))


def js_classes(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    return _listed(df, class_names(F.col("content")), "name", keys).withColumn("has_docstring", F.lit(False))


def js_imports(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    return _listed(df, import_texts(F.col("content")), "import_text", keys)


def js_complexity(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    return df.filter(is_js(F.col("language"))).select(*keys, complexity(F.col("content")).alias("complexity"))

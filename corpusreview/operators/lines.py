"""Lines, prefixes and Markdown blocks of texts; every operator is row-local (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import text as T
from corpusreview.functions.arrays import numbered_rows, rows_of

FENCE = "```"


def explode_lines(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    """One row per line with its 1-based number."""
    return numbered_rows(T.with_lines(df), keys, F.col("lines"), "line", "line_no")


def line_counts(df: DataFrame, keys=("repo", "path")) -> DataFrame:
    return T.with_lines(df).select(
        *keys, F.size("lines").alias("lines_of_code"), T.non_blank(F.col("lines")).alias("non_blank_lines")
    )


def truncate_text(df: DataFrame, max_lines: int = K.MAX_PROMPT_LINES) -> DataFrame:
    """Add ``truncated``; scans keep reading the full ``content``."""
    out = T.with_lines(df).withColumn("truncated", T.truncated(F.col("content"), F.col("lines"), max_lines))
    return out.drop("lines")


def _line_kind(line: Column) -> Column:
    return (
        F.when(line.startswith("# "), "h1")
        .when(line.startswith("## "), "h2")
        .when(line.startswith("### "), "h3")
        .when(line.startswith("- ") | line.startswith("* "), "item")
        .when(T.is_blank(line), "blank")
        .otherwise("paragraph")
    )


def _line_text(line: Column) -> Column:
    def rest(n: int) -> Column:
        return F.substring(line, n, 2147483647)

    return (
        F.when(line.startswith("# "), rest(3))
        .when(line.startswith("## "), rest(4))
        .when(line.startswith("### "), rest(5))
        .when(line.startswith("- ") | line.startswith("* "), rest(3))
        .when(T.is_blank(line), F.lit(""))
        .otherwise(line)
    )


def markdown_blocks(docs: DataFrame, keys=("path",), text: str = "doc") -> DataFrame:
    """Blocks of Markdown documents: ``keys, line_no, kind, lang, text``.

    ``line_no`` is the 0-based line of the block (of the closing fence for code).  Fence lines come first in pairs:
    what lies between an opening and a closing fence is one ``code`` block, an unclosed fence loses its content.
    A document is one model reply and so one value: its fences are paired inside the row and nothing is shuffled.
    """
    lines, fences = F.col("_lines"), F.col("_fences")
    marked = F.transform(lines, lambda x, i: F.when(x.startswith(FENCE), i))
    n_fences = F.size(fences)

    def fence(i: Column) -> Column:
        return F.try_element_at(fences, (i + 1).cast("int"))

    def plain(j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(fence(2 * j - 1) + 1)
        end = F.coalesce(fence(2 * j), F.size(lines))
        return F.transform(
            F.slice(lines, start + 1, end - start),
            lambda x, i: F.struct(
                (start + i).cast("int").alias("line_no"),
                _line_kind(x).alias("kind"),
                F.lit("").alias("lang"),
                _line_text(x).alias("text"),
            ),
        )

    def code(j: Column) -> Column:
        opening, closing = fence(2 * j), fence(2 * j + 1)
        return F.struct(
            closing.cast("int").alias("line_no"),
            F.lit("code").alias("kind"),
            T.strip(F.substring(F.element_at(lines, (opening + 1).cast("int")), 4, 2147483647)).alias("lang"),
            F.array_join(F.slice(lines, opening + 2, closing - opening - 1), "\n").alias("text"),
        )

    # segments 0..n/2 lie outside fences; pairs 0..n/2-1 are code
    segments = F.sequence(F.lit(0), F.floor(n_fences / 2).cast("int"))
    pairs = F.filter(segments, lambda j: j < F.floor(n_fences / 2))
    blocks = (
        docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
        .withColumn("_fences", F.array_compact(marked))
        .select(*keys, F.concat(F.flatten(F.transform(segments, plain)), F.transform(pairs, code)).alias("_blocks"))
    )
    return rows_of(blocks, keys, F.col("_blocks"), "line_no")

"""Column functions on file texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K


def decode(raw: Column) -> Column:
    """Bytes to text: UTF-8 with replacement characters, ``\\r\\n`` and lone ``\\r`` become ``\\n``; a BOM stays."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\\r\\n?", "\n")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def with_lines(df: DataFrame, text: str = "content", into: str = "lines") -> DataFrame:
    """Add ``into``: the lines of ``text`` without separators; no last empty line, no line for an empty text.

    Two projections on purpose: the split is a column of its own, so it runs once per row although it is used
    three times.
    """
    t = F.col(text)
    # splitting on one plain character takes a much cheaper path than on a pattern
    parts = F.when(t.rlike(K.UNUSUAL_LINE_BREAK), F.split(t, K.LINE_BREAK, -1)).otherwise(F.split(t, "\n", -1))
    p = F.col("_parts")
    return (
        df.withColumn("_parts", parts)
        .withColumn(into, F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
        .drop("_parts")
    )


def non_blank(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: ~is_blank(x)))


def truncated(text: Column, lines: Column, max_lines: int = K.MAX_PROMPT_LINES) -> Column:
    """The text, or its first ``max_lines`` lines and a marker that names how many are left out.

    Expects decoded text, where ``\\n`` is the common separator; texts that also hold one of the rare separators are
    cut at the ``max_lines``-th separator of any kind so that the kept part is unchanged.
    """
    kept_plain = F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n"))
    kept_rare = F.regexp_extract(text, rf"(?s)\A((?:(?:(?!{K.LINE_BREAK}).)*+(?:{K.LINE_BREAK})){{{max_lines}}})", 1)
    kept = F.when(text.rlike(K.UNUSUAL_LINE_BREAK), kept_rare).otherwise(kept_plain)
    rest = (F.size(lines) - max_lines).cast("string")
    marker = F.concat(F.lit("\n# ... ["), rest, F.lit(" more lines truncated] ...\n"))
    return F.when(F.size(lines) <= max_lines, text).otherwise(F.concat(kept, marker))


def sample(text: Column, chars: int) -> Column:
    return F.left(text, F.lit(chars))


def format_text(template: str, *args: Column) -> Column:
    """Fill ``%s`` / ``%d`` places of a fixed message; plain concatenation, so it stays in generated code."""
    pieces = template.replace("%d", "%s").split("%s")
    out: list[Column] = [F.lit(pieces[0])]
    for arg, piece in zip(args, pieces[1:], strict=True):
        out += [arg.cast("string"), F.lit(piece)]
    return F.concat(*out)

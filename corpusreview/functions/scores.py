"""Column functions on scores, sizes and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpusreview import constants as K


def banded(score: Column, bands, otherwise: str) -> Column:
    """Name of the first band whose lower bound ``score`` reaches."""
    out = F.when(score >= bands[0][0], F.lit(bands[0][1]))
    for low, name in bands[1:]:
        out = out.when(score >= low, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def quality_label(score: Column) -> Column:
    return banded(score, K.QUALITY_BANDS, K.QUALITY_ELSE)


def dial_class(score: Column) -> Column:
    return banded(score, K.DIAL_BANDS, K.DIAL_ELSE)


def chip_class(score: Column) -> Column:
    return banded(score, K.CHIP_BANDS, K.CHIP_ELSE)


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties toward plus infinity."""
    return F.floor(x + 0.5)


def percent_done(current: Column, total: Column) -> Column:
    return F.when(total > 0, round_half_up(current / total * 100)).otherwise(F.lit(0).cast("bigint"))


def one_decimal(x: Column) -> Column:
    """Half-even to one decimal, taken from a DECIMAL so that ties are exact."""
    return F.bround(x.cast("decimal(28,10)"), 1)


def file_size_text(size: Column) -> Column:
    n = size.cast("decimal(20,0)")
    kib, mib = F.lit(1024).cast("decimal(10,0)"), F.lit(1048576).cast("decimal(10,0)")

    def scaled(unit: Column, name: str) -> Column:
        return F.concat(one_decimal(n / unit).cast("decimal(20,1)").cast("string"), F.lit(name))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1048576, scaled(kib, " KB"))
        .otherwise(scaled(mib, " MB"))
    )


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 2147483647))


def counted(n: Column, noun: str) -> Column:
    """``1 issue``, ``2 issues``."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def severity_rank(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.SEVERITY_ORDER.items() for x in pair])
    return F.coalesce(known[severity], F.lit(K.UNKNOWN_SEVERITY_ORDER))


def severity_label(severity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in K.SEVERITY_LABEL.items() for x in pair])
    return F.coalesce(known[severity], severity)


def known_category(category: Column) -> Column:
    return F.when(category.isin(list(K.CATEGORIES)), category).otherwise(F.lit("other"))

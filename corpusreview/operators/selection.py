"""Which files of a corpus are reviewed.

All selections are plain predicates on ``path`` / ``size`` / ``language`` and are placed before any use of ``content``:
``size`` tests reach the corpus scan as pushed filters, and a file listing is cut down before a file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import paths


def with_extension(df: DataFrame, extensions=tuple(K.LANGUAGE_BY_EXTENSION)) -> DataFrame:
    return df.filter(paths.has_extension(F.col("path"), extensions))


def drop_vendored(df: DataFrame) -> DataFrame:
    return df.filter(~paths.is_vendored(F.col("path")))


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumn("language", paths.language_of(F.col("path")))


def too_large(max_kb: int = K.MAX_FILE_SIZE_KB) -> Column:
    return F.col("size") > max_kb * 1024


def with_skip_reason(df: DataFrame, max_kb: int = K.MAX_FILE_SIZE_KB) -> DataFrame:
    """Add ``skip_reason``: NULL for files that are read, a text for files that are not."""
    return df.withColumn("skip_reason", F.when(too_large(max_kb), F.lit(K.SKIP_REASON)))


def size_guard(df: DataFrame, max_kb: int = K.MAX_FILE_SIZE_KB) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``; a file of exactly ``max_kb`` KiB is kept."""
    big = too_large(max_kb)
    return df.filter(~big), df.filter(big).withColumn("skip_reason", F.lit(K.SKIP_REASON))


def filter_languages(df: DataFrame, languages=K.DEFAULT_LANGUAGES) -> DataFrame:
    """Keep files in the wanted languages, case-insensitively; an empty list keeps nothing."""
    wanted = sorted({x.lower() for x in languages})
    return df.filter(F.lower("language").isin(wanted)) if wanted else df.filter(F.lit(False))


#: Bits of the filter that keeps rows whose key was not requested from being joined: 64 in each of so many numbers.
FILTER_WORDS = 1 << 16


def key_filter(requested: DataFrame, keys: list[str]) -> Column:
    """The bits of the hashes of all keys, as an array of fixed size: a subquery that runs with the query that holds it."""
    at = F.pmod(F.xxhash64(*keys), F.lit(64 * FILTER_WORDS))
    words = requested.select(at.alias("at"), *keys).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at % 64))")).alias("bits")
    )
    every = requested.sparkSession.range(FILTER_WORDS).join(words, F.col("id") == F.col("word"), "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return every.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")).scalar()


def restrict_paths(df: DataFrame, requested=None) -> DataFrame:
    """Keep the requested paths; no request, or an empty one, is no restriction.

    ``requested`` is a list of paths or a DataFrame with the key columns (``path``, or ``repo`` and ``path``), of any size.
    Nothing runs before the result is asked for.  Whether the request is empty, and a filter of fixed size on its keys, are
    subqueries; rows that pass the filter meet the requested keys in a join without a hint, so few rows are shuffled if
    Catalyst does not broadcast the keys.
    """
    if requested is None:
        return df
    if not isinstance(requested, DataFrame):
        requested = df.sparkSession.createDataFrame([(p,) for p in requested], "path string")
    keys = [c for c in ("repo", "path") if c in requested.columns]
    wanted = requested.select(*keys).distinct()
    all_of_it = requested.select(*keys).limit(1).agg(F.count("*").alias("n")).scalar() == 0
    at = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(64 * FILTER_WORDS))
    word = F.get(key_filter(wanted, keys), F.floor(at / 64).cast("int"))
    may = word.bitwiseAND(F.expr(f"shiftleft(1L, int(pmod(xxhash64({', '.join(keys)}), {64 * FILTER_WORDS}) % 64))")) != 0
    marked = wanted.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.lit(True).alias("_wanted"))
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    joined = df.filter(all_of_it | may).join(marked, same, "left")
    return joined.filter(all_of_it | F.col("_wanted")).select(*df.columns)


def discovery_counts(df: DataFrame, languages=K.DEFAULT_LANGUAGES, by: str = "repo") -> DataFrame:
    """Files found and files in the wanted languages per repository, in one pass over ``language``."""
    wanted = [x.lower() for x in languages]
    hit = F.lower("language").isin(wanted) if wanted else F.lit(False)
    out = df.groupBy(by).agg(F.count_if(hit).alias("files"), F.count("*").alias("total_files"))
    return out.withColumn("error", F.when(F.col("files") == 0, F.lit(K.NO_FILES_MESSAGE)))


def analysed(files: DataFrame, languages=K.DEFAULT_LANGUAGES, max_kb: int = K.MAX_FILE_SIZE_KB) -> DataFrame:
    """The files that reach the analysis: extension, folder, size and language tests, narrow and in one stage."""
    listed = with_language(drop_vendored(with_extension(files)))
    return filter_languages(size_guard(listed, max_kb)[0], languages)

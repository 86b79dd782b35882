"""Quality rules: statistics of single documents, and lines that recur across the documents of a host.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

#: Base rules: fewest words, and the largest share of words that lie in repeated windows, in percent.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_PERCENT = 20
#: A line is above the limit of its host if more distinct texts of the host hold it than this number and this share of them.
LINE_DOCS = 20
LINE_SHARE = 0.001
#: A document is depleted if the lines above the limits hold more than this share of its words, in percent.
MAX_REMOVED_PERCENT = 70
_WORD = r"[^\x20\x09-\x0D]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more.

    Windows are sorted with their places, so equal ones are neighbours; a repeated window adds its words up to the start
    of the next repeated one.
    """

    def places(ordered: Column) -> Column:
        same = lambda x, i: F.get(ordered, i)["h"].eqNullSafe(x["h"])
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        parts = F.transform(at, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(parts, F.lit(0), lambda s, x: s + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bound(ordered, lambda o: _bound(places(o), total))


def repeated_words(words: Column) -> Column:
    """Number of words of an array that lie in windows of ``WINDOW`` words found twice or more in it."""
    size = F.size(words)
    starts = F.slice(words, 1, F.greatest(size - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))
    return _bound(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))


def normal_line(line: Column) -> Column:
    """A line with A-Z in lower case and its words one space apart."""
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), r"[\x20\x09-\x0D]++", " "))


def _statistics(text: Column, host: Column) -> Column:
    """Words, characters in words, symbols, equal lines, repeated words; and a key and the words of every line that has words."""
    filled = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_host = (F.coalesce(host, F.lit("")), host.isNull())
    line_key = lambda line: F.struct(F.xxhash64(*of_host, normal_line(line)).alias("key"), F.regexp_count(line, F.lit(_WORD)).alias("words"))
    words = _bound(
        F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))
    )
    lines = _bound(filled, lambda all_: F.struct((F.size(all_) - F.size(F.array_distinct(all_))).alias("equal"), F.transform(all_, line_key).alias("keys")))
    return F.struct(
        words.alias("words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]++", "")).alias("chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("symbols"),
        lines.alias("lines"),
    )


def frequent_lines(stats: DataFrame) -> DataFrame:
    """``line``: the keys of the lines that are in more distinct texts of their host than its limits allow.

    Rows of a host with equal texts count once, so copies do not turn the lines of one document into a template.  Counts
    combine before the shuffle, so a line that is in a third of all documents is no hot key.
    """
    texts = stats.select("host", "text_key", F.array_distinct(F.col("stats.lines.keys.key")).alias("keys")).dropDuplicates(["host", "text_key"])
    texts = common.write_stage(texts, "rules-texts")
    limits = texts.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    limits = limits.select(F.col("host").alias("of_host"), F.greatest(F.lit(float(LINE_DOCS)), F.col("texts") * LINE_SHARE).alias("limit"))
    counts = texts.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # no limit is below LINE_DOCS: most lines go before the join
    counts = counts.filter(F.col("n") > LINE_DOCS)
    return counts.join(limits, F.col("host").eqNullSafe(F.col("of_host"))).filter("n > limit").select("line").distinct()


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words, kept``.

    ``source`` is the host.  Lines are normalised to lower-case A-Z and single spaces and hashed with their host; those that
    are in more distinct texts of a host than ``LINE_DOCS`` and ``LINE_SHARE`` of its texts are removed.  A document fails
    the base rules with fewer than ``MIN_WORDS`` words or more than ``MAX_REPEATED_PERCENT`` % of them in repeated windows;
    else it is kept unless the removed lines hold more than ``MAX_REMOVED_PERCENT`` % of its words.

    A null text is empty and fails, as does one without words.  A null source is a host of its own.  Every row gives a row,
    repeated rows and null ids too; equal rows get equal verdicts.  Very long texts are worked on whole, in time n log n.
    No rows give no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("host"), F.xxhash64(text).alias("text_key"), _statistics(text, F.col("source")).alias("stats"))
    stats = common.write_stage(rows.withColumn("row", F.monotonically_increasing_id()), "rules-statistics")
    lines = stats.select("row", F.explode("stats.lines.keys").alias("of")).select("row", F.col("of.key").alias("line"), "of.words")
    removed = lines.join(frequent_lines(stats), "line").groupBy("row").agg(F.count(F.lit(1)).alias("removed_lines"), F.sum("words").alias("removed_words"))
    found = stats.drop("text_key").join(removed.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left")
    n = F.col("stats.words.n").cast("bigint")
    repeated = F.col("stats.words.repeated").cast("bigint")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
    gone = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    return found.select(
        "doc_id",
        n.alias("n_words"),
        F.col("stats.chars").cast("bigint").alias("word_chars"),
        F.col("stats.symbols").cast("bigint").alias("n_symbols"),
        F.col("stats.lines.equal").cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.coalesce("removed_lines", F.lit(0)).cast("bigint").alias("n_removed_lines"),
        gone.alias("n_removed_words"),
        (~failed & (100 * gone <= MAX_REMOVED_PERCENT * n)).alias("kept"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs),
windows AS (
  SELECT row, i, [w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, lead(w, 4) OVER s] AS five, lead(i, 4) OVER s AS last
  FROM words WINDOW s AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, unnest(list(i)) AS i FROM windows WHERE last IS NOT NULL GROUP BY row, five HAVING count(*) > 1),
repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(5) AS r(k) GROUP BY row),
lines AS (SELECT row, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
filled AS (
  SELECT row, source, md5(text) AS text_key, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         array_to_string(regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), ' ') AS normal
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
equal AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY row),
hosts AS (SELECT source, count(DISTINCT md5(text)) AS texts FROM docs GROUP BY source),
frequent AS (
  SELECT f.source, f.normal FROM filled f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, f.normal, h.texts HAVING count(DISTINCT f.text_key) > greatest({float(LINE_DOCS)}::DOUBLE, h.texts * {LINE_SHARE}::DOUBLE)),
removed AS (
  SELECT row, count(*) AS n_lines, sum(n)::BIGINT AS n_words FROM filled f JOIN frequent q ON f.source IS NOT DISTINCT FROM q.source AND f.normal = q.normal GROUP BY row),
found AS (
  SELECT d.doc_id, len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
         length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(e.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(g.n_lines, 0)::BIGINT AS n_removed_lines, coalesce(g.n_words, 0)::BIGINT AS n_removed_words
  FROM docs d LEFT JOIN equal e USING (row) LEFT JOIN repeated r USING (row) LEFT JOIN removed g USING (row)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM found)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
       NOT base_failed AND 100 * n_removed_words <= {MAX_REMOVED_PERCENT} * n_words AS kept FROM judged
"""

"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusreview.llm import common

#: Weights that sources get in code point order, again and again.
WEIGHTS = (3.0, 1.0, 2.0)
#: How much the weight of a source changes over the run, by its place in ``WEIGHTS``: at time t in 0..1 the weight is its
#: mean times ``1 + tilt * (2 t - 1)``, so a source with a negative tilt is seen early and one with a positive tilt late.
TILTS = (-0.5, 0.0, 0.5)
#: Words of the mix as a share of all words, and how often a document may be repeated.
SHARE = 1.5
PASSES = 2
#: Hex digits of the order key that name a slice of a source: 16 ** 3 slices keep a hot source out of a single task.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]++")).cast("bigint")


def _by_place(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), place % len(values) + 1)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source with its size and target in words.

    Targets share the mix by weight and stop at ``passes`` times the source's size; the excess is shared again.  In the order
    of cap per weight, the sources before the first one that stays below its cap are capped; the level of the others is the
    largest of (mix - caps so far) / (weights from here on).  Input is one row per source, so these windows hold sources only.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    return (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", _by_place(weights, F.col("place")))
        .withColumn("tilt", _by_place(tilts, F.col("place")))
        .withColumn("cap", F.col("source_size") * float(passes))
        .withColumn("mix", F.sum("source_size").over(Window.partitionBy()) * share)
        .withColumn("caps", F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.col("mix") - F.col("caps")) / F.col("left")).over(Window.partitionBy()))
        .select("source", "source_size", "tilt", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def position(done: Column, target: Column, tilt: Column) -> Column:
    """The time in 0..1 at which the integrated weight of a source has asked for ``done`` of its ``target`` words."""
    part = done / F.nullif(target, F.lit(0.0))
    rise = F.lit(1.0) - tilt
    bent = (F.sqrt(rise * rise + F.lit(4.0) * tilt * part) - rise) / F.nullif(F.lit(2.0) * tilt, F.lit(0.0))
    return F.when(tilt == 0.0, part).otherwise(bent)


def mixture(docs: DataFrame, **shape: object) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, again, position, position_again`` of every document.

    Inside a source documents stand in the order of the MD5 of their id, so reruns agree.  The mix reads this order until
    the target is met, at most ``PASSES`` (two) times: ``taken`` are all words it takes, ``again`` those of the second pass.
    The document at which the target is met is cut short, so the words taken are the target rounded down.  ``position`` is
    the time at which the weight schedule asks for the middle of what is taken.

    A null source is a source of its own, after all others; null or empty texts have size 0, are taken 0 times and have no
    position; documents with equal ids and sizes are interchangeable.  Other columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = common.write_stage(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            key.alias("key"),
            F.substring(key, 1, SLICE_DIGITS).alias("slice"),
        ),
        "mixing-sizes",
    )
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **shape)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    offsets = slices.withColumn("before", F.sum("slice_size").over(earlier) - F.col("slice_size")).alias("s")
    offsets = offsets.join(targets.alias("t"), F.expr("s.source <=> t.source")).select(
        F.col("s.source").alias("of_source"), F.col("slice").alias("of_slice"), "before", "source_size", "target", "tilt"
    )
    inside = Window.partitionBy("source", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(inside) - F.col("size")
    placed = sized.join(offsets, F.expr("source <=> of_source AND slice = of_slice")).withColumn("start", start)
    wanted = F.floor("target").cast("bigint")
    clip = lambda words: F.greatest(F.lit(0).cast("bigint"), F.least("size", words))
    first, again = clip(wanted - F.col("start")), clip(wanted - F.col("source_size") - F.col("start"))
    middle = lambda begin, words: begin + words / F.lit(2.0)
    return (
        placed.withColumn("first", first)
        .withColumn("again", again)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            (F.col("first") + F.col("again")).alias("taken"),
            "again",
            F.when(F.col("first") > 0, position(middle(F.col("start"), F.col("first")), F.col("target"), F.col("tilt"))).alias("position"),
            F.when(
                F.col("again") > 0,
                position(middle(F.col("source_size") + F.col("start"), F.col("again")), F.col("target"), F.col("tilt")),
            ).alias("position_again"),
        )
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, range-sorted by their first training position; those that the mix leaves out come last."""
    return (
        mixture(common.table(spark, sf_dir, "documents"))
        .select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")
        .orderBy(F.asc_nulls_last("position"), "doc_id")
    )


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sources),
weighted AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         CASE place % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS mix FROM placed),
levels AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) - cap AS caps,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighted),
targets AS (
  SELECT source, source_size, tilt, least(cap, (max((mix - caps) / rest) OVER ()) * weight) AS target FROM levels),
started AS (
  SELECT s.*, t.source_size, t.tilt, t.target,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS fst,
         greatest(0, least(size, floor(target)::BIGINT - source_size - start)) AS again FROM started),
parts AS (
  SELECT *, (start + fst / 2.0::DOUBLE) / nullif(target, 0) AS p1, (source_size + start + again / 2.0::DOUBLE) / nullif(target, 0) AS p2,
         1.0::DOUBLE - tilt AS rise FROM cut)
SELECT doc_id, size, source_size, target, (fst + again)::BIGINT AS taken,
       CASE WHEN fst > 0 THEN CASE WHEN tilt = 0 THEN p1
         ELSE (sqrt(rise * rise + 4.0::DOUBLE * tilt * p1) - rise) / nullif(2.0::DOUBLE * tilt, 0) END END AS position,
       CASE WHEN again > 0 THEN CASE WHEN tilt = 0 THEN p2
         ELSE (sqrt(rise * rise + 4.0::DOUBLE * tilt * p2) - rise) / nullif(2.0::DOUBLE * tilt, 0) END END AS position_again
FROM parts
"""

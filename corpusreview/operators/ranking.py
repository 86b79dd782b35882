"""Running sums and positions inside groups that may be very large.

``sum() over (partition by run order by seq)`` puts a whole run into one task, and one run may hold a third of all
rows.  Here a group is cut into blocks of the (integer) order column: rows are summed inside their block, block totals
are summed over the group in the same way, with blocks of blocks, and the two are added.  A window of any level holds
at most as many entries as the level has values - a million rows, or four million block totals - whether ids are dense
or sparse and however large the group is.

``range_position`` numbers rows by any sort key - a collated text, a time - where no integer column orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusreview.session import fresh_folder

#: Values of the order column in a block, and blocks in a block of the next level.
BLOCKS = (1 << 20, 1 << 22)


def running_sum(
    df: DataFrame, value, group: list[str], order: list[str], into: str, lead: tuple[str, ...] = (), blocks=BLOCKS
) -> DataFrame:
    """Add ``into``: running sum of ``value`` within ``group`` in the order ``lead + order``.

    ``order[0]`` is an integer; ``lead`` are low-cardinality columns sorted before it (a severity rank).  Rows stay
    whole: blocks only decide where a row is summed.
    """
    valued = df.withColumn("_value", value)
    if not blocks:
        upto = W.partitionBy(*group).orderBy(*lead, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return valued.withColumn(into, F.sum("_value").over(upto)).select(*df.columns, into)
    block = f"_block{len(blocks)}"
    keys = [*group, *lead, block]
    blocked = valued.withColumn(block, F.floor(F.col(order[0]) / F.lit(blocks[0])))
    totals = blocked.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    ends = running_sum(totals, F.col("_total"), group, [block], "_end", lead, blocks[1:])
    offsets = ends.select(*[F.col(k).alias(f"_o_{k}") for k in keys], (F.col("_end") - F.col("_total")).alias("_offset"))
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = blocked.withColumn("_local", F.sum("_value").over(inside))
    same_block = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return local.join(offsets, same_block).select(*df.columns, (F.col("_local") + F.col("_offset")).alias(into))


def position(df: DataFrame, group: list[str], order: list[str], into: str = "position", lead=(), blocks=BLOCKS):
    """Add the 1-based position of each row in its group."""
    return running_sum(df, F.lit(1), group, order, into, tuple(lead), blocks)


def range_position(
    df: DataFrame, group: list[str], order: list[Column], into: str = "position", descending: tuple[int, ...] = ()
) -> DataFrame:
    """Add the 1-based position of each row in its group, in the order of any keys; rows come in that order.

    ``descending`` are the places in ``order`` of the keys that fall.

    Rows are dealt by ranges of (group, order) and written to the shared folder in order, so a large group lies in many
    partitions.  The rows of each partition and group are counted; the counts before a partition, a row per partition and
    group, are added to the places inside it.  Ties in ``order`` have no fixed order.
    """
    spark = df.sparkSession
    keys = [F.col(g) for g in group] + order
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    falls = {f"_k{len(group) + i}" for i in descending}
    sorts = [F.desc(k) if k in falls else F.asc(k) for k in named]
    ordered = df.withColumns(named).repartitionByRange(*sorts).sortWithinPartitions(*sorts).drop(*named)
    folder = fresh_folder(spark, "positions")
    placed = ordered.withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    shift = F.sum("_rows").over(before) - F.col("_rows") - F.col("_low") + 1
    shifts = parts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_of"), shift.alias("_shift"))
    same = [F.col("_part") == F.col("_of"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]]
    return placed.join(shifts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(into))

"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusreview.llm import common


#: Rounds that compare members of a list with one of them before the rest is compared pair by pair.
STAR_ROUNDS = 3
#: Candidates for each open node by which another such round is worth its while: with fewer, one member is near to hardly any other.
FEW = 1 / 16


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links ``u, v``: every node is tied to a smaller node of its component."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of all linked nodes; the label is the smallest node of the component.

    ``links`` has ``u, v`` of any comparable type.  Every step is a few joins and aggregates over the links, written to the
    shared folder; neither links nor components come to the driver.  Steps are repeated until the links form stars, which
    takes about the logarithm of the longest chain.
    """
    return _contracted(common.write_stage(links.filter("u <> v").distinct(), "links"))


def _contracted(now: DataFrame) -> DataFrame:
    """``components`` of links of different nodes from a table."""
    mark = None
    while True:
        now = common.write_stage(_stars(now), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after the links ``found``."""
    ends = found.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(
        labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v"
    )
    merged = components(ends.select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    merged = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return common.write_stage(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _first_labels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after the first links ``found``, each once, from a table: ``_joined`` where every node is its own label."""
    merged = _contracted(found).withColumnRenamed("node", "of")
    return common.write_stage(nodes.join(merged, F.col("node") == F.col("of"), "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def linked_by_lists(
    lists: DataFrame, may_link: Callable[[str, str], Column], verified: Callable[[DataFrame], DataFrame], pairs: DataFrame | None = None, whole: int = 0
) -> DataFrame:
    """``node, label`` of the nodes of all lists; the label is the smallest node that links reach.

    ``lists`` has ``key, node`` and columns that ``may_link(a, b)``, a condition on two aliases, reads; nodes that share a key
    and pass it are candidates, ``verified`` gives those of the pairs ``u, v`` that link.  In a few rounds the members of every
    list that spans several components are compared with one of them, so a large group of copies costs about one comparison
    for each member and list; once few members are near to that one, or after the last round, all candidates that still lie in
    different components are compared.  Pairs inside a
    component cannot change it, so no link between components is left out, and no pair is verified twice.

    ``pairs`` are further candidates ``u < v``, each once, from a table; they are verified first, and every list then has
    two members at least.  Open lists whose members have up to ``whole`` others on average are compared pair by pair at once.
    """
    payload = [c for c in lists.columns if c not in ("key", "node")]
    if pairs is None:
        lists = lists.join(lists.groupBy("key").count().filter("count > 1").select("key"), "key")
    lists = common.write_stage(lists.select("key", "node", *payload), "lists")
    nodes = lists.select("node")
    if pairs is not None:
        nodes = nodes.unionAll(pairs.select("u")).unionAll(pairs.select("v"))
    nodes = nodes.distinct()
    if pairs is None:
        labels = common.write_stage(nodes.select("node", F.col("node").alias("label")), "labels")
    else:
        labels = _first_labels(nodes, common.write_stage(verified(pairs), "links"))
    done, met = pairs, 1.0
    for turn in range(STAR_ROUNDS + 1):
        placed = lists.join(labels, "node")
        spans = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        placed = common.write_stage(placed.join(spans.select("key"), "key"), "open-lists")
        sizes = placed.groupBy("key").count().agg(F.sum("count"), F.sum(F.expr("double(count) * count"))).first()
        if not sizes[0]:
            break
        last = turn == STAR_ROUNDS or sizes[1] <= whole * sizes[0] or met < FEW
        centres, once = placed, F.col("a.node") < F.col("b.node")
        if not last:
            once = F.lit(True)
            # the first round takes the same member of overlapping lists, later rounds others
            order = F.xxhash64("node", F.lit(turn)) if turn else F.col("node")
            centres = placed.groupBy("key").agg(F.min_by(F.struct("node", "label", *payload), order).alias("c")).select("key", "c.*")
        more = (
            placed.alias("a")
            .join(centres.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & once & may_link("a", "b"))
            .select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
            .distinct()
        )
        if done is not None:
            more = more.join(done, ["u", "v"], "left_anti")
        more = common.write_stage(more, "pairs")
        if not last:
            met = more.count() / placed.select("node").distinct().count()
        found = common.write_stage(verified(more), "links")
        if not found.isEmpty():
            labels = _joined(labels, found)
        done = more if done is None else done.unionAll(more)
        if last:
            break
        lists = placed.drop("label")
    return labels

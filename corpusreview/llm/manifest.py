"""Merkle manifest of a table: leaves rolled up digit by digit into nested structs, which unfold into proofs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusreview.llm import common

#: Binary digits of the rank that one roll-up groups away: a block is one row of at most ``2 ** BLOCK_BITS`` nodes.
BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A row is tampered with, for the verification, where this divides the crc32 of its id.
TAMPER = 7


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank``, the place of each row in its ``grp`` from 0 on, and ``total``, the rows of the group.

    Rows are range-sorted and written with their places in the partitions; counts per partition and group give the places
    before each partition.  No task holds a group.  Rows that are equal in ``order`` have to be interchangeable.
    """
    keys = [F.asc_nulls_first("grp"), *[F.asc_nulls_first(c) for c in order]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = common.write_stage(placed, "manifest-ranks")
    part = F.shiftright("at", 33)
    runs = placed.groupBy("grp", part.alias("run")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    all_runs = Window.partitionBy("grp")
    earlier = all_runs.orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.select(
        F.col("grp").alias("run_grp"), "run", (F.sum("n").over(earlier) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(all_runs).alias("total")
    )
    found = placed.join(runs, F.col("grp").eqNullSafe(F.col("run_grp")) & (part == F.col("run")))
    return found.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """``grp, total, rank, node``: one row per block of ``2 ** BLOCK_BITS`` ranks, with the block's tree as a nested struct.

    ``nodes`` has ``grp, total, rank, node``; ``node.h`` is the digest.  The digits of the rank are columns, and each
    aggregate groups one of them away, so two children become a struct ``h, kids``.  All aggregates keep the first
    partitioning and its sort order.  A group that is down to one node is done; its node is handed on as it is.
    """
    digits = [F.shiftright("rank", i).bitwiseAND(1).cast("int").alias(f"digit{i}") for i in range(BLOCK_BITS)]
    rows = nodes.select("grp", "total", F.shiftright("rank", BLOCK_BITS).alias("block"), *digits, "node").repartition("grp", "block")
    for level in range(BLOCK_BITS):
        side = lambda i: F.min(F.when(F.col(f"digit{level}") == i, F.col("node"))).alias(f"side{i}")  # noqa: B023, E731
        rows = rows.groupBy("grp", "total", "block", *[f"digit{i}" for i in reversed(range(level + 1, BLOCK_BITS))]).agg(side(0), side(1))
        both = digest(hex_text(F.col("side0.h")), F.coalesce(hex_text(F.col("side1.h")), F.lit("")))
        joined = F.when(F.col("total") > 1 << level, F.unhex(both)).otherwise(F.col("side0.h"))
        rows = rows.withColumn("node", F.struct(joined.alias("h"), F.array_compact(F.array("side0", "side1")).alias("kids"))).drop("side0", "side1")
    return rows.select("grp", "total", F.col("block").alias("rank"), "node")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def unfolded(node: Column, above: Column, total: Column, level: int) -> Column:
    """The entries of a block as ``item, path``; a path lists the siblings ``l`` or ``r`` of each level from the entry up."""
    if not level:
        return F.array(F.struct(node.alias("item"), above.alias("path")))

    def below(kid: Column, place: Column) -> Column:
        other = F.get(node["kids"], 1 - place)["h"]
        step = F.struct(F.when(place == 1, other).alias("l"), F.when(place == 0, other).alias("r"))
        path = F.when(total > 1 << (level - 1), F.concat(F.array(step), above)).otherwise(above)
        return _bound(path, lambda bound: unfolded(kid, bound, total, level - 1))

    return F.flatten(F.transform(node["kids"], below))


def tree(rows: DataFrame, *order: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every tier, the lowest first, and ``grp, h``: the digest at the top of each group.

    ``rows`` has ``grp``, the columns of ``order`` and ``node``, a struct with the digest ``h``.
    """
    nodes = ranked(rows, *order).select("grp", "total", "rank", "node")
    tiers = []
    while True:
        tiers.append(common.write_stage(rolled_up(nodes), "manifest-blocks"))
        if (tiers[-1].agg(F.max("total")).first()[0] or 0) <= 1 << BLOCK_BITS:
            return tiers, tiers[-1].select("grp", F.col("node.h").alias("h"))
        smaller = F.shiftright(F.col("total") + ((1 << BLOCK_BITS) - 1), BLOCK_BITS)
        nodes = tiers[-1].select("grp", smaller.alias("total"), "rank", F.struct("node.h", F.col("rank").alias("id")).alias("node"))


_PATH = "array<struct<l: binary, r: binary>>"


def proofs(tiers: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """``grp, item, path`` and the ``carried`` columns of ``tops`` for every entry of the lowest tier.

    ``tops`` has ``grp, above`` (the path over the group's top node).  A block unfolds by ``transform`` and ``explode``; what
    lies over a block reaches it as one row for the block, never for its entries.
    """
    above = tops.select(F.col("grp").alias("of_grp"), F.lit(0).cast("bigint").alias("of_rank"), "above", *carried)
    for tier in reversed(tiers):
        blocks = tier.join(above, F.col("grp").eqNullSafe(F.col("of_grp")) & (F.col("rank") == F.col("of_rank")))
        entries = blocks.select("grp", *carried, F.explode(unfolded(F.col("node"), F.col("above"), F.col("total"), BLOCK_BITS)).alias("entry"))
        found = entries.select("grp", *carried, "entry.item", "entry.path")
        if tier is not tiers[0]:
            above = found.select(F.col("grp").alias("of_grp"), F.col("item.id").alias("of_rank"), F.col("path").alias("above"), *carried)
    return found


def folded(start: Column, path: Column) -> Column:
    """The digest at the top of a path, from the digest of its entry; both as hex."""
    beside = lambda sibling: F.coalesce(hex_text(sibling), F.lit(""))
    return F.aggregate(path, start, lambda h, step: digest(beside(step["l"]), h, beside(step["r"])))


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of the five ``FIELDS`` of a row, each with its length, so null and empty texts differ and very long
    texts are hashed whole.  Per ``lang`` (null is a group of its own, the first) leaves ascend by ``doc_id`` (null first),
    then by leaf, so ties and repeated rows have one order; each has a leaf and a proof of its own.  ``proof_sha256`` is the
    digest of the siblings up to the root.  ``folded_root`` is the top of the path from the leaf of the row as it is given
    to the verification, which is tampered with where ``TAMPER`` divides the crc32 of its id (a null id is never) and its
    ``n_chars`` is not null.  No rows give no rows.  Other columns are ignored.
    """
    touched = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(TAMPER)) == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)
    leaves = docs.select(
        F.col("lang").alias("grp"),
        "doc_id",
        F.unhex(leaf_digest()).alias("leaf"),
        F.when(touched, F.unhex(leaf_digest(n_chars=more))).alias("given"),
    )
    node = F.struct(F.col("leaf").alias("h"), F.col("doc_id").alias("id"), "given").alias("node")
    leaves = common.write_stage(leaves, "manifest-leaves")
    tiers, subroots = tree(leaves.select("grp", "doc_id", "leaf", node), "doc_id", "leaf")
    langs = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("lang"), F.struct("h", F.col("grp").alias("id")).alias("node"))
    lang_tiers, root = tree(langs, "lang")
    tops = proofs(lang_tiers, root.select("grp", F.array().cast(_PATH).alias("above"), F.col("h").alias("root")), ["root"])
    tops = tops.select(F.col("item.id").alias("grp"), F.col("path").alias("above"), F.col("item.h").alias("subroot"), "root")
    found = proofs(tiers, tops, ["subroot", "root"])
    siblings = F.array_join(F.transform("path", lambda step: hex_text(F.coalesce(step["l"], step["r"]))), "")
    checked = found.select(
        F.col("item.id").alias("doc_id"),
        hex_text(F.col("item.h")).alias("leaf"),
        hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(hex_text(F.coalesce("item.given", "item.h")), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(common.table(spark, sf_dir, "documents"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c if c != "n_chars" else n_chars) for c in FIELDS) + ")"


#: crc32 of ASCII text bit by bit: each byte is followed by eight steps of the register.
_SQL_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT)"""


def _sql_tree(name: str, source: str, grp: str) -> str:
    """Nodes of all levels: ``g, level, i, h, n``; a level has n nodes, the last level one."""
    return f"""{name} AS (
  SELECT {grp} AS g, 0 AS level, i, h, n FROM {source}
  UNION ALL
  SELECT g, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2)
  FROM {name} WHERE n > 1 GROUP BY g, i // 2)"""


OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_sql_leaf('n_chars')} AS h,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {_SQL_CRC} % {TAMPER} = 0 THEN {_sql_leaf('(n_chars::HUGEINT + 1)')} END AS given FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_sql_tree('low', 'placed', 'lang')},
subroots AS (
  SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_tree('high', 'subroots', '0')},
low_tops AS (SELECT g, max(level) AS top FROM low GROUP BY g),
near_path AS (
  SELECT p.doc_id, p.h AS leaf, p.lang, p.i, b.level,  b.h
  FROM placed p LEFT JOIN low_tops t ON p.lang IS NOT DISTINCT FROM t.g
  LEFT JOIN low b ON b.g IS NOT DISTINCT FROM p.lang AND b.level < t.top AND b.i = xor(p.i >> b.level, 1)),
far_path AS (
  SELECT s.lang, b.level,  b.h FROM subroots s JOIN high b ON b.level < (SELECT max(level) FROM high) AND b.i = xor(s.i >> b.level, 1)),
siblings AS (
  SELECT lang, i, level, h FROM near_path WHERE level IS NOT NULL
  UNION ALL
  SELECT p.lang, p.i, 1000 + u.level, u.h FROM placed p JOIN far_path u ON p.lang IS NOT DISTINCT FROM u.lang),
paths AS (SELECT lang, i, string_agg(h, '' ORDER BY level) AS path FROM siblings GROUP BY lang, i),
folds AS (
  SELECT p.lang, p.i AS leaf_i, p.i, p.n, 0 AS phase, coalesce(given, h) AS h FROM placed p
  UNION ALL
  SELECT f.lang, f.leaf_i, CASE WHEN f.n > 1 THEN f.i >> 1 ELSE s.i END, CASE WHEN f.n > 1 THEN (f.n + 1) // 2 ELSE s.n END,
         CASE WHEN f.n > 1 THEN f.phase ELSE 1 END,
         CASE WHEN f.n = 1 THEN f.h WHEN f.i % 2 = 1 THEN sha256(b.h || f.h) ELSE sha256(f.h || coalesce(b.h, '')) END
  FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN (SELECT 0 AS phase, g, i, n, h FROM low UNION ALL SELECT 1, s.lang, b.i, b.n, b.h FROM high b CROSS JOIN subroots s) b
    ON b.phase = f.phase AND b.g IS NOT DISTINCT FROM f.lang AND b.n = f.n AND b.i = xor(f.i, 1)
  WHERE f.n > 1 OR f.phase = 0)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(t.path, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
CROSS JOIN (SELECT h FROM high WHERE n = 1) r
JOIN folds f ON f.phase = 1 AND f.n = 1 AND f.lang IS NOT DISTINCT FROM p.lang AND f.leaf_i = p.i
LEFT JOIN paths t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.i
"""

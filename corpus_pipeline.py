"""From raw documents to token ids: quality, line dedup, near duplicates, mixing and encoding, one table after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import bpe, common, lines, mixing, ngram_join, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: One stage is not SQL (a learned classifier), so the rows of run() have no SQL twin; tests hold them against plain Python.
ORACLE_SQL = None
#: Pairs of tokens that a worker of the encoding remembers, and bytes of text it works on at a time.
REMEMBERED = 500_000
CHUNK_BYTES = 1 << 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the model learns from the labelled ones among them.

    A null text is scored as an empty one; texts of any length are scored whole; equal texts get equal scores, and repeated
    rows go or stay together.  Labels of unknown or null ids are ignored.  No rows give no rows.  Columns other than those
    of documents are dropped, here and in all later stages.
    """
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.select(*COLUMNS).filter(quality.text_score(model)(F.col("text")) >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another document, or an earlier line, keeps; those with no words left go.

    Null, empty and blank texts have no lines to lose and stay as they are.  Of a group of lines the one with the smallest
    id (null first), then text key, then number stays; rows with equal id and text are one document.  No rows give no rows.
    """
    cleaned = lines.dedup_lines(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | (mixing.word_count(F.col("text")) > 0))
    n_chars = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("text"))
    return cleaned.select("row.doc_id", "text", "row.lang", "row.source", n_chars.cast("bigint").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, then text key.

    Rows with equal id and text are copies and become one; documents without words link with nothing and stay.
    """
    groups = ngram_join.grouped_documents(docs)
    first = groups.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    kept = first.unionAll(groups.filter("label IS NULL").select("doc_id", "text_key")).distinct()
    # one pair of keys without nulls for the join and the last step, so that texts are shuffled once
    id_key = F.coalesce("doc_id", F.lit(-(2**63))).alias("id_key")
    rows = docs.select(*COLUMNS, id_key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    rows = rows.join(kept.select(id_key, "text_key").distinct(), ["id_key", "text_key"], "left_semi")
    return rows.dropDuplicates(["id_key", "text_key"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training set in the order of the curriculum: documents as often as the mix takes them, others not at all.

    The document at which a source's target is met is kept whole.  A null source is a source of its own; null and empty
    texts have no words and are not taken; rows with equal id and size get the same places.  No rows give no rows.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    mix = mixing.mixture(docs).select(F.col("doc_id").alias("of_id"), F.col("size").alias("of_size"), "taken", "position", "position_again")
    mix = mix.groupBy("of_id", "of_size").agg(*[F.min(c).alias(c) for c in ("position", "position_again")])
    rows = docs.select(*COLUMNS).join(mix, F.col("doc_id").eqNullSafe(F.col("of_id")) & (mixing.word_count(F.col("text")) == F.col("of_size")))
    times = F.array_compact(F.array("position", "position_again"))
    return (
        rows.select(*COLUMNS, key.alias("text_key"), F.explode(times).alias("at"))
        .orderBy("at", "doc_id", "text_key")
        .select(*COLUMNS)
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with counts and digests that show that they decode.

    A null or empty text has no ids; texts of any length are encoded whole; each row of the mix gives a row, so what it
    repeats is repeated; no rows give no rows.  The workers remember fewer pairs than those of a query of their own, and get
    small batches, as the stages before have taken memory too; the rows, which are short, are written for that.
    """
    digests = bpe.encode_digests(docs, bpe.word_tokenizer(), remembered=REMEMBERED, chunk_bytes=CHUNK_BYTES)
    return common.write_stage(digests, "pipeline-digests")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each writes a table to the shared folder, which the next one reads."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""One-permutation MinHash fingerprints of documents and of an edited twin of each."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

#: Bins of the one permutation, and the low-order bits that are kept of each bin's minimum.
BINS = 256
BITS = 8
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LAST = -(2**63)


def _donors(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins: an empty bin copies the first filled one of its order."""
    seeds = common.mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(0x51ED270B))
    return np.argsort(seeds.reshape(bins, bins), axis=1)


def signatures(texts: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The packed low-order bits of each text (texts x bins, one byte each), and which texts have shingles at all.

    Every shingle hash is used once: its top bits choose the bin, the rest competes for the minimum.  Bins that stay empty
    are filled by optimal densification.
    """
    codes, counts, dictionary = common.words(texts)
    hashes, owner = common.shingles(common.hash_words(dictionary)[codes], counts)
    shift = np.uint64(64 - int(np.log2(bins)))
    lowest = np.full(len(texts) * bins, _FREE)
    np.minimum.at(lowest, owner * bins + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    lowest = lowest.reshape(len(texts), bins)
    filled = lowest != _FREE
    some = counts > 0
    donors = _donors(bins)
    rows = np.flatnonzero(some & ~filled.all(axis=1))
    source, open_ = lowest[rows], ~filled[rows]
    result = source.copy()
    for turn in range(bins):
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            break
        lent = source[live][:, donors[:, turn]]
        take = open_[live] & (lent != _FREE)
        result[live] = np.where(take, lent, result[live])
        open_[live] &= ~take
    lowest[rows] = result
    return (lowest & np.uint64(2**BITS - 1)).astype(np.uint8), some


def likeness(left: np.ndarray, right: np.ndarray, left_some: np.ndarray, right_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of row pairs: the share of equal bins less the share that agrees by chance."""
    chance = 2.0**-BITS
    equal = (left == right).mean(axis=1)
    estimate = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(left_some & right_some, estimate, (left_some == right_some).astype(float))


def packed(signature: np.ndarray, some: bool) -> str:
    return base64.b64encode(signature.tobytes()).decode() if some else ""


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _fingerprint_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each followed by its next document; the last of a part is a copy that gives no row."""
    held: pa.Table | None = None
    for piece in common.text_chunks(batches):
        rows = pa.Table.from_batches([piece])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows < 2:
            continue
        own = np.flatnonzero(rows["copy"].to_numpy()[:-1] == 0)
        if not len(own):
            continue
        column = common.plain_texts(rows["text"].combine_chunks())
        texts = column.to_pylist()
        edited = []
        for i in own:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        marks, some = signatures(column)
        edited_marks, edited_some = signatures(pa.array(edited, pa.large_string()))
        yield pa.record_batch(
            {
                "doc_id": rows["doc_id"].combine_chunks().take(pa.array(own)),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                "fingerprint": pa.array([packed(marks[i], some[i]) for i in own]),
                "edited_fingerprint": pa.array([packed(m, s) for m, s in zip(edited_marks, edited_some)]),
                "near_edited": pa.array(likeness(marks[own], edited_marks, some[own], edited_some)),
                "near_next": pa.array(likeness(marks[own], marks[own + 1], some[own], some[own + 1])),
            }
        )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited twin (second half replaced by the start of the next document).

    Documents are ordered by descending ``doc_id`` (null last, equal ids by text); after the last comes the first.  The id
    range is cut at quantiles into parts, a fixed multiple of the shuffle partitions, and the first document of each part is
    sent along to the part before it, so every text is shuffled once whatever the number of rows.  A null text counts as
    empty; an empty text has the empty fingerprint, is like another empty one (1.0) and unlike all others (0.0).  Other
    columns are ignored.
    """
    spark = docs.sparkSession
    partitions = common.shuffle_partitions(spark)
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("key"))
    wanted = 8 * partitions
    found = rows.select(
        F.percentile_approx("key", [i / wanted for i in range(1, wanted)] or [0.5], 20 * wanted).alias("cuts")
    ).first()
    cuts = np.unique(np.array((found and found["cuts"]) or [], dtype=np.int64))

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "left").astype(np.int32))

    placed = rows.withColumn("part", part_of("key"))
    # one row per part: their number is fixed by the shuffle partitions, not by the data
    heads = placed.select("part", "key").groupBy("part").agg(F.max("key").alias("key")).orderBy("part").collect()
    keys = np.array([r["key"] for r in heads], dtype=np.int64)
    before = np.array([heads[(i + 1) % len(heads)]["part"] for i in range(len(heads))], dtype=np.int32)

    @F.pandas_udf("int")
    def copy_to(key: pd.Series) -> pd.Series:
        if not len(keys):
            return pd.Series(np.full(len(key), -1, dtype=np.int32))
        at = np.minimum(np.searchsorted(keys, key.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == key.to_numpy(), before[at], -1).astype(np.int32))

    runs = (
        placed.withColumn("target", copy_to("key"))
        .withColumn(
            "place",
            F.explode(
                F.when(F.col("target") < 0, F.array(F.struct("part", F.lit(0).alias("copy")))).otherwise(
                    F.array(
                        F.struct("part", F.lit(0).alias("copy")),
                        F.struct(F.col("target").alias("part"), F.lit(1).alias("copy")),
                    )
                )
            ),
        )
        .select("doc_id", "text", "key", F.col("place.part").alias("part"), F.col("place.copy").alias("copy"))
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "copy", F.desc("key"), F.xxhash64("text"))
        .select("doc_id", "text", "copy")
    )
    return runs.mapInArrow(_fingerprint_runs, _SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))

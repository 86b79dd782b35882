"""Quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

#: Random features, ridge penalty per training row, bins of raw scores for the calibration.
FEATURES = 384
PENALTY = 1e-5
BINS = 2048
THRESHOLD = 0.3
#: Bytes of text whose words are counted at a time: they take many times the size of the text.
PIECE_BYTES = 1 << 20
STATISTICS = (
    "log characters", "log words", "word length", "spread of word lengths", "capitals", "digits", "punctuation", "symbols",
    "exclamation marks", "distinct words", "words equal to the one before", "most frequent word", "short words",
    "words in capitals", "capitalised words", "words without letters", "line breaks", "letters outside ASCII", "full stops",
    "log longest word",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """The statistics of each whole text, texts x statistics; an empty text has zeros."""
    codes, counts, dictionary = common.words(texts, lower=False)
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)

    def per_word(values: pa.Array) -> np.ndarray:
        return values.to_numpy(zero_copy_only=False).astype(float)

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values[codes], minlength=n)

    def count(pattern: str) -> np.ndarray:
        return per_word(pc.count_substring_regex(dictionary, pattern))

    length = per_word(pc.utf8_length(dictionary))
    letters, capitals, digits = count(r"\p{L}"), count(r"\p{Lu}"), count(r"\p{N}")
    marks, shouts, stops = count(r"[.,;:?'\"()\-]"), count("!"), count(r"\.")
    foreign = count(r"[^\x00-\x7F]")
    words = np.maximum(counts, 1).astype(float)
    chars = np.maximum(total(length), 1.0)
    in_words = np.maximum(total(letters), 1.0)
    mean = total(length) / words
    pairs, times = np.unique(owner * max(len(dictionary), 1) + codes, return_counts=True)
    of = pairs // max(len(dictionary), 1)
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length[codes])
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    whole = per_word(pc.utf8_length(texts))
    return np.column_stack(
        [
            np.log1p(whole),
            np.log1p(counts),
            mean,
            np.sqrt(np.maximum(total(length**2) / words - mean**2, 0.0)),
            total(capitals) / in_words,
            total(digits) / chars,
            total(marks) / chars,
            total(length - letters - digits - marks - shouts) / chars,
            total(shouts) / chars,
            np.bincount(of, minlength=n) / words,
            np.bincount(owner, weights=again, minlength=n) / words,
            most / words,
            total((length <= 3).astype(float)) / words,
            total(((letters > 1) & (capitals == letters)).astype(float)) / words,
            total(per_word(pc.match_substring_regex(dictionary, r"^\p{Lu}"))) / words,
            total((letters == 0).astype(float)) / words,
            per_word(pc.count_substring(texts, "\n")) / words,
            total(foreign) / chars,
            total(stops) / words,
            np.log1p(longest),
        ]
    )


@dataclass
class Model:
    """``score`` gives the calibrated probability of label 1 for rows of statistics."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, rows: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel, with a constant."""
        draw = np.random.default_rng(20240917)
        size = rows.shape[1]
        waves = draw.normal(0.0, 1.0 / np.sqrt(size), (size, FEATURES))
        phases = draw.uniform(0.0, 2 * np.pi, FEATURES)
        scaled = np.clip((rows - self.mean) / self.spread, -6.0, 6.0)
        return np.column_stack([np.cos(scaled @ waves + phases) * np.sqrt(2.0 / FEATURES), np.ones(len(rows))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self.features(rows) @ self.weights, -0.5, 1.5)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(rows))
        raw = self.raw(rows)
        level = raw if self.knots is None else np.interp(raw, self.knots, self.levels)
        # a trace of the raw score keeps the order inside a level
        return np.clip(0.999 * np.clip(level, 0.0, 1.0) + 0.001 * (raw + 0.5) / 2.0, 0.0, 1.0)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit: neighbours in the wrong order are pooled."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            u = blocks[-1]
            u[0] = (u[0] * u[1] + v * w) / (u[1] + w)
            u[1] += w
            u[2] += n
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fold(doc_id: Column) -> Column:
    """The remainder that decides which rows are learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats``: the statistics of all documents, in the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.text_chunks(batches, limit=PIECE_BYTES):
            rows = statistics(common.plain_texts(piece.column("text")))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "stats": pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))})

    return common.write_stage(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, stats array<double>"), "statistics")


def _normal_equations(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        square, cross, seen = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            z = model.features(_rows(batch.column("stats")))
            square += z.T @ z
            cross += z.T @ batch.column("quality").to_numpy()
            seen += len(z)
        if seen:
            cells = np.concatenate([square[np.triu_indices(size)], cross, [seen]])
            yield pa.record_batch({"cell": pa.array(np.arange(len(cells))), "value": pa.array(cells)})

    return run


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows whose fold is not 0; folds 1 to 3 give the ridge weights, fold 4 the calibration.

    Tasks sum the normal equations of their rows, Spark sums over tasks cell by cell; the driver gets one number per cell and
    one row per bin of raw scores, whatever the number of rows.  Null labels are left out, several labels of one document are
    averaged.  Without labels every document scores 1; without any in fold 4 the raw score is the score.
    """
    width = len(STATISTICS)
    moments = stats.select(
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]
    ).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(width)])
    spread = np.array([moments[f"s{i}"] or 0.0 for i in range(width)])
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    marks = marks.filter(fold(F.col("doc_id")) != 0)
    rows = common.write_stage(
        stats.join(marks, "doc_id").select("stats", "quality", (fold(F.col("doc_id")) == 4).alias("calibrates")), "labelled"
    )
    cells = rows.filter(~F.col("calibrates")).select("stats", "quality").mapInArrow(_normal_equations(model), "cell bigint, value double")
    values = cells.groupBy("cell").agg(F.sum("value").alias("value")).toPandas().sort_values("cell")["value"].to_numpy()
    if not len(values):
        return model
    size = FEATURES + 1
    square = np.zeros((size, size))
    square[np.triu_indices(size)] = values[: size * (size + 1) // 2]
    square += np.triu(square, 1).T
    penalty = np.full(size, PENALTY * values[-1])
    penalty[-1] = 1e-9 * values[-1]
    model.weights = np.linalg.solve(square + np.diag(penalty), values[size * (size + 1) // 2 : -1])

    @F.pandas_udf("int")
    def binned(column: pd.Series) -> pd.Series:
        raw = model.raw(np.stack(column.to_numpy()))
        return pd.Series(np.minimum(((raw + 0.5) / 2.0 * BINS).astype(np.int32), BINS - 1))

    held = rows.filter("calibrates").withColumn("bin", binned("stats")).groupBy("bin")
    found = held.agg(F.avg("quality").alias("value"), F.count(F.lit(1)).alias("weight")).toPandas().sort_values("bin")
    if len(found):
        model.knots = (found["bin"].to_numpy() + 0.5) / BINS * 2.0 - 0.5
        model.levels = pool_adjacent(found["value"].to_numpy(), found["weight"].to_numpy())
    return model


def text_score(model: Model):
    """A column function: the score of a text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch({"text": texts})
        pieces = [model.score(statistics(common.plain_texts(p.column("text")))) for p in common.text_chunks([batch], limit=PIECE_BYTES)]
        return pa.array(np.concatenate(pieces) if pieces else np.zeros(0))

    return score


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of rows of statistics."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(_rows(batch.column("stats"))))})

    return stats.mapInArrow(run, "doc_id bigint, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; a null text counts as empty and is scored like any other, repeated rows score alike."""
    stats = document_statistics(common.table(spark, sf_dir, "documents"))
    model = fit(stats, common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_statistics(stats, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

"""Language-model scoring of whole documents: corpus counts, a gated recurrent model and rare words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common
from corpusreview.llm.gru import END, Gru, classes_of

#: The most frequent words that have an output of their own; the others share outputs by their last two bytes.
VOCABULARY = 4096
KINDS = 64
#: About so many training documents give the model its first weights, in the driver; then all training documents train it in
#: the tasks.  Counts, classes and rare words come from all of them, too.
SEED_DOCUMENTS = 1500
_END_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
_CELLS = 4096
#: Tasks that merge the statistics of all others.
_MERGERS = 4
_LISTS = "kind int, part int, chunk bigint, data binary"


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def keyed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the key of every token of all texts, the tokens of each text, and the keys.

    A key is a hash of the word whose low six bits are its kind, taken from its last two bytes.  Each text is closed by one end.
    """
    codes, counts, dictionary = common.words(texts)
    bytes_ = dictionary.cast(pa.large_binary())
    keys = common.hash_words(bytes_)
    if len(bytes_):
        ends = np.frombuffer(bytes_.buffers()[1], np.int64)[bytes_.offset : bytes_.offset + len(bytes_) + 1]
        data = np.frombuffer(bytes_.buffers()[2], np.uint8).astype(np.uint64)
        final, before = data[ends[1:] - 1], data[np.maximum(ends[1:] - 2, 0)]
        before = np.where(np.diff(ends) > 1, before, np.uint64(0))
        kinds = common.mix(final * np.uint64(256) + before + np.uint64(1)) & np.uint64(KINDS - 1)
        keys = (keys & ~np.uint64(KINDS - 1)) | kinds
        keys = np.where(keys == _END_KEY, keys - np.uint64(KINDS), keys)
    keys = np.append(keys, _END_KEY)
    total = counts + 1
    tokens = np.full(int(total.sum()), len(keys) - 1, np.int64)
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(total) - 1] = False
    tokens[inside] = codes
    return tokens, total, keys


def _rows(kind: list[int], part: list[int], chunk: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch(
        {"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())}
    )


def _invert(parts: int):
    """Per chunk of documents one row that lists its documents' words, and one row per range of keys with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in enumerate(common.text_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) | number
            tokens, counts, keys = keyed_words(common.plain_texts(piece.column("text")))
            known, index = np.unique(keys, return_inverse=True)
            index = index[tokens]
            owner = np.repeat(np.arange(len(counts)), counts)
            pairs, times = np.unique(owner * len(known) + index, return_counts=True)
            per_document = np.bincount(pairs // len(known), minlength=len(counts))
            held = piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            learned = np.bincount(index, weights=np.repeat(~held, counts), minlength=len(known)).astype(np.int64)
            sink = pa.BufferOutputStream()
            documents = pa.record_batch({c: piece.column(c) for c in ("doc_id", "text_key", "held_out")})
            with pa.ipc.new_stream(sink, documents.schema) as stream:
                stream.write_batch(documents)
            listed = common.pack(per_document, pairs % len(known), times)
            size = np.array([len(listed)], "<u8").tobytes()
            kind, part, data = [0], [int(chunk % parts)], [size + listed + sink.getvalue().to_pybytes()]
            ranges = ((known >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(ranges, np.arange(parts + 1))
            for at in np.flatnonzero(np.diff(cuts)):
                span = slice(cuts[at], cuts[at + 1])
                steps = np.diff(known[span], prepend=np.uint64(0))
                kind.append(1)
                part.append(int(at))
                data.append(common.pack(steps, np.arange(cuts[at], cuts[at + 1]), learned[span]))
            yield _rows(kind, part, [chunk] * len(kind), data)

    return run


def _total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys of a range over all chunks: back to the chunks, and as statistics of the corpus."""
    for part, rows in common.grouped(batches, "part", ["kind", "chunk", "data"]):
        lists = []
        for kind, chunk, data in rows:
            if kind == 0:
                yield _rows([0], [part], [chunk], [data])
            else:
                steps, index, learned = common.unpack(data)
                lists.append((chunk, np.cumsum(steps, dtype=np.uint64), index, learned))
        if not lists:
            continue
        keys, place = np.unique(np.concatenate([x[1] for x in lists]), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate([x[3] for x in lists]), minlength=len(keys)).astype(np.int64)
        start = 0
        for chunk, own, index, _ in lists:
            mine = totals[place[start : start + len(own)]]
            start += len(own)
            yield _rows([1], [part], [chunk], [common.pack(index, mine, own & np.uint64(KINDS - 1))])
        words = (keys != _END_KEY) & (totals > 0)
        top = np.argsort(-totals[words], kind="stable")[: VOCABULARY + 1]
        kinds = (keys[words] & np.uint64(KINDS - 1)).astype(np.int64)
        yield _rows(
            [2],
            [part],
            [0],
            [
                common.pack(
                    keys[words][top],
                    totals[words][top],
                    np.bincount(kinds, weights=totals[words], minlength=KINDS).astype(np.int64),
                    np.bincount(kinds, minlength=KINDS),
                    totals[keys == _END_KEY],
                )
            ],
        )


@dataclass
class Corpus:
    """What the training documents say as a whole; its size is fixed by the parameters."""

    keys: np.ndarray  # of the words with an output of their own, sorted
    counts: np.ndarray
    least: int  # words with this count or more have one
    kind_tokens: np.ndarray  # of the other words, by kind
    kind_words: np.ndarray
    ends: int
    tokens: int
    words: int

    @property
    def order(self) -> np.ndarray:
        """The end, then words and kinds by frequency: classes of frequent outputs are small, so most tokens cost little."""
        return np.concatenate([[END], 1 + np.argsort(-np.concatenate([self.counts, self.kind_tokens]), kind="stable")])

    @property
    def frequencies(self) -> np.ndarray:
        """Of the outputs: the end, the words and the kinds of other words."""
        return np.concatenate([[self.ends], self.counts, self.kind_tokens]).astype(float)[self.order]

    def outputs(self, keys: np.ndarray) -> np.ndarray:
        """The output of each key: the end, a word of its own or its kind."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        own = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        other = 1 + len(self.keys) + (keys & np.uint64(KINDS - 1)).astype(np.int64)
        place = np.argsort(self.order)
        return np.where(keys == _END_KEY, END, place[np.where(own, 1 + at, other)])


def corpus_counts(docs: DataFrame) -> tuple[DataFrame, Corpus]:
    """The counted lists of all chunks in the shared folder, and the statistics of the training documents.

    Texts are read once and not shuffled: packed lists of keys go to ranges of keys, are summed over all documents, and go back.
    """
    partitions = common.shuffle_partitions(docs.sparkSession)
    lists = docs.select("doc_id", "text", "text_key", "held_out").mapInArrow(_invert(partitions), _LISTS)
    counted = common.write_stage(lists.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_total, _LISTS), "counts")

    # every task merges the statistics of its ranges, a few tasks merge those, and the driver gets a few lists
    figures = counted.filter("kind = 2").select("kind", "part", "chunk", "data").mapInArrow(_merge, _LISTS)
    merged = figures.repartition(_MERGERS, "part").mapInArrow(_merge, _LISTS).select("data").toArrow()
    keys, counts, kind_tokens, kind_words, ends = _merged(merged["data"].to_pylist())
    # words with an output of their own are told by their count alone, so a tie at the end of the list is left out
    least = int(counts[-1]) + 1 if len(counts) > VOCABULARY else 1
    keys, counts = keys[counts >= least], counts[counts >= least]
    order = np.argsort(keys)
    own = (keys & np.uint64(KINDS - 1)).astype(np.int64)
    return counted, Corpus(
        keys[order],
        counts[order],
        least,
        kind_tokens - np.bincount(own, weights=counts, minlength=KINDS).astype(np.int64),
        kind_words - np.bincount(own, minlength=KINDS),
        ends,
        int(kind_tokens.sum()) + ends,
        int(kind_words.sum()) + (ends > 0),
    )


def _merged(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The most frequent keys and their counts, the tokens and words by kind and the ends of several ranges of keys."""
    parts = [common.unpack(data) for data in lists]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64), 0
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    top = np.lexsort((keys, -counts))[: VOCABULARY + 1]
    tokens, words = (sum(p[i].astype(np.int64) for p in parts) for i in (2, 3))
    return keys[top], counts[top], tokens, words, int(sum(p[4].sum() for p in parts))


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = [data for batch in batches for data in batch.column("data").to_pylist()]
    if lists:
        keys, counts, tokens, words, ends = _merged(lists)
        part = TaskContext.get().partitionId()
        yield _rows([2], [part], [0], [common.pack(keys, counts, tokens, words, np.array([ends]))])


def document_counts(counted: DataFrame, corpus: Corpus) -> DataFrame:
    """``doc_id, text_key, held_out, n_tokens, n_known, counted, rare``: what a document's score needs of the corpus counts.

    ``counted`` is the sum of log10(count + 0.5) over all tokens, ``rare`` the log10 probability of the words without an output
    of their own, given their kinds.
    """
    floor = corpus.kind_tokens + 0.5 * (corpus.kind_words + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.grouped(batches, "chunk", ["kind", "data"]):
            data = next(d for kind, d in rows if kind == 0)
            size = 8 + int(np.frombuffer(data[:8], "<u8")[0])
            per_document, index, times = (x.astype(np.int64) for x in common.unpack(data[8:size]))
            documents = pa.ipc.open_stream(data[size:]).read_all().combine_chunks()
            lists = [common.unpack(d) for kind, d in rows if kind == 1]
            place = np.concatenate([x[0] for x in lists]).astype(np.int64)
            totals, kinds = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
            totals[place] = np.concatenate([x[1] for x in lists])
            kinds[place] = np.concatenate([x[2] for x in lists])
            final = len(place) - 1  # the key of the end is the largest
            logs = np.log10(totals + 0.5)
            rare = np.where((totals >= corpus.least) | (np.arange(len(place)) == final), 0.0, logs - np.log10(floor[kinds]))
            owner = np.repeat(np.arange(len(per_document)), per_document)
            summed = lambda values: np.bincount(owner, weights=values * times, minlength=len(per_document))
            yield pa.record_batch(
                {
                    **{c: documents[c].combine_chunks() for c in ("doc_id", "text_key", "held_out")},
                    "n_tokens": pa.array(summed(np.ones(len(index))).astype(np.int64)),
                    "n_known": pa.array(summed((totals > 0)[index].astype(float)).astype(np.int64)),
                    "counted": pa.array(summed(logs[index])),
                    "rare": pa.array(summed(rare[index])),
                }
            )

    rows = counted.filter("kind < 2").repartition(common.shuffle_partitions(counted.sparkSession), "chunk").sortWithinPartitions("chunk")
    return rows.mapInArrow(
        run, "doc_id bigint, text_key bigint, held_out boolean, n_tokens bigint, n_known bigint, counted double, rare double"
    )


def new_model(corpus: Corpus) -> Gru:
    frequencies = corpus.frequencies
    model = Gru(classes_of(frequencies), len(frequencies))
    model.seed(frequencies)
    return model


def train(docs: DataFrame, corpus: Corpus) -> Gru:
    """The recurrent model: first weights from a bounded sample, then trained by all tasks side by side and averaged.

    Every task trains on all training documents of its partition, window by window, starting from the first weights; Spark sums the
    weights of all tasks, each times the tokens it saw, and the driver gets one vector whatever the size of the corpus.
    """
    model = new_model(corpus)
    learned = docs.filter(~F.col("held_out"))
    share = min(1 << 30, (SEED_DOCUMENTS << 30) // max(corpus.ends, 1))
    draw = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(7)), F.lit(1 << 30))
    sample = learned.filter(draw < share).orderBy("doc_id", "text_key").select("text").toArrow().combine_chunks()
    state = None
    for piece in common.text_chunks(sample.to_batches()):
        tokens, _, keys = keyed_words(common.plain_texts(piece.column("text")))
        state = model.train(corpus.outputs(keys)[tokens], state)
    starts, size, first = model.starts, model.size, model.flat.copy()
    shared = docs.sparkSession.sparkContext.broadcast((corpus, starts, size, first))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, starts, size, first = shared.value
        model = Gru(starts, size, flat=first.copy())
        state = None
        for piece in common.text_chunks(batches):
            tokens, _, keys = keyed_words(common.plain_texts(piece.column("text")))
            state = model.train(corpus.outputs(keys)[tokens], state)
        if state and state["seen"]:
            weights = model.flat.astype(np.float64) * state["seen"]
            cells = [weights[i : i + _CELLS] for i in range(0, len(weights), _CELLS)]
            yield _cells(list(range(len(cells))), cells, [state["seen"]] * len(cells))

    partitions = common.shuffle_partitions(docs.sparkSession)
    cells = learned.select("text").mapInArrow(run, "cell int, seen bigint, weights array<double>")
    summed = cells.repartition(partitions, "cell").mapInArrow(_sum_cells, "cell int, seen bigint, weights array<double>").orderBy("cell").toArrow()
    if summed.num_rows:
        weights = np.concatenate([np.array(w) for w in summed["weights"].to_pylist()])
        model.flat[:] = weights / summed["seen"][0].as_py()
    return model


def _cells(numbers: list[int], weights: list[np.ndarray], seen: list[int]) -> pa.RecordBatch:
    return pa.record_batch(
        {"cell": pa.array(numbers, pa.int32()), "seen": pa.array(seen, pa.int64()), "weights": pa.array(weights, pa.list_(pa.float64()))}
    )


def _sum_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for row, cell in enumerate(batch.column("cell").to_pylist()):
            weights = batch.column("weights")[row].values.to_numpy(zero_copy_only=False)
            sums[cell] = sums.get(cell, 0) + weights
            seen[cell] = seen.get(cell, 0) + batch.column("seen")[row].as_py()
    if sums:
        yield _cells(list(sums), list(sums.values()), list(seen.values()))


def model_scores(docs: DataFrame, corpus: Corpus, model: Gru) -> DataFrame:
    """``doc_id, text_key, modelled``: log10 probability of each whole text's outputs, the state carried to its end."""
    shared = docs.sparkSession.sparkContext.broadcast((corpus, model.starts, model.size, model.flat))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, starts, size, flat = shared.value
        model = Gru(starts, size, flat=flat)
        # more documents side by side: the steps of the longest cost the least that way
        for piece in common.text_chunks(batches, limit=2 * common.CHUNK_BYTES):
            tokens, counts, keys = keyed_words(common.plain_texts(piece.column("text")))
            scores = model.score(corpus.outputs(keys)[tokens], counts) / np.log(10)
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "text_key": piece.column("text_key"), "modelled": pa.array(scores)})

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key bigint, modelled double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every whole text, learned from the documents that are not held out.

    The model predicts the class of the next output, the output in its class, and, if that is a kind of rare words, the word
    in its kind by its count over the whole training corpus; these probabilities are multiplied.  A null text counts as empty
    and is scored as its end alone.  Rows with equal id and text get one row each, with equal values.  Without training
    documents every base score is 0 per token.  Other columns are ignored.  ``docs`` must come from a table, whose partitions
    hold the same rows on a retry.
    """
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", text_key.alias("text_key"), held_out(F.col("doc_id")).alias("held_out"))
    counted, corpus = corpus_counts(rows)
    model = train(rows, corpus)
    scores = model_scores(rows, corpus, model).groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.first("modelled").alias("modelled"))
    both = document_counts(counted, corpus).join(scores, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    floor = float(np.log10(corpus.tokens + 0.5 * (corpus.words + 1)))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("modelled") + F.col("rare")).alias("score"),
    )


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))

"""Helpers shared by the operators: Arrow batches by bytes, words, shingles, hashes and tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from corpusreview.session import fresh_folder

#: Bytes of text that one step of a task holds at a time; a longer single text makes a step of its own.
CHUNK_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words are the runs of characters outside this class, after lower-casing A-Z.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=np.uint64,
)


def write_stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a new folder that all executors share and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = fresh_folder(spark, purpose)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends rows to Python in batches of less than ``CHUNK_BYTES``, not of up to 10,000 whole texts.

    Both the JVM, which doubles its buffers, and the worker hold a whole batch.  Rows and results stay the same.
    """
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, CHUNK_BYTES - CHUNK_BYTES // 8)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the machine: a Python worker lives on for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """``pieces`` of all batches; memory is given back after the last."""
    for batch in batches:
        yield from pieces(batch, column, limit)
    give_back()


def plain_texts(column: pa.Array) -> pa.Array:
    """The texts with null as the empty text.

    The texts are copied first: some functions misread the cast of a slice, whose offsets do not start at 0.
    """
    return pc.fill_null(column.take(pa.array(np.arange(len(column)))).cast(pa.large_string()), "")


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words in order, the number of words of each text, and the words by code."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy()
    if len(flat):
        real = pc.greater(pc.binary_length(flat), 0)
        owner = owner[real.to_numpy(zero_copy_only=False)]
        flat = flat.filter(real)
    coded = flat.dictionary_encode()
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, coded.dictionary


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = values.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """One 64-bit hash per distinct word, the same in every task: the sum of a mixed number for each byte at its place."""
    words_ = dictionary.cast(pa.large_binary())
    buffers = words_.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[words_.offset : words_.offset + len(words_) + 1]
    if not len(words_) or ends[-1] == ends[0]:
        return mix(np.zeros(len(words_), np.uint64))
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    lengths = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], lengths)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(data + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)), dtype=np.uint64)])
    starts = ends - ends[0]
    return mix(sums[starts[1:]] - sums[starts[:-1]] + lengths.astype(np.uint64))


def shingles(word_hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the index of their text.

    A text with fewer words than ``width`` gives its whole sequence as one shingle; a text without words gives none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(word_hashes))
    length = np.minimum(counts, width)
    first = place[place + length[owner] <= ends[owner]] if len(place) else place
    owner = owner[first]
    size = length[owner]
    out = size.astype(np.uint64) * _ODD[-1]
    for j in range(width):
        inside = j < size
        if inside.all():
            out += word_hashes[first + j] * _ODD[j % 5] + np.uint64(j // 5)
        else:
            out[inside] += word_hashes[first[inside] + j] * _ODD[j % 5] + np.uint64(j // 5)
    return mix(out), owner


def split_by(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """One array per text."""
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, byte plane by byte plane, compressed."""
    parts = [np.array([len(arrays)], "<u8").tobytes()]
    for array in arrays:
        wide = array.astype("<u8", copy=False)
        width = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
        parts.append(np.array([len(wide), width], "<u8").tobytes())
        parts.append(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T[:width]).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    """What ``pack`` got, as 64-bit numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    arrays, at = [], 8
    for _ in range(int(raw[:8].view("<u8")[0])):
        size, width = (int(x) for x in raw[at : at + 16].copy().view("<u8"))
        at += 16
        planes = np.zeros((8, size), np.uint8)
        planes[:width] = raw[at : at + size * width].reshape(width, size)
        arrays.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += size * width
    return arrays


def grouped(batches: Iterable[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """The rows of each value of ``key``; rows come sorted by it."""
    held: list[tuple] = []
    now = None
    for batch in batches:
        for at, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
            if held and at != now:
                yield now, held
                held = []
            now = at
            held.append(tuple(row))
    if held:
        yield now, held
    held = []
    give_back()

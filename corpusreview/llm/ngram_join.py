"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, one check per pair."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common
from corpusreview.llm.components import linked_by_lists

#: Two documents link when ``PARTS * shared >= OF * (sum of sizes)``: a Jaccard similarity of at least 3 / 4.
PARTS, OF = 7, 3
#: Bits of a shingle's hash; slots of the hash range whose counts bound what two documents can share.
HASH_BITS = 48
SLOTS = 64
#: Ranges of hashes for each shuffle partition: a task holds one at a time.
RANGES = 2
#: Bytes of text whose words and shingles are held at a time: they take many times the size of the text, their sets do not.
PIECE_BYTES = 1 << 19

_LISTS = "kind int, part int, chunk bigint, data binary"


def _pack(hashes: np.ndarray, places: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted hashes as differences, places and counts, byte plane by byte plane, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    planes = [steps.view(np.uint8).reshape(-1, 8).T.tobytes(), places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
    if counts is not None:
        planes.append(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, counted: bool = False) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // (20 if counted else 12)
    parts = [np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)]
    parts.append(np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel())
    if counted:
        parts.append(np.ascontiguousarray(raw[12 * n :].reshape(8, n).T).view("<u8").ravel())
    return parts


def _rows(kind: list[int], part: list[int], chunk: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch(
        {"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())}
    )


def _text_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    codes, counts, dictionary = common.words(common.plain_texts(texts))
    hashes, owner = common.shingles(common.hash_words(dictionary)[codes], counts)
    hashes >>= np.uint64(64 - HASH_BITS)
    return [np.unique(own) for own in common.split_by(hashes, np.bincount(owner, minlength=len(counts)))]


def _invert(parts: int):
    """Texts to lists by shingle: per chunk of documents and range of hashes one row, and one row that lists the documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in enumerate(common.text_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) | number
            sets = [own for part in common.pieces(piece, "text", PIECE_BYTES) for own in _text_sets(part.column("text"))]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            classes = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            ids = piece.column("doc_id")
            documents = pa.record_batch(
                {"doc_id": ids, "text_key": piece.column("text_key"), "size": pa.array(sizes), "class": pa.array(classes)}
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, documents.schema) as stream:
                stream.write_batch(documents)
            kind, part, data = [0], [int(chunk % parts)], [sink.getvalue().to_pybytes()]
            # equal sets of a chunk are listed once
            firsts = np.sort(np.unique(classes, return_index=True)[1])
            flat = np.concatenate([sets[i] for i in firsts]) if len(firsts) else np.zeros(0, np.uint64)
            places = np.repeat(firsts, sizes[firsts])
            order = np.argsort(flat)
            flat, places = flat[order], places[order]
            ranges = (flat * np.uint64(parts) >> np.uint64(HASH_BITS)).astype(np.int64) if parts < 1 << (64 - HASH_BITS) else None
            if ranges is None:
                ranges = (flat.astype(object) * parts >> HASH_BITS).astype(np.int64)
            cuts = np.searchsorted(ranges, np.arange(parts + 1))
            for at in np.flatnonzero(np.diff(cuts)):
                kind.append(1)
                part.append(int(at))
                data.append(_pack(flat[cuts[at] : cuts[at + 1]], places[cuts[at] : cuts[at + 1]]))
            yield _rows(kind, part, [chunk] * len(kind), data)

    return run


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of the shingles of a range; those of several documents go back to their chunks."""
    for part, rows in common.grouped(batches, "part", ["kind", "chunk", "data"]):
        for kind, chunk, data in rows:
            if kind == 0:
                yield _rows([0], [part], [chunk], [data])
        lists = [(chunk, *_unpack(data)) for kind, chunk, data in rows if kind == 1]
        if not lists:
            continue
        flat = np.concatenate([h for _, h, _ in lists])
        order = np.argsort(flat, kind="stable")
        values = flat[order]
        begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        times = np.diff(np.append(begin, len(values)))
        frequency = np.empty(len(flat), np.uint64)
        frequency[order] = np.repeat(times, times)
        start = 0
        for chunk, hashes, places in lists:
            counts = frequency[start : start + len(hashes)]
            start += len(hashes)
            shared = counts > 1
            if shared.any():
                yield _rows([1], [part], [chunk], [_pack(hashes[shared], places[shared], counts[shared])])


def _order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its shared shingles, rarest first, how many of them are in the prefix and where the prefix starts.

    Shingles of one document alone come first of all; they are counted but not listed, as nothing can match them.
    """
    for _, rows in common.grouped(batches, "chunk", ["kind", "data"]):
        data = next(d for kind, d in rows if kind == 0)
        documents = pa.ipc.open_stream(data).read_all().combine_chunks()
        sizes, classes = documents["size"].to_numpy(), documents["class"].to_numpy()
        lists = [_unpack(d, True) for kind, d in rows if kind == 1]
        hashes, places, counts = (np.concatenate([x[i] for x in lists]) if lists else np.zeros(0, np.uint64) for i in range(3))
        order = np.lexsort((hashes, counts, places))
        hashes, places = hashes[order].view(np.int64), places[order].astype(np.int64)
        listed = np.bincount(places, minlength=len(sizes))
        alone = sizes - listed
        # a partner shares at least three quarters of the larger set, so one of the first quarter and one more
        prefix = np.maximum(sizes - -(-3 * sizes // 4) + 1 - alone, 0)
        prefix = np.where(listed > 0, np.minimum(prefix, listed), 0)
        ends = np.cumsum(listed)
        keep = np.repeat(prefix > 0, listed)
        kept = np.where(prefix > 0, listed, 0)
        slots = np.zeros((len(sizes), SLOTS), np.int32)
        np.add.at(slots, (places, (hashes >> (HASH_BITS - int(np.log2(SLOTS))))), 1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
        assert not len(ends) or ends[-1] == len(hashes)
        yield pa.record_batch(
            {
                "doc_id": documents["doc_id"].combine_chunks(),
                "text_key": documents["text_key"].combine_chunks(),
                "class": pa.array(classes, mask=sizes == 0),
                "size": pa.array(sizes),
                "alone": pa.array(alone.astype(np.int64)),
                "prefix": pa.array(prefix.astype(np.int32)),
                "shared": pa.ListArray.from_arrays(offsets, pa.array(hashes[keep])),
                "slots": pa.FixedSizeListArray.from_arrays(pa.array(slots.ravel()), SLOTS).cast(pa.list_(pa.int32())),
            }
        )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class, size, alone, prefix, shared, slots`` of every document, in the shared folder.

    ``class`` is a digest of the document's shingle set (null if it is empty), ``size`` the size of the set, ``alone`` how
    many of its shingles no other listed document has, ``shared`` the others in the order of (document frequency, hash), given
    only where ``prefix``, the number of them in the join prefix, is above 0.

    Texts are read once and never shuffled: packed lists of hashes go to ranges of hashes, which are counted over all
    documents, and the shared ones go back.  ``docs`` must come from a table, whose partitions hold the same rows on a retry.
    """
    partitions = common.shuffle_partitions(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    lists = keyed.mapInArrow(_invert(RANGES * partitions), _LISTS)
    counted = lists.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_count, _LISTS)
    ordered = counted.repartition(partitions, "chunk").sortWithinPartitions("chunk").mapInArrow(
        _order,
        "doc_id bigint, text_key bigint, class bigint, size bigint, alone bigint, prefix int, shared array<bigint>, slots array<int>",
    )
    return common.write_stage(ordered, "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose sets are similar enough, by counting what they share."""
    left = sets.select(F.col("class").alias("u"), F.col("size").alias("u_size"), F.col("shared").alias("u_shared"))
    right = sets.select(F.col("class").alias("v"), F.col("size").alias("v_size"), F.col("shared").alias("v_shared"))
    common_size = F.size(F.array_intersect("u_shared", "v_shared"))
    return (
        pairs.join(left, "u").join(right, "v").filter(common_size * PARTS >= (F.col("u_size") + F.col("v_size")) * OF).select("u", "v")
    )


def _may_link(a: str, b: str):
    """Length, positional and suffix filters of two entries of one list."""
    col = lambda side, name: F.col(f"{side}.{name}")
    smaller, larger = F.least(col(a, "size"), col(b, "size")), F.greatest(col(a, "size"), col(b, "size"))
    needed = (col(a, "size") + col(b, "size")) * OF
    length = smaller * 4 >= larger * 3
    # all that two linked sets share stands, in both, from their first common entry on; this may be any entry but for that one
    positional = F.least(col(a, "size") - col(a, "at"), col(b, "size") - col(b, "at")) * PARTS >= needed
    slots = F.aggregate(F.zip_with(col(a, "slots"), col(b, "slots"), lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return length & positional & (slots * PARTS >= needed)


def linked_classes(sets: DataFrame) -> DataFrame:
    """``class, label`` of the classes that link with others; the label is the smallest class of the component.

    The lists of the prefix shingles give the candidates; a pair is verified once, by its shared shingles.
    """
    partnered = sets.filter("prefix > 0").groupBy("class").agg(
        *[F.first(c).alias(c) for c in ("size", "alone", "prefix", "shared", "slots")]
    )
    partnered = common.write_stage(partnered, "partnered")
    entries = partnered.select("class", "size", "alone", "slots", F.posexplode(F.slice("shared", 1, F.col("prefix"))).alias("place", "key"))
    lists = entries.select("key", F.col("class").alias("node"), "size", (F.col("alone") + F.col("place")).alias("at"), "slots")
    return linked_by_lists(lists, _may_link, lambda pairs: _verified(pairs, partnered)).withColumnRenamed("node", "class")


def grouped_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, label, component_id`` of every document; ``label`` (null without words) names its group."""
    sets = shingle_sets(docs)
    labels = linked_classes(sets)
    documents = sets.select("doc_id", "text_key", "class", "size")
    lowest = documents.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("lowest"))
    named = lowest.join(labels, "class", "left").select("class", F.coalesce("label", "class").alias("label"), "lowest")
    groups = named.groupBy("label").agg(F.min("lowest").alias("component"))
    named = named.join(groups, "label").select("class", "label", "component")
    return documents.join(named, "class", "left").select(
        "doc_id", "text_key", F.col("size").alias("n_shingles"), "label", F.coalesce("component", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more link.

    ``component_id`` is the smallest id of the documents reachable by links, the document itself included.  Documents with
    equal sets form one class and are compared once.  A null text counts as empty; a document without words links with
    nothing.  Rows with equal ids are rows of their own; a null id counts as larger than all others.  Other columns are ignored.
    """
    return grouped_documents(docs).select("doc_id", "n_shingles", "component_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))

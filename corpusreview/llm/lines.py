"""Fuzzy line dedup: SimHash of normalised lines, joined on pigeonhole blocks, edit similarity, one occurrence per group."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common
from corpusreview.llm.components import linked_by_lists

#: Lines link when 1 - (word edits) / (words of the longer line) reaches this, which nothing but the words decides.
SIMILARITY = 0.85
#: A SimHash is cut into blocks; lines that agree in one are candidates.  Blocks of ``n`` bits give lines / 2 ** n chance
#: partners per line and block, so a corpus of many more than 2 ** BLOCK_BITS * 100 lines wants more bits and more blocks.
BLOCKS = 28
BLOCK_BITS = 20
#: Lines of so many words or more have a SimHash, which may miss a link; lines of no more than ``LISTED_WORDS`` words are
#: joined by their rarest words, which misses none.  A line that links with one of 13 words has no more than 15.
HASHED_WORDS = 14
LISTED_WORDS = 15
#: Shorter lines have no near line: none of their words may differ.
NEAR_WORDS = 6
#: Lines of so many words or more are marked with 128 bits instead of 64.
MARKED_WORDS = 48
#: Slots of the word counts that order words from rare to common.  The order only decides how many candidates there are,
#: never which lines link.
COUNT_SLOTS = 1 << 20
#: Bytes of text that a task works on at a time: the keys of a line take many times its own size.
CHUNK_BYTES = 1 << 20
#: Keys that a task gathers from its chunks before it packs them by ranges.
PACKED = 1 << 19
#: Ranges of keys for each partition, held one at a time; groups of a key up to this size are compared where they are found.
RANGES = 4
COMPARED = 2048
#: Pairs in reach are written down where they are found for groups of a key that have up to so many for each member; the
#: members of other groups stay lists.
PAIRED = 4
#: Open lists whose members have up to so many others on average are compared pair by pair.
THINNED = 64
#: Pairs of lines whose edits are counted side by side.
SIDE_BY_SIDE = 256
#: Bits of the fixed-size filter that finds the lines whose texts are compared.
FILTER_BITS = 1 << 25
_BITS = BLOCKS * BLOCK_BITS
_LISTED_KEY_BITS = 40
_FIRSTS, _HASHED, _LISTED = None, 1, 2
_KEY_BITS = {_HASHED: BLOCK_BITS + (BLOCKS - 1).bit_length(), _LISTED: _LISTED_KEY_BITS}
_PARTS = "kind int, part int, chunk bigint, data binary"
#: Packed first occurrences of lines, entries of lists, lines that are copies, and pairs in reach.
_PLACED, _LIST, _COPIES, _PAIR = 0, 1, 2, 3
_ENTRIES = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("lines", pa.list_(pa.int32()))]
    + [("key", pa.int64()), ("node", pa.int64()), ("words", pa.int32()), ("mark", pa.int64()), ("half", pa.int64()), ("u", pa.int64()), ("v", pa.int64())]
)
_ENTRY_TYPES = (
    "kind int, part int, data binary, doc_id bigint, text_key bigint, lines array<int>, key bigint, node bigint, words int, mark bigint, half bigint, u bigint, v bigint"
)
_SIGN = np.uint64(1 << 63)
#: Lines of so many distinct words are counted bit by bit side by side, longer ones word by word.
_SLICED = 255


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines and the number of lines of each text."""
    lists = pc.split_pattern(texts, "\n")
    return lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def normal_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the normalised words of all lines, their number in each line and the words: lower case, letters and digits only."""
    codes, counts, dictionary = common.words(lines, lower=False)
    # between signs, most words are ASCII letters and digits, which are normal once they are in lower case
    dictionary = pc.ascii_trim(dictionary, string.punctuation)
    ready = pc.ascii_is_alnum(dictionary)
    others = pc.replace_substring_regex(pc.utf8_lower(dictionary.filter(pc.invert(ready))), r"[^\p{L}\p{N}]+", "")
    plain = pa.concat_arrays([pc.ascii_lower(dictionary.filter(ready)), others]).dictionary_encode()
    to = np.empty(len(dictionary), np.int64)
    to[np.argsort(~ready.to_numpy(zero_copy_only=False), kind="stable")] = plain.indices.to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(plain.dictionary), 0).to_numpy(zero_copy_only=False)
    codes = to[codes] if len(codes) else codes
    keep = some[codes] if len(codes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)[keep]
    return codes[keep], np.bincount(owner, minlength=len(counts)).astype(np.int64), plain.dictionary


def digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each sequence of word hashes."""
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(starts, counts)
    mixed = common.mix(hashes + common.mix(place.astype(np.uint64)))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    return common.mix(total[starts + counts] - total[starts] + counts.astype(np.uint64)).view(np.int64)


def distinct_words(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the distinct words of each line, and their number."""
    both = (np.repeat(np.arange(len(counts)), counts) << 32) | codes
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both & 0xFFFFFFFF, np.bincount(both >> 32, minlength=len(counts)).astype(np.int64)


def _wide(hashes: np.ndarray) -> np.ndarray:
    return np.stack([common.mix(hashes + np.uint64(31 * (i + 1))) for i in range(-(-_BITS // 64))], axis=1)


def _long_simhashes(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``simhashes`` of lines of any length.  Eight counters share a 64-bit number, so runs of at most 255 words are added."""
    lanes = np.empty((len(hashes), _BITS // 8), np.uint64)
    for low in range(0, len(hashes), 8192):
        wide = _wide(hashes[low : low + 8192])
        lanes[low : low + 8192] = np.ascontiguousarray(np.unpackbits(wide.view(np.uint8), axis=1)[:, :_BITS]).view("<u8")
    weights = np.int64(1) << np.arange(BLOCK_BITS)
    pieces = np.maximum(-(-counts // 255), 1)
    starts = np.cumsum(counts) - counts
    first = np.cumsum(pieces) - pieces
    out = np.zeros((len(counts), BLOCKS), np.int64)
    for low in range(0, len(counts), 512):
        size = counts[low : low + 512]
        own = pieces[low : low + 512]
        begin = np.repeat(starts[low : low + 512], own) + 255 * (np.arange(int(own.sum())) - np.repeat(first[low : low + 512] - first[low], own))
        end = starts[low + len(size) - 1] + size[-1]
        sums = np.add.reduceat(lanes[codes[begin[0] : end]], begin - begin[0], axis=0) if end > begin[0] else np.zeros((len(begin), lanes.shape[1]), np.uint64)
        votes = sums.view(np.uint8)
        if len(begin) > len(size):
            votes = np.add.reduceat(votes.astype(np.int32), first[low : low + 512] - first[low], axis=0)
        bits = votes > (size // 2)[:, None]
        out[low : low + len(size)] = bits.reshape(len(size), BLOCKS, BLOCK_BITS) @ weights
    return out


def _majority(table: np.ndarray, codes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that more than half of each line's words have, 64 to a number; lines come by falling length.

    The votes of a bit are a binary number whose digits lie in one array each, so a few operations on whole arrays add a
    word to all lines.  Two words wait at a digit until a third one comes: all three leave one there and carry one on.
    """
    digits: list[np.ndarray] = []
    waiting: list[np.ndarray | None] = []

    def carry(at: int, more: np.ndarray) -> None:
        while at < len(digits) and waiting[at] is not None:
            one, two = digits[at], waiting[at]
            either = one ^ two
            one &= two
            two = either & more
            one |= two
            digits[at] = np.bitwise_xor(either, more, out=either)
            waiting[at] = None
            more, at = one, at + 1
        if at == len(digits):
            digits.append(more)
            waiting.append(None)
        else:
            waiting[at] = more

    running = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")
    at = np.empty(len(counts), np.int64)
    for step, lines in enumerate(running):
        at[:lines] = codes[starts[:lines] + step]
        at[lines:] = len(table) - 1
        carry(0, table.take(at, axis=0))
    level = 0
    while level < len(digits):
        if waiting[level] is not None:
            one, two = digits[level], waiting[level]
            digits[level], waiting[level] = one ^ two, None
            carry(level + 1, one & two)
        level += 1
    more, equal = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for level in range(len(digits) - 1, -1, -1):
        half = -((counts // 2 >> level & 1).astype(np.uint64))[:, None]
        differs = digits[level] ^ half
        more |= equal & differs & digits[level]
        equal &= ~differs
    return more


def simhashes(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each line that has words as ``BLOCKS`` numbers of ``BLOCK_BITS`` bits: each bit is the majority over the line's words.

    ``hashes`` are those of the distinct words.
    """
    out = np.zeros((len(counts), BLOCKS), np.int64)
    long = counts > _SLICED
    if long.any():
        known, own = np.unique(codes[np.repeat(long, counts)], return_inverse=True)
        out[long] = _long_simhashes(hashes[known], own, counts[long])
    # the last row stands for no word
    table = np.concatenate([_wide(hashes), np.zeros((1, -(-_BITS // 64)), np.uint64)])
    rows = np.flatnonzero(~long & (counts > 0))
    rows = rows[np.argsort(-counts[rows], kind="stable")]
    starts, sizes = (np.cumsum(counts) - counts)[rows], counts[rows]
    bits = np.empty((len(rows), table.shape[1]), np.uint64)
    low = 0
    while low < len(rows):
        # lines side by side are at most about twice as long as each other
        high = max(low + 1, min(low + 1024, int(np.searchsorted(-sizes, -(sizes[low] // 2), "left"))))
        bits[low:high] = _majority(table, codes, starts[low:high], sizes[low:high])
        low = high
    # with the bits of each byte turned round, a block is a run of bits
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        bits = ((bits & np.uint64(mask)) << np.uint64(shift)) | (bits >> np.uint64(shift) & np.uint64(mask))
    blocks = np.empty((BLOCKS, len(rows)), np.uint64)
    for block in range(BLOCKS):
        word, shift = divmod(block * BLOCK_BITS, 64)
        blocks[block] = bits[:, word] >> np.uint64(shift)
        if shift + BLOCK_BITS > 64:
            blocks[block] |= bits[:, word + 1] << np.uint64(64 - shift)
    out[rows] = (blocks & np.uint64((1 << BLOCK_BITS) - 1)).T
    return out


def allowed_edits(words: np.ndarray) -> np.ndarray:
    """Word edits that a line may be away from another that is not longer."""
    return np.floor((1 - SIMILARITY) * words + 1e-9).astype(np.int64)


def word_ranks(docs: DataFrame) -> np.ndarray:
    """About four times the binary logarithm of the count of the words of each slot, over the lines of all documents that
    have up to ``LISTED_WORDS`` words, as no other line is joined by its rarest words.

    Lines of more than twice as many blanks are passed over unread; the few of them that have so few words are ordered, too.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.text_chunks(batches, limit=CHUNK_BYTES):
            lines, _ = split_lines(common.plain_texts(piece.column("text")))
            codes, counts, dictionary = normal_words(lines.filter(pc.less_equal(pc.count_substring(lines, " "), 2 * LISTED_WORDS)))
            codes = codes[np.repeat(counts <= LISTED_WORDS, counts)]
            slots = (common.hash_words(dictionary) & np.uint64(COUNT_SLOTS - 1)).astype(np.int64)
            times = np.bincount(slots[codes], minlength=1)
            some = np.flatnonzero(times)
            yield pa.record_batch({"slot": pa.array(some.astype(np.int32)), "times": pa.array(times[some])})

    with common.small_batches(docs.sparkSession):
        found = docs.select("text").mapInArrow(run, "slot int, times bigint").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    ranks = np.zeros(COUNT_SLOTS, np.uint8)
    ranks[found["slot"].to_numpy()] = np.minimum(4 * np.log2(found["times"].to_numpy() + 1.0), 127).astype(np.uint8)
    return ranks


def prefixes(hashes: np.ndarray, codes: np.ndarray, distinct: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rarest distinct words of each line, one more than its allowed edits, and the number of keys of each line.

    ``codes`` and ``distinct`` are the distinct words of the lines and their number, ``counts`` the number of all words.

    Of two lines that link, each lacks at most its own allowed edits of the other's words: a line of n words shares with a
    line of m >= n words at least m less the edits allowed to m, which is no fewer than n less those allowed to n.  They share
    a word, as edits change fewer words than a line has.  So of the two prefixes the one that ends first in the common order
    holds a word of the other line, which lies in the other's prefix too.
    """
    values = (ranks[(hashes & np.uint64(COUNT_SLOTS - 1)).astype(np.int64)].astype(np.int64) << 56) | (hashes >> np.uint64(8)).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), distinct)
    own = values[codes]
    own = own[np.lexsort((own, owner))]
    taken = np.minimum(distinct, allowed_edits(counts) + 1)
    keep = np.arange(len(own)) - np.repeat(np.cumsum(distinct) - distinct, distinct) < np.repeat(taken, distinct)
    return common.mix(own[keep].view(np.uint64)) >> np.uint64(64 - _LISTED_KEY_BITS), taken


def parities(hashes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lines that have words, whether they have an odd number of the words of each of 64 slots, and of the first 64 of 128.

    The 64 slots are pairs of the 128, so the second half of the 128 bits is the exclusive or of both numbers.  An inserted,
    deleted or replaced word changes at most two bits, so marks rule lines out without losing a link.
    """
    if not len(counts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    slot = common.mix(hashes + np.uint64(31)) & np.uint64(127)
    single = np.uint64(1) << (slot & np.uint64(63))
    starts = np.cumsum(counts) - counts
    return np.bitwise_xor.reduceat(single[codes], starts), np.bitwise_xor.reduceat(np.where(slot < 64, single, np.uint64(0))[codes], starts)


def _in_reach(words: np.ndarray, mark: np.ndarray, half: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Close enough in length and marks that the allowed edits could lead from line ``a`` to line ``b``."""
    longer = np.maximum(words[a], words[b]).astype(np.int64)
    shorter = np.minimum(words[a], words[b])
    allowed = allowed_edits(longer)
    all_, first = mark[a] ^ mark[b], half[a] ^ half[b]
    fine = np.bitwise_count(first).astype(np.int64) + np.bitwise_count(all_ ^ first)
    return (longer - shorter <= allowed) & (np.bitwise_count(all_) <= 2 * allowed) & ((shorter < MARKED_WORDS) | (fine <= 2 * allowed))


def _scrambled(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits: frequent blocks resemble each other, and shall not share a range."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << bits) - 1)


def _ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((keys << np.uint64(32 - bits) if bits < 32 else keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _first_lines(piece: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, found: np.ndarray) -> tuple[tuple[np.ndarray, ...], pa.RecordBatch]:
    """Of the lines of a chunk the first occurrence of each digest, and the others by document.

    A line that repeats an earlier one of its chunk is never the one that stays.  An occurrence is its document's id and text
    key and its number, so equal rows have the same occurrences.  Ids are packed as unsigned numbers in their order, a null one first.
    """
    ids = piece.column("doc_id").cast(pa.int64())
    has = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint64)
    id_ = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64) ^ _SIGN
    key = piece.column("text_key").to_numpy(zero_copy_only=False)
    order = np.lexsort((key, id_, has))
    other = np.zeros(len(order), np.int64)
    other[1:] = (has[order][1:] != has[order][:-1]) | (id_[order][1:] != id_[order][:-1]) | (key[order][1:] != key[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(other)
    order = np.lexsort((place, rank[owner], found))
    digest, owner, place = found[order].view(np.uint64), owner[order], place[order]
    again = np.zeros(len(order), bool)
    again[1:] = digest[1:] == digest[:-1]
    same = again.copy()
    same[1:] &= (rank[owner[1:]] == rank[owner[:-1]]) & (place[1:] == place[:-1])
    firsts = tuple(x[~again] for x in (digest, has[owner], id_[owner], key.view(np.uint64)[owner], place.astype(np.uint64)))
    copies, lines = owner[again & ~same], place[again & ~same]
    order = np.argsort(copies, kind="stable")
    documents, size = np.unique(copies, return_counts=True)
    return firsts, pa.record_batch(
        {
            "doc_id": ids.take(pa.array(documents)),
            "text_key": piece.column("text_key").take(pa.array(documents)),
            "lines": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(lines[order].astype(np.int32))),
        }
    )


def _packed_firsts(lists: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[tuple[None, int, bytes]]:
    """Range and packed first occurrences, range by range in the order of the digests."""
    if lists:
        columns = [np.concatenate(x) for x in zip(*lists)]
        lists.clear()
        order = np.argsort(columns[0], kind="stable")
        columns = [x[order] for x in columns]
        cuts = np.searchsorted(_ranges(columns[0], 64, parts), np.arange(parts + 1))
        for at in np.flatnonzero(np.diff(cuts)):
            yield _FIRSTS, int(at), _pack_firsts(*(x[cuts[at] : cuts[at + 1]] for x in columns))


def _pack_firsts(digest: np.ndarray, *columns: np.ndarray) -> bytes:
    return common.pack(np.diff(digest, prepend=np.uint64(0)), *columns)


def _unpack_firsts(lists: list[bytes]) -> list[np.ndarray]:
    """Digest, whether there is an id, id, text key and line."""
    columns = [np.concatenate(x) for x in zip(*((np.cumsum(x[0], dtype=np.uint64), *x[1:]) for x in map(common.unpack, lists)))]
    return [x.astype(np.uint64, copy=False) for x in columns]


def _ids(has: np.ndarray, id_: np.ndarray) -> pa.Array:
    return pa.array((id_ ^ _SIGN).view(np.int64), mask=has == 0)


def _packed_keys(held: dict[int, list[tuple[np.ndarray, ...]]], parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Kind, range and packed entries of the gathered keys, range by range in the order of the keys."""
    for of, lists in held.items():
        if not lists:
            continue
        bits = _KEY_BITS[of]
        keys, found, counts, marks, halves = (np.concatenate([x[i] for x in lists]) for i in range(5))
        lists.clear()
        order = np.argsort(keys)
        keys, found, counts, marks, halves = keys[order], found[order], counts[order], marks[order], halves[order]
        cuts = np.searchsorted(_ranges(keys, bits, parts), np.arange(parts + 1))
        for at in np.flatnonzero(np.diff(cuts)):
            span = slice(cuts[at], cuts[at + 1])
            steps = np.diff(keys[span], prepend=np.uint64(0))
            yield of, int(at), common.pack(steps, found[span], counts[span], marks[span], halves[span][counts[span] >= MARKED_WORDS])


def _line_parts(ranks: np.ndarray, parts: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk of documents one row with its lines that are copies of others of the chunk, and per ``PACKED`` keys of distinct
    lines and first occurrences one row for each range of keys, and of digests."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {_HASHED: [], _LISTED: []}
    firsts_held: list[tuple[np.ndarray, ...]] = []
    gathered, chunk = 0, 0

    def packed(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        kind, part, data = (list(x) for x in zip(*rows)) if (rows := list(rows)) else ([], [], [])
        yield pa.record_batch(
            {"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32()), "chunk": pa.array([chunk] * len(kind), pa.int64()), "data": pa.array(data, pa.binary())}
        )

    for number, piece in enumerate(common.text_chunks(batches, limit=CHUNK_BYTES)):
        chunk = (TaskContext.get().partitionId() << 32) | number
        lines, per_text = split_lines(common.plain_texts(piece.column("text")))
        codes, counts, dictionary = normal_words(lines)
        hashes = common.hash_words(dictionary)
        owner = np.repeat(np.arange(len(per_text)), per_text)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        found = digests(hashes[codes], counts)
        some = np.flatnonzero(counts)
        firsts, copies = _first_lines(piece, owner[some], place[some], found[some])
        firsts_held.append(firsts)
        gathered += len(firsts[0])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, copies.schema) as stream:
            stream.write_batch(copies)
        yield from packed([(0, int(chunk % parts), sink.getvalue().to_pybytes())])
        # the distinct lines that may have near lines
        firsts = np.zeros(len(counts), bool)
        firsts[np.unique(found, return_index=True)[1]] = True
        firsts &= counts >= NEAR_WORDS
        codes, counts, found = codes[np.repeat(firsts, counts)], counts[firsts], found[firsts].view(np.uint64)
        marks, halves = parities(hashes, codes, counts)
        codes, distinct = distinct_words(codes, counts)
        for of in (_HASHED, _LISTED):
            chosen = counts >= HASHED_WORDS if of == _HASHED else counts <= LISTED_WORDS
            rows = np.flatnonzero(chosen)
            own, size = codes[np.repeat(chosen, distinct)], distinct[chosen]
            if of == _HASHED:
                keys = _scrambled((simhashes(hashes, own, size) + (np.arange(BLOCKS) << BLOCK_BITS)).ravel(), _KEY_BITS[of])
                rows = np.repeat(rows, BLOCKS)
            else:
                keys, taken = prefixes(hashes, own, size, counts[chosen], ranks)
                rows = np.repeat(rows, taken)
            held[of].append((keys, found[rows], counts[rows].astype(np.int32), marks[rows], halves[rows]))
            gathered += len(rows)
        if gathered >= PACKED:
            yield from packed(_packed_keys(held, parts))
            yield from packed(_packed_firsts(firsts_held, parts))
            gathered = 0
    yield from packed(_packed_keys(held, parts))
    yield from packed(_packed_firsts(firsts_held, parts))


def _entries(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    columns["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.record_batch([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ENTRIES], _ENTRIES)


def _placed_lines(part: int, lists: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The first occurrence of every digest of a range, packed, and the other ones as copies."""
    columns = _unpack_firsts(lists)
    order = np.argsort(columns[0], kind="stable")
    digest = columns[0][order]
    shared = np.zeros(len(digest), bool)
    shared[1:] = digest[1:] == digest[:-1]
    many = shared.copy()
    many[:-1] |= shared[1:]
    columns = [x[order] for x in columns]
    if many.any():
        digest, has, id_, key, line = (x[many] for x in columns)
        inner = np.lexsort((line, key ^ _SIGN, id_, has, digest))
        for x in columns:
            x[many] = x[many][inner]
        digest, has, id_, key, line = (x[many] for x in columns)
        copy = digest[1:] == digest[:-1]
        copy &= (has[1:] != has[:-1]) | (id_[1:] != id_[:-1]) | (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        copy = np.append(False, copy)
        each = pa.ListArray.from_arrays(pa.array(np.arange(int(copy.sum()) + 1, dtype=np.int32)), pa.array(line[copy].astype(np.int32)))
        yield _entries(_COPIES, doc_id=_ids(has, id_).filter(pa.array(copy)), text_key=pa.array(key[copy].view(np.int64)), lines=each)
    yield _entries(_PLACED, part=pa.array([part]), data=pa.array([_pack_firsts(*(x[~shared] for x in columns))], pa.binary()))


def _by_length(keys: np.ndarray, words: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The order by key, words and node of entries that are in the order of their keys; only ties are sorted by node."""
    both = (np.cumsum(np.append(0, keys[1:] != keys[:-1])[: len(keys)]) << 32) | words
    order = np.argsort(both, kind="stable")
    both = both[order]
    tied = np.zeros(len(keys), bool)
    same = both[1:] == both[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    own = order[tied]
    order[tied] = own[np.lexsort((node[own], both[tied]))]
    return order


def _matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range of digests the first occurrences and the copies, and of each range of keys the entries in reach of another one of their key.

    Groups of up to ``COMPARED`` entries are compared here: those with few pairs in reach give these pairs, the others their pairs
    with one member, and a list.  Of larger groups all entries are handed on; they are compared where Spark can split them.
    """
    for part, rows in common.grouped(batches, "part", ["kind", "data"]):
        for kind, data in rows:
            if kind == 0:
                for batch in pa.ipc.open_stream(data):
                    yield _entries(_COPIES, **{c: batch.column(c) for c in batch.schema.names})
        lists = [data for kind, data in rows if kind is _FIRSTS]
        if lists:
            yield from _placed_lines(part, lists)
        for of in (_HASHED, _LISTED):
            lists = [common.unpack(data) for kind, data in rows if kind == of]
            if not lists:
                continue
            keys = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in lists])
            node, words, mark, halves = (np.concatenate([x[i] for x in lists]) for i in (1, 2, 3, 4))
            half = np.zeros(len(keys), np.uint64)
            half[words >= MARKED_WORDS] = halves
            lists = []
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            shared = np.zeros(len(keys), bool)
            same = ordered[1:] == ordered[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            order = order[shared]
            keys, node, words, mark, half = ordered[shared], node[order], words[order].astype(np.int32), mark[order], half[order]
            order = _by_length(keys, words, node)
            keys, node, words, mark, half = keys[order], node[order], words[order], mark[order], half[order]
            # a line that several chunks list
            again = np.zeros(len(keys), bool)
            again[1:] = (keys[1:] == keys[:-1]) & (node[1:] == node[:-1])
            keys, node, words, mark, half = keys[~again], node[~again], words[~again], mark[~again], half[~again]
            sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))) if len(keys) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(sizes)), sizes)
            keep = sizes[group] > COMPARED
            found = np.zeros(len(sizes), np.int64)
            allowed = allowed_edits(words)
            pairs = []
            left = np.flatnonzero((sizes[group] > 1) & (sizes[group] <= COMPARED))
            for step in range(1, COMPARED):
                left = left[(left + step < len(keys))]
                left = left[keys[left + step] == keys[left]]
                # sorted by length: too long a line ends the search
                left = left[words[left + step] - words[left] <= allowed[left + step]]
                if not len(left):
                    break
                near = left[np.bitwise_count(mark[left] ^ mark[left + step]) <= 2 * allowed[left + step]]
                near = near[_in_reach(words, mark, half, near, near + step)]
                keep[near] = True
                keep[near + step] = True
                np.add.at(found, group[near], 1)
                near = near[found[group[near]] <= PAIRED * sizes[group[near]]]
                pairs.append(np.stack([near, near + step]))
            few = found <= PAIRED * sizes
            pairs = [x[:, few[group[x[0]]]] for x in pairs]
            keep &= ~few[group] | (sizes[group] > COMPARED)
            # the members of other lists to be compared here meet one of them at once, the same for overlapping lists
            starred = np.flatnonzero(~few[group])
            if len(starred):
                begin = np.cumsum(sizes) - sizes
                centre = np.flatnonzero(np.minimum.reduceat(node, begin)[group] == node)
                centre = centre[group[starred]]
                pairs.append(np.stack([centre, starred])[:, (centre != starred) & _in_reach(words, mark, half, centre, starred)])
            ends = np.sort(node[np.concatenate(pairs, axis=1)].view(np.int64), axis=0) if pairs else np.zeros((2, 0), np.int64)
            if ends.size:
                yield _entries(_PAIR, u=pa.array(ends[0]), v=pa.array(ends[1]))
            if keep.any():
                full = keys[keep].view(np.int64) | np.int64(of << 60)
                yield _entries(
                    _LIST,
                    node=pa.array(node[keep].view(np.int64)),
                    key=pa.array(full),
                    words=pa.array(words[keep]),
                    mark=pa.array(mark[keep].view(np.int64)),
                    half=pa.array(half[keep].view(np.int64)),
                )


def edits(left: list[str], right: list[str]) -> int:
    """Insertions, deletions and replacements of words between two sequences, a column of the table at a time in one number."""
    size = len(left)
    if not size or not right:
        return max(size, len(right))
    where: dict[str, int] = {}
    for i, word in enumerate(left):
        where[word] = where.get(word, 0) | 1 << i
    every, top, total = (1 << size) - 1, 1 << (size - 1), size
    up, down = every, 0
    for word in right:
        here = where.get(word, 0)
        level = here | down
        across = (((here & up) + up) ^ up) | here
        more, less = down | (every & ~(across | up)), up & across
        total += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, (less << 1) & every
        up, down = less | (every & ~(level | more)), more & level
    return total


def near_words(a: list[str], b: list[str]) -> bool:
    """Whether the allowed edits lead from one sequence of words to the other.

    Words in place decide for most pairs that link, and words that the other line lacks for most that do not, as each takes
    an edit of its own; the edits of the others are counted without the words that both begin with.
    """
    allowed = int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > allowed:
        return False
    if len(a) == len(b) and sum(map(ne, a, b)) <= allowed:
        return True
    left, right = set(a), set(b)
    if len(left - right) > allowed or len(right - left) > allowed:
        return False
    same = next((i for i, other in enumerate(map(ne, a, b)) if other), min(len(a), len(b)))
    return edits(a[same:], b[same:]) <= allowed


def few_edits(codes: np.ndarray, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Whether the allowed edits lead from one run of ``codes`` to the other, for each pair of a first place and a size.

    The runs of a pair differ by no more words than are allowed, so the path of edits stays as near to the diagonal of the
    table.  Pairs of about the same size go through its rows side by side; pairs that have few others, one by one.
    """
    near = np.zeros(len(a), bool)
    order = np.argsort(size_a, kind="stable")
    low = 0
    while low < len(order):
        high = min(low + SIDE_BY_SIDE, int(np.searchsorted(size_a[order], 2 * size_a[order[low]] + 8, "right")))
        own = order[low:high]
        low = high
        rows, band = int(size_a[own].max()), int(allowed[own].max())
        if len(own) < 16 or rows > 4096:
            for i in own:
                near[i] = edits(codes[a[i] : a[i] + size_a[i]].tolist(), codes[b[i] : b[i] + size_b[i]].tolist()) <= allowed[i]
            continue
        # one column per pair; no word of one side equals a place without a word of the other
        at, of = np.arange(rows)[:, None], np.arange(-band, rows + band + 1)[:, None]
        left = np.where(at < size_a[own], codes[np.minimum(a[own] + at, len(codes) - 1)], -2)
        right = np.where((of >= 0) & (of < size_b[own]), codes[np.clip(b[own] + of, 0, len(codes) - 1)], -1)
        diagonal = np.arange(-band, band + 1, dtype=np.int16)[:, None]
        far = np.int16(16000)
        now = np.repeat(np.where(diagonal < 0, far, diagonal), len(own), axis=1)
        slot = size_b[own] - size_a[own] + band
        ends = np.searchsorted(size_a[own], np.arange(rows + 2))
        total = np.where(size_a[own] == 0, size_b[own], far)
        for row in range(1, rows + 1):
            # the place before a word of both stands on the same diagonal, the one before a word of the first on the next
            after = now + (right[row - 1 : row + 2 * band] != left[row - 1])
            now += np.int16(1)
            np.minimum(after[:-1], now[1:], out=after[:-1])
            after -= diagonal
            now = np.minimum.accumulate(after, axis=0)
            now += diagonal
            done = np.arange(ends[row], ends[row + 1])
            total[done] = now[slot[done], done]
        near[own] = total <= allowed[own]
    return near


def near_texts(u: pa.Array, v: pa.Array) -> np.ndarray:
    """``near_words`` for pairs of normalised texts.

    Pairs whose words in place, or whose words between what both begin and end with, are few enough edits are told for all
    at once; the others are compared one by one.
    """
    lists = pc.split_pattern(pa.concat_arrays([u, v]).cast(pa.large_string()), " ")
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    starts = np.cumsum(counts) - counts
    a, b, size_a, size_b = starts[: len(u)], starts[len(u) :], counts[: len(u)], counts[len(u) :]
    longer, shorter = np.maximum(size_a, size_b), np.minimum(size_a, size_b)
    allowed = allowed_edits(longer)
    if not len(u):
        return np.zeros(0, bool)
    # a text has at least one word, so that no run is empty
    runs = np.cumsum(shorter) - shorter
    place = np.arange(int(shorter.sum())) - np.repeat(runs, shorter)
    back = np.repeat(shorter, shorter) - 1 - place
    differs = codes[np.repeat(a, shorter) + place] != codes[np.repeat(b, shorter) + place]
    behind = codes[np.repeat(a + size_a - shorter, shorter) + place] != codes[np.repeat(b + size_b - shorter, shorter) + place]
    whole = np.repeat(shorter, shorter)
    begin = np.minimum.reduceat(np.where(differs, place, whole), runs)
    end = np.minimum(np.minimum.reduceat(np.where(behind, back, whole), runs), shorter - begin)
    near = ((size_a == size_b) & (np.add.reduceat(differs, runs, dtype=np.int64) <= allowed)) | (longer - begin - end <= allowed)
    left = np.flatnonzero(~near & (longer - shorter <= allowed))
    cut = begin[left], begin[left] + end[left]
    near[left] = few_edits(codes, a[left] + cut[0], size_a[left] - cut[1], b[left] + cut[0], size_b[left] - cut[1], allowed[left])
    return near


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.text_chunks(batches, "u_text", 4 * CHUNK_BYTES):
        yield batch.select(["u", "v"]).filter(pa.array(near_texts(batch.column("u_text"), batch.column("v_text"))))


def _filter(values: DataFrame) -> np.ndarray:
    """A bit set of fixed size that holds the lowest bits of the column ``value``."""
    low = FILTER_BITS - 1
    bits = values.groupBy(F.expr(f"shiftright(value & {low}, 6)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(value & 63))")).alias("bits"))
    filled = bits.toPandas()
    table = np.zeros(FILTER_BITS >> 6, np.uint64)
    table[filled["at"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def _in_filter(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slots = values & (FILTER_BITS - 1)
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _documents(doc_id: pa.Array, text_keys: pa.Array) -> np.ndarray:
    """One number for an id and a text."""
    ids = doc_id.cast(pa.int64())
    own = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64) + pc.is_null(ids).to_numpy(zero_copy_only=False)
    return common.mix(text_keys.to_numpy(zero_copy_only=False).view(np.uint64) + common.mix(own))


def _places(documents: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One number for a line of a document."""
    return common.mix(documents + common.mix(line)).view(np.int64)


def _first_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first occurrences of the digests that are asked for, with the numbers of their documents and places."""
    for _, rows in common.grouped(batches, "part", ["data", "digest"]):
        asked = np.array([digest for _, digest in rows if digest is not None], np.int64).view(np.uint64)
        lists = [data for data, _ in rows if data is not None]
        if not len(asked) or not lists:
            continue
        digest, has, id_, key, line = _unpack_firsts(lists)
        chosen = np.isin(digest, asked)
        digest, has, id_, key, line = (x[chosen] for x in (digest, has, id_, key, line))
        ids, keys = _ids(has, id_), pa.array(key.view(np.int64))
        own = _documents(ids, keys)
        places = pa.array(_places(own, line))
        yield pa.record_batch(
            {"digest": pa.array(digest.view(np.int64)), "doc_id": ids, "text_key": keys, "line": pa.array(line.astype(np.int32)), "document": pa.array(own.view(np.int64)), "place": places}
        )


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest, normal``: the normalised text of the wanted lines, ``digest, document, place``: where the line occurs.

    Documents are read again.  Two filters of fixed size, of the documents and of the places of the lines, keep most others
    from being worked on and shuffled; what they let through in error is dropped by the join.
    """
    spark = docs.sparkSession
    texts = spark.sparkContext.broadcast(_filter(wanted.select(F.col("document").alias("value"))))
    places = spark.sparkContext.broadcast(_filter(wanted.select(F.col("place").alias("value"))))

    @F.arrow_udf("boolean")
    def holds(ids: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array(_in_filter(texts.value, _documents(ids, keys).view(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.text_chunks(batches, limit=CHUNK_BYTES):
            lines, per_text = split_lines(common.plain_texts(piece.column("text")))
            line = np.arange(len(lines)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            own = np.repeat(_documents(piece.column("doc_id"), piece.column("text_key")), per_text)
            codes, counts, dictionary = normal_words(lines.filter(pa.array(_in_filter(places.value, _places(own, line)))))
            found = digests(common.hash_words(dictionary)[codes], counts)
            rows = np.flatnonzero(counts >= NEAR_WORDS)
            rows = rows[np.unique(found[rows], return_index=True)[1]]
            each = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts))), dictionary.take(pa.array(codes)))
            normal = pc.binary_join(each, pa.scalar(" ", dictionary.type)).cast(pa.string())
            yield pa.record_batch({"digest": pa.array(found[rows]), "normal": normal.take(pa.array(rows))})

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = docs.select("doc_id", "text", key.alias("text_key")).filter(holds("doc_id", "text_key")).mapInArrow(run, "digest bigint, normal string")
    return common.write_stage(lines.join(wanted.select("digest"), "digest").groupBy("digest").agg(F.min("normal").alias("normal")), "line-texts")


def _may_link(a: str, b: str):
    """As ``_in_reach``."""
    words, mark, half = ([F.col(f"{side}.{name}") for side in (a, b)] for name in ("words", "mark", "half"))
    allowed = F.floor(F.greatest(*words) * F.lit(1 - SIMILARITY) + F.lit(1e-9))
    all_, first = mark[0].bitwiseXOR(mark[1]), half[0].bitwiseXOR(half[1])
    fine = F.bit_count(first) + F.bit_count(all_.bitwiseXOR(first))
    close = F.greatest(*words) - F.least(*words) <= allowed
    return close & (F.bit_count(all_) <= 2 * allowed) & ((F.least(*words) < MARKED_WORDS) | (fine <= 2 * allowed))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, lines``: the numbers of the lines of each document that repeat a line kept elsewhere.

    A line is normalised to its words of letters and digits in lower case; one without words is never removed.  Lines with
    equal words are copies, however short.  Others link if at most 15 % of the words of the longer one are edited.
    Candidates of ``HASHED_WORDS`` words or more agree in a block of their SimHash; lines of up to ``LISTED_WORDS`` words
    share one of their rarest words, by which none of their links is missed.  Of each connected group the occurrence with
    the smallest (doc_id, text key, line number) stays; a null id comes first.

    Keys and first occurrences are packed by ranges and shuffled once; only entries with another one in reach of their key,
    and lines that are copies of an earlier one, become rows.  ``docs`` must come from a table, whose partitions hold the same
    rows on a retry.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))
    partitions = common.shuffle_partitions(docs.sparkSession)

    def line_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _line_parts(ranks.value, RANGES * partitions, batches)

    packed = keyed.mapInArrow(line_parts, _PARTS).repartition(partitions, "part").sortWithinPartitions("part")
    entries = common.write_stage(packed.mapInArrow(_matched, _ENTRY_TYPES), "lines")
    lists = entries.filter(F.col("kind") == _LIST).select("key", "node", "words", "mark", "half")
    pairs = common.write_stage(entries.filter(F.col("kind") == _PAIR).select("u", "v").distinct(), "near-pairs")

    # where the lines that may have near ones occur first; the packed occurrences are opened in the tasks
    nodes = lists.select("node").unionAll(pairs.select("u")).unionAll(pairs.select("v")).distinct()
    at = F.expr(f"int(shiftright(shiftrightunsigned(node, 32) * {RANGES * partitions}L, 32))")
    asked = nodes.select(at.alias("part"), F.lit(None).cast("binary").alias("data"), F.col("node").alias("digest"))
    placed = entries.filter(F.col("kind") == _PLACED).select("part", "data", F.lit(None).cast("bigint").alias("digest"))
    both = placed.unionAll(asked).repartition(partitions, "part").sortWithinPartitions("part")
    firsts = common.write_stage(
        both.mapInArrow(_first_places, "digest bigint, doc_id bigint, text_key bigint, line int, document bigint, place bigint"), "first-lines"
    )
    texts = _line_texts(docs, firsts.select("digest", "document", "place"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("digest").alias("u"), F.col("normal").alias("u_text")), "u").join(
            texts.select(F.col("digest").alias("v"), F.col("normal").alias("v_text")), "v"
        )
        return both.select("u", "v", "u_text", "v_text").mapInArrow(_similar, "u bigint, v bigint")

    labels = linked_by_lists(lists, _may_link, verified, pairs, THINNED)
    first = F.struct("doc_id", "text_key", "line")
    named = firsts.select(F.col("digest").alias("node"), first.alias("first")).join(labels, "node")
    kept = named.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("kept")).filter("size > 1").drop("size")
    near = named.join(kept, "label").filter(~F.col("first").eqNullSafe(F.col("kept"))).select("first.doc_id", "first.text_key", F.array("first.line").alias("lines"))
    spare = entries.filter(F.col("kind") == _COPIES).select("doc_id", "text_key", "lines").unionAll(near)
    return spare.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row, text, n_lines, n_removed``: every document (its own columns in ``row``) with its text after line dedup.

    A null text stays null and has no lines; an empty one has one empty line.  Rows with equal id and text are one document:
    what is removed from one is removed from the other.  Texts and lines of any length are worked on whole.  No rows give no
    rows.  Columns of any names are kept in ``row`` and never read, but for ``doc_id`` and ``text``.
    """
    removed = repeated_lines(docs).select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("lines").alias("removed"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = rows.join(
        removed, F.col("row.doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("of_key")), "left"
    )
    lines = F.split(F.col("row.text"), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("removed", i))
    return found.select(
        "row",
        F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.octet_length("row.text") - F.octet_length(F.replace("row.text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "n_lines", "n_removed", "text")

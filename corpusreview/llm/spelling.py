"""Spelling variants: near words by a bit-sliced index of positions and letters, and the forms they go back to."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

#: A word has at least so many code points, and occurs at least so often.
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: An occurrence loses a letter where this divides the crc32 of its document's id and itself.
EDIT_ONE_IN = 97
#: Words of one key that are indexed together; more are cut into parts, and all parts are compared with all others.
PART_WORDS = 1 << 13
#: Pairs of a word and a lane of 64 words that are followed at a time.
STEP_PAIRS = 1 << 18
#: Text bytes that are counted at a time.
CHUNK_BYTES = 8 << 20
_LANE = 64
_LONGEST = 64
_LETTERS = r"[^A-Za-z\x{C0}-\x{FF}]+"
_CRC_STEP = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _shifted(crcs: np.ndarray, longest: int) -> np.ndarray:
    """The share of each crc32 in that of a longer text, by the number of bytes that follow: bytes x crcs."""
    out = [crcs.astype(np.uint32)]
    for _ in range(longest):
        out.append(_CRC_STEP[out[-1] & np.uint32(255)] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


def run_counts(ids: pa.Array, texts: pa.Array) -> tuple[list[str], list[int]]:
    """The words of some documents, after the edits, with the number of their occurrences; words that are too short are left out.

    The crc32 of ``<id>:<run>`` is put together from those of the id and of the run, so no text is built for an occurrence.
    """
    codes, counts, runs = common.words(pc.replace_substring_regex(texts, _LETTERS, " "))
    length = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.binary_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    enough = length[codes] >= MIN_LENGTH if len(codes) else np.zeros(0, bool)
    codes, owner = codes[enough], owner[enough]
    words = runs.to_pylist()
    heads = ["" if i is None else str(i) for i in ids.to_pylist()]
    crc = np.array([zlib.crc32(f"{i}:".encode()) for i in heads], np.uint32)
    own = np.array([zlib.crc32(w.encode()) if n >= MIN_LENGTH else 0 for w, n in zip(words, length)], np.uint32)
    usual = size[codes] <= _LONGEST if len(codes) else np.zeros(0, bool)
    hashes = np.zeros(len(codes), np.uint32)
    shifted = _shifted(crc, _LONGEST)
    hashes[usual] = shifted[size[codes[usual]], owner[usual]] ^ own[codes[usual]]
    for k in np.flatnonzero(~usual):
        hashes[k] = zlib.crc32(f"{heads[owner[k]]}:{words[codes[k]]}".encode())
    edited = hashes % EDIT_ONE_IN == 0
    times = np.bincount(codes[~edited], minlength=len(words))
    found = {words[i]: int(times[i]) for i in np.flatnonzero(times)}
    for code, h in zip(codes[edited].tolist(), hashes[edited].tolist()):
        word = words[code]
        at = h % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= MIN_LENGTH:
            found[word] = found.get(word, 0) + 1
    return list(found), list(found.values())


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in common.text_chunks(batches, limit=CHUNK_BYTES):
        words, times = run_counts(piece.column("doc_id"), common.plain_texts(piece.column("text")))
        yield pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array(times, pa.int64())})


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words that are long and frequent enough.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, of whole texts; a null text has
    none.  In one of ``EDIT_ONE_IN`` occurrences, chosen by the crc32 of id and run, one letter is left out.  The id of a
    row without one counts as the empty text.
    """
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def keyed(words: DataFrame) -> DataFrame:
    """``size, part, of, word, n, member, asks``: every word under each key by which near words may meet it.

    Words of ``size`` letters and words with one more are near only if the first half or the rest of the letters of the
    shorter one, counted from the same end, are equal in both.  So a word has two keys for its own length and two for the one
    below; words that share a key make a group.  Groups of more than ``PART_WORDS`` words are cut into parts by a hash, and
    the parts of those who ask are compared with the parts of the members in cells of their own, so no task holds a group.
    A word is a ``member`` in one row of cells and ``asks`` in one column.  Only words of ``size`` letters ask.
    """
    length = F.char_length("word")
    sides = []
    for size in (length, length - 1):
        half = F.floor(size / 2).cast("int")
        sides += [F.struct(size.alias("size"), F.concat(F.lit("<"), F.substring("word", F.lit(1), half)).alias("part"))]
        sides += [F.struct(size.alias("size"), F.concat(F.lit(">"), F.right("word", size - half)).alias("part"))]
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("k")).select("k.size", "k.part", "word", "n").filter(F.col("size") >= MIN_LENGTH)
    crowded = rows.groupBy("size", "part").count().filter(F.col("count") > PART_WORDS).select(
        F.col("size").alias("in_size"), F.col("part").alias("in_part"), F.ceil(F.col("count") / PART_WORDS).cast("int").alias("parts")
    )
    rows = rows.join(crowded, (F.col("size") == F.col("in_size")) & (F.col("part") == F.col("in_part")), "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    asks = F.char_length("word") == F.col("size")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = F.transform(every, lambda k: F.col("own") * F.col("parts") + k)
    asking = F.transform(every, lambda k: k * F.col("parts") + F.col("own"))
    cells = rows.withColumn("of", F.explode(F.when(asks, F.array_union(as_member, asking)).otherwise(as_member)))
    member = F.floor(F.col("of") / F.col("parts")) == F.col("own")
    return cells.select("size", "part", "of", "word", "n", member.alias("member"), (asks & (F.col("of") % F.col("parts") == F.col("own"))).alias("asks"))


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, words x width; 0 behind the end.  U+0000 is no letter, nor is anything above U+00FF."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), np.uint8)
    return flat.reshape(len(words), width)


def _slices(column: np.ndarray, lane: np.ndarray, bit: np.ndarray, lanes: int) -> np.ndarray:
    """For each letter the members that have it at one position, 64 to a number: 256 x lanes."""
    table = np.zeros(256 * lanes, np.uint64)
    np.add.at(table, column.astype(np.int64) * lanes + lane, bit)
    return table.reshape(256, lanes)


def near_words(size: int, members: list[str], group: np.ndarray, asking: list[str], ask_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``asking``, place in ``members``) of near words of the same group.

    ``members`` have ``size`` or one more letters and are sorted by group; ``asking`` have ``size``.  Members are numbered
    through, 64 to a lane.  For a word and a lane three sets of bits go along the positions: members equal so far, members
    with one other letter so far, and members with one more letter so far, which are read one position further on.
    """
    lanes = -(-len(members) // _LANE)
    place = np.arange(len(members))
    lane, bit = place // _LANE, np.uint64(1) << (place % _LANE).astype(np.uint64)
    own, asked = _letters(members, size + 2), _letters(asking, size)
    longer = np.zeros(lanes, np.uint64)
    np.add.at(longer, lane, np.where(own[:, size] > 0, bit, np.uint64(0)))
    low = np.searchsorted(group, ask_group, "left")
    high = np.searchsorted(group, ask_group, "right")
    first, last = low // _LANE, np.where(high > low, (high - 1) // _LANE, low // _LANE - 1)
    spans = last - first + 1
    ends = np.cumsum(spans)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(asking):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_PAIRS, "right")))
        span = spans[start:stop]
        who = np.repeat(np.arange(start, stop), span)
        at = first[who] + np.arange(len(who)) - np.repeat(np.cumsum(span) - span, span)
        equal = np.full(len(who), ~np.uint64(0))
        other, more = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
        here = _slices(own[:, 0], lane, bit, lanes)
        for i in range(size):
            further = _slices(own[:, i + 1], lane, bit, lanes)
            letter = asked[who, i]
            same = here[letter, at]
            more = (more | equal) & further[letter, at]
            other = (other & same) | (equal & ~same)
            equal &= same
            here = further
        near = (other & ~longer[at]) | ((more | equal) & longer[at])
        # members of the lane that belong to other groups
        begin, end = np.maximum(low[who] - at * _LANE, 0).astype(np.uint64), np.minimum(high[who] - at * _LANE, _LANE).astype(np.uint64)
        ones = ~np.uint64(0)
        near &= (ones << begin) & (ones >> (np.uint64(_LANE) - end))
        some = np.flatnonzero(near)
        bits = np.unpackbits(near[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        target = at[some][row] * _LANE + column
        found.append((who[some][row], target))
        start = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _best(size: int, rows: dict[str, list]) -> pa.RecordBatch | None:
    """For each word with near words in whole groups of one size: their number and the most frequent of them."""
    group = np.cumsum([0, *[a != b for a, b in zip(zip(rows["part"][1:], rows["of"][1:]), zip(rows["part"], rows["of"]))]])
    member, asks = np.array(rows["member"], bool), np.array(rows["asks"], bool)
    # a group needs someone who asks and a second word
    useful = (np.bincount(group) > 1) & (np.bincount(group, weights=asks) > 0) & (np.bincount(group, weights=member) > 0)
    member, asks = np.flatnonzero(member & useful[group]), np.flatnonzero(asks & useful[group])
    if not len(member) or not len(asks):
        return None
    words = rows["word"]
    u, v = near_words(size, [words[i] for i in member], group[member], [words[i] for i in asks], group[asks])
    u, v = asks[u], member[v]
    # words that share the first half meet there, so they are left out where they meet by the rest
    half = size // 2
    heads = np.unique([w[:half] for w in words], return_inverse=True)[1] if half else np.zeros(len(words), np.int64)
    behind = np.array([p[:1] == ">" for p in rows["part"]])
    fresh = ~behind[u] | (heads[u] != heads[v])
    u, v = u[fresh], v[fresh]
    # words of one length ask each other; a longer one does not ask
    long = np.array([len(w) > size for w in words])
    u, v = np.concatenate([u, v[long[v]]]), np.concatenate([v, u[long[v]]])
    if not len(u):
        return None
    order = sorted(range(len(words)), key=lambda i: (-rows["n"][i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, u, rank[v])
    times = np.bincount(u, minlength=len(words))
    some = np.flatnonzero(times)
    chosen = [order[k] for k in best[some]]
    return pa.record_batch(
        {
            "word": pa.array([words[i] for i in some], pa.string()),
            "n_near": pa.array(times[some], pa.int64()),
            "less_n": pa.array([-rows["n"][i] for i in chosen], pa.int64()),
            "near": pa.array([words[i] for i in chosen], pa.string()),
        }
    )


_COLUMNS = ("size", "part", "of", "word", "n", "member", "asks")


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by size, part and number of the part; whole groups are compared, many small ones at a time."""
    held: dict[str, list] = {c: [] for c in _COLUMNS}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            if held["size"]:
                ended = row[:3] != (held["size"][-1], held["part"][-1], held["of"][-1])
                if ended and (row[0] != held["size"][-1] or len(held["size"]) >= PART_WORDS):
                    done = _best(held["size"][-1], held)
                    if done is not None:
                        yield done
                    held = {c: [] for c in _COLUMNS}
            for c, value in zip(_COLUMNS, row):
                held[c].append(value)
    if held["size"]:
        done = _best(held["size"][-1], held)
        if done is not None:
            yield done


def near_counts(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: the number of near words, and of these the most frequent one (ties: the smallest)."""
    rows = keyed(words).repartition("size", "part", "of").sortWithinPartitions("size", "part", "of")
    found = rows.mapInArrow(_compared, "word string, n_near bigint, less_n bigint, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less_n", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less_n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of all words with a form, from ``word, form``: each round doubles the length of the step.

    Forms are ever more frequent, so chains end, after no more than the binary logarithm of the largest count.
    """
    now = common.write_stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nexts = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = now.join(nexts, F.col("root") == F.col("at"), "left")
        now = common.write_stage(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary of ``docs``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's ``form`` is its near
    word of largest n (ties: the smallest in code-point order) if that occurs at least ``RATIO`` times as often; ``root`` is
    the last form of the chain, the word itself if it has none.

    Null, empty and letterless texts have no words; a text of any length is read whole.  Repeated rows count as often as
    they occur.  No words give no rows; other columns are ignored.
    """
    words = common.write_stage(vocabulary(docs), "spelling-words")
    near = near_counts(words).withColumnRenamed("word", "of_word")
    takes = F.col("near_n") >= RATIO * F.col("n")
    found = words.join(near, F.col("word") == F.col("of_word"), "left").select(
        "word",
        F.when(takes, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(takes, F.col("near_n")).alias("form_n"),
    )
    found = common.write_stage(found, "spelling-forms")
    ends = roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "of_word")
    return found.join(ends, F.col("word") == F.col("of_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(common.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT id, unnest(regexp_extract_all(text, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM found),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda b: [('0x' || b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, (r & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT) AS h
  FROM counted),
edited AS (
  SELECT CASE WHEN h % {EDIT_ONE_IN} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
holes AS (SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS hole, left(word, i - 1) || substr(word, i + 1) AS cut FROM places),
links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT v.word, h.word, h.n FROM vocabulary v JOIN holes h ON h.cut = v.word
  UNION SELECT h.word, v.word, v.n FROM vocabulary v JOIN holes h ON h.cut = v.word),
ordered AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM links),
formed AS (
  SELECT v.word, v.n, coalesce(o.n_near, 0)::BIGINT AS n_near, CASE WHEN o.near_n >= {RATIO} * v.n THEN o.near END AS form,
         CASE WHEN o.near_n >= {RATIO} * v.n THEN o.near_n END AS form_n
  FROM vocabulary v LEFT JOIN ordered o ON o.word = v.word AND o.place = 1),
chains AS (
  SELECT word, word AS here FROM formed
  UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chains c ON c.word = f.word JOIN formed g ON g.word = c.here AND g.form IS NULL
"""

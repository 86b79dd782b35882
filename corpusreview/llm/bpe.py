"""BPE encoding by prefix-sharing trie traversal, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusreview.llm import common

END = "</w>"
#: Pairs of tokens of which a Python worker remembers between batches whether their boundary survives; nine bytes each, or up to twice that.
REMEMBERED = 1_000_000
#: Words of more bytes are walked one by one, others level by level of their trie.
LONG = 96
_NEVER = 1 << 60

#: Lower case of letters that came with newer versions of Unicode than Python's tables may have.
_NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_NEWER = regex.compile("[" + "".join(map(chr, _NEWER_LOWER)) + "]")


def _byte_letters() -> str:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(spare)) for b in range(256))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of large binary words; of each of their bytes the word, its place and its value."""
    buffers = words.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(ends)
    owner = np.repeat(np.arange(len(size)), size)
    return size, owner, np.arange(len(owner)) - (ends[:-1] - ends[0])[owner], np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]]


def _spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The values of the chosen spans, one after the other."""
    taken = sizes[chosen]
    ends = np.cumsum(taken)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[chosen] - ends + taken, taken)]


class Tokenizer:
    """A BPE with word ends, read from the JSON text of a tokenizer file.

    ``encode_distinct`` walks the trie of the words it is given, all nodes of a level together.  The state of a node is the
    last token of the encoding of its prefix; what remains before that token is the encoding of an ancestor, so a shared
    prefix is worked out once.  A token may end a prefix if it is an encoding of itself and the boundary to the last token
    before it survives all merges; exactly one does.  The tokens that end a prefix are found by an automaton of all tokens.
    """

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        file = json.loads(spec)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: at for at, pair in enumerate(pairs)}
        self.parts = {}
        for pair in pairs:
            self.parts.setdefault("".join(pair), pair)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        pattern = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.pieces_of_lines = regex.compile(f"{pattern}|\n").findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = dict(enumerate(_byte_letters()))
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.whole: dict[str, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        slots = 1 << max(remembered - 1, 1).bit_length()
        self.pairs, self.fit = np.full(slots, -1, np.int64), np.zeros(slots, bool)
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self._automaton()

    def _automaton(self) -> None:
        """States for the longest beginning of a token at the end of a prefix, and by length the tokens that end there.

        ``step`` leads from the ``row`` of a state and a byte to the next state; a state that nothing goes on from has the row
        of the next shorter one.  ``inside`` and ``ending`` are the longest token without
        and with a word end that ends a state, ``after`` is the next shorter one of a token, or -1.
        """
        bytes_of = {c: b for b, c in self.letters.items()}
        child: dict[int, int] = {}
        depth, above, last = [0], [0], [0]
        at_token: list[tuple[int, int, bool]] = []
        self.length = np.zeros(len(self.tokens), np.int64)
        for token, number in self.vocab.items():
            plain = token.removesuffix(END)
            at = 0
            for c in plain:
                key = at << 8 | bytes_of[c]
                to = child.get(key)
                if to is None:
                    to = child[key] = len(depth)
                    depth.append(depth[at] + 1)
                    above.append(at)
                    last.append(bytes_of[c])
                at = to
            if plain:
                at_token.append((at, number, plain != token))
                self.length[number] = len(plain)
        levels, parent, byte = np.array(depth), np.array(above), np.array(last)
        goes_on = np.zeros(len(depth), bool)
        goes_on[parent] = True
        self.row = (np.cumsum(goes_on) - 1).astype(np.int32)
        self.step = np.zeros((int(goes_on.sum()), 256), np.int32)
        self.inside, self.ending = np.full(len(depth), -1, np.int32), np.full(len(depth), -1, np.int32)
        for at, number, ends in at_token:
            (self.ending if ends else self.inside)[at] = number
        shorter = np.zeros(len(depth), np.int32)
        order = np.argsort(levels, kind="stable")
        cuts = np.searchsorted(levels[order], np.arange(levels.max() + 2))
        for low, high in zip(cuts[:-1], cuts[1:]):
            nodes = order[low:high]
            deep = nodes[levels[nodes] > 1]
            shorter[deep] = self.step[self.row[shorter[parent[deep]]], byte[deep]]
            self.row[nodes] = np.where(goes_on[nodes], self.row[nodes], self.row[shorter[nodes]])
            inner = nodes[goes_on[nodes]]
            self.step[self.row[inner]] = self.step[self.row[shorter[inner]]]
            below = order[high : cuts[min(levels[nodes[0]] + 2, len(cuts) - 1)]]
            self.step[self.row[parent[below]], byte[below]] = below
            for out in (self.inside, self.ending):
                out[nodes] = np.where(out[nodes] < 0, out[shorter[nodes]], out[nodes])
        self.after = np.full(len(self.tokens), -1, np.int32)
        for at, number, ends in at_token:
            self.after[number] = (self.ending if ends else self.inside)[shorter[at]]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols, best rank first, the leftmost of equal ones."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), _NEVER))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def is_whole(self, token: str) -> bool:
        """Whether the token's own letters merge to just this token."""
        found = self.whole.get(token)
        if found is None:
            letters = list(token.removesuffix(END))
            if token.endswith(END):
                letters[-1] += END
            found = self.whole[token] = self.merged(letters) == [token]
        return found

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one edge while the token forms, each with the rank of the merge that takes it up."""
        steps = []
        above = _NEVER
        while True:
            steps.append((token, above))
            parts = self.parts.get(token)
            if parts is None:
                return steps[::-1]
            above = self.rank[parts]
            token = parts[side]

    def is_firm(self, left: str, right: str) -> bool:
        """Whether the boundary between two whole tokens survives: no merge across it comes before the merges inside."""
        lefts, rights = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            a, taken_left = lefts[i]
            b, taken_right = rights[j]
            across = self.rank.get((a, b), _NEVER)
            # of equal pairs the leftmost merges first
            if across < taken_left and across <= taken_right and across < _NEVER:
                return False
            if taken_left == taken_right == _NEVER:
                return True
            if taken_left <= taken_right:
                i += 1
            else:
                j += 1

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right token is whole and firm behind the left one, or behind nothing (-1)."""
        keys = (left.astype(np.int64) + 1) * len(self.tokens) + right
        slots = (common.mix(keys) & np.uint64(len(self.pairs) - 1)).astype(np.int64)
        fits = self.fit[slots]
        new = np.flatnonzero(self.pairs[slots] != keys)
        if len(new):
            distinct, first, of = np.unique(keys[new], return_index=True, return_inverse=True)
            found = np.zeros(len(distinct), bool)
            for k, (a, b) in enumerate(zip(left[new[first]].tolist(), right[new[first]].tolist())):
                found[k] = self.is_whole(self.tokens[b]) and (a < 0 or self.is_firm(self.tokens[a], self.tokens[b]))
            fits[new] = found[of]
            places, one = np.unique(slots[new[first]], return_index=True)
            self.pairs[places], self.fit[places] = distinct[one], found[one]
        return fits

    def _last_tokens(self, tokens: np.ndarray, end: int, rows: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The token, of those that end the first ``end`` bytes of each row, that ends its encoding; ``tokens`` are the longest."""
        tokens = tokens.copy()
        left = np.arange(len(rows))
        while len(left):
            own = tokens[left]
            if (own < 0).any():
                raise ValueError("no encoding of a word")
            left = left[~self._fits(states[end - self.length[own], rows[left]], own)]
            tokens[left] = self.after[tokens[left]]
        return tokens

    def _levels(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of distinct binary words, sorted and none of them empty."""
        n = len(words)
        size, owner, place, data = _bytes(words)
        letters = np.zeros((n, int(size.max())), np.uint8)
        letters[owner, place] = data
        equal = letters[1:] == letters[:-1]
        # the bytes that a word shares with the one before, and with the next one
        shared = np.append(0, np.minimum(np.where(equal.all(axis=1), letters.shape[1], equal.argmin(axis=1)), np.minimum(size[1:], size[:-1])))
        ahead = np.append(shared[1:], 0)
        states = np.full((letters.shape[1] + 1, n), -1, np.int32)  # of all prefixes, without word ends
        at = np.zeros(n, np.int32)
        final = np.zeros(n, np.int32)
        rows = np.arange(n)
        for end in range(1, letters.shape[1] + 1):
            rows = rows[size[rows] >= end]
            first = shared[rows] < end
            nodes = rows[first]
            of = np.cumsum(first) - 1
            here = self.step[self.row[at[nodes]], letters[nodes, end - 1]]
            at[rows] = here[of]
            inner = (size[nodes] > end) | (ahead[nodes] >= end)
            found = np.full(len(nodes), -1, np.int32)
            found[inner] = self._last_tokens(self.inside[here[inner]], end, nodes[inner], states)
            states[end, rows] = found[of]
            ended = rows[size[rows] == end]
            final[ended] = self._last_tokens(self.ending[at[ended]], end, ended, states)
        # from the last token of each word back to its first
        steps = []
        rows, token, end = np.arange(n), final, size
        counts = np.zeros(n, np.int64)
        while len(rows):
            steps.append((rows, token))
            counts[rows] += 1
            end = end - self.length[token]
            more = end > 0
            rows, end = rows[more], end[more]
            token = states[end, rows]
        ids = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for back, (rows, token) in enumerate(steps, 1):
            ids[ends[rows] - back] = token
        return ids, counts

    def _one_by_one(self, plain: str, known: dict[tuple[str, str], bool]) -> list[int]:
        """Ids of a word of any length; ``known`` are the boundaries met before."""
        word = plain.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        states = [""]
        for end in range(1, len(word) + 1):
            mark = END if end == len(word) else ""
            for start in range(max(end - self.longest, 0), end):
                token = word[start:end] + mark
                if token not in self.vocab:
                    continue
                pair = states[start], token
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = self.is_whole(token) and (not start or self.is_firm(*pair))
                if fits:
                    break
            else:
                raise ValueError(f"no encoding of {plain!r}")
            states.append(token)
        ids, end = [], len(word)
        while end:
            ids.append(self.vocab[states[end]])
            end -= int(self.length[ids[-1]])
        return ids[::-1]

    def encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and their number in each word; special tokens are words, too."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
        known: dict[tuple[str, str], bool] = {}
        alone = {i: self._one_by_one(words[i].as_py(), known) for i in np.flatnonzero(sizes > LONG).tolist()}
        for content, number in self.special.items():
            at = pc.index(words, pa.scalar(content, words.type)).as_py()
            if at >= 0:
                alone[at] = [number]
        rows = np.ones(len(words), bool)
        rows[list(alone)] = False
        rows = np.flatnonzero(rows)
        plain = words.take(pa.array(rows)).cast(pa.large_binary())
        order = pc.array_sort_indices(plain)
        ids, counts = self._levels(plain.take(order)) if len(rows) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        numbers = np.concatenate([rows[order.to_numpy()], np.array(list(alone), np.int64)])
        counts = np.concatenate([counts, np.array([len(x) for x in alone.values()], np.int64)])
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(alone.values()), np.int32)])
        back = np.argsort(numbers)
        return _spans(ids, np.cumsum(counts) - counts, counts, back), counts[back]

    def encode_words(self, words: Iterable[str]) -> None:
        """Encode distinct words into ``known``."""
        words = list(words)
        ids, counts = self.encode_distinct(pa.array(words, pa.large_string()))
        self.known.update((w, tuple(x.tolist())) for w, x in zip(words, common.split_by(ids, counts)))

    def _pieces(self, text: str, pieces=None) -> list[str]:
        """The words that the file's pattern finds in a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        if _NEWER.search(text):
            text = text.translate(_NEWER_LOWER)
        return (pieces or self.pieces)(text.replace("Σ", "σ").lower())  # letter by letter: no final sigma

    def _runs(self, run: str) -> list[str]:
        """Words and special tokens of a text without white space around."""
        if self.specials is None or "<" not in run:
            return self._pieces(run)
        parts = self.specials.split(run)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._pieces(p))]

    def _words_of(self, runs: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of all runs, the place of the first one of each run, and their number.

        Runs of ASCII letters are words; the others are split together, as nothing reaches across a line end.
        """
        plain = pc.and_(pc.ascii_is_alpha(runs), pc.equal(pc.binary_length(runs), pc.utf8_length(runs)))
        marked = pc.and_(pc.invert(plain), pc.match_substring(runs, "<")) if self.special else pc.and_(plain, pc.invert(plain))
        plain, marked = plain.to_numpy(zero_copy_only=False), marked.to_numpy(zero_copy_only=False)
        starts, counts = np.zeros(len(runs), np.int64), np.ones(len(runs), np.int64)
        starts[plain] = np.arange(plain.sum())
        found: list[str] = []
        rest = np.flatnonzero(~plain & ~marked)
        if len(rest):
            found = self._pieces("\n".join(runs.take(pa.array(rest)).to_pylist()), self.pieces_of_lines)
        ends = pc.equal(pa.array(found, pa.large_string()), "\n").to_numpy(zero_copy_only=False)
        line = np.cumsum(ends)[~ends]
        counts[rest] = np.bincount(line, minlength=len(rest)) if len(rest) else 0
        found = [w for w in found if w != "\n"]
        for at in np.flatnonzero(marked).tolist():
            own = self._runs(runs[at].as_py())
            counts[at] = len(own)
            found += own
        others = np.concatenate([rest, np.flatnonzero(marked)])
        starts[others] = int(plain.sum()) + np.cumsum(counts[others]) - counts[others]
        letters = pc.ascii_lower(runs.filter(pa.array(plain)))
        return pa.concat_arrays([letters, pa.array(found, pa.large_string())]), starts, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the offsets of the texts.

        No word reaches across white space, so each distinct run between white space is split once, and its words encoded.
        """
        codes, counts, dictionary = common.words(texts, lower=False)
        words, first, number = self._words_of(dictionary)
        words = words.dictionary_encode()
        of = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = self.encode_distinct(words.dictionary)
        # ids of the words, then of the runs, then of the texts
        in_order = of[_spans(np.arange(len(of)), first, number, np.arange(len(first)))]
        flat = _spans(ids, np.cumsum(sizes) - sizes, sizes, in_order)
        totals = np.append(0, np.cumsum(sizes[in_order]))
        ends = np.cumsum(number)
        taken = totals[ends] - totals[ends - number]
        offsets = np.append(0, np.cumsum(taken[codes]))[np.append(0, np.cumsum(counts))]
        return _spans(flat, totals[ends - number], taken, codes), offsets

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: without a decoder step in the file, the tokens joined by one space."""
        offsets = pc.subtract(ids.offsets, ids.offsets[0]).cast(pa.int64())
        names = pa.LargeListArray.from_arrays(offsets, self.names.take(ids.flatten()))
        return pc.binary_join(names, pa.scalar(" ", pa.large_string()))


_loaded: dict[tuple[int, int], Tokenizer] = {}


def _tokenizer(spec: str, remembered: int) -> Tokenizer:
    """One per Python worker and file."""
    key = hash(spec), remembered
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec, remembered)
    return _loaded[key]


def _encoded(spec, remembered: int, chunk_bytes: int, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray, pa.Array]]:
    """Ids of documents, their token ids and the decoded texts, piece by piece."""
    tokenizer = _tokenizer(spec.value, remembered)
    for piece in common.text_chunks(batches, limit=chunk_bytes):
        ids, offsets = tokenizer.encode(common.plain_texts(piece.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        yield piece.column("doc_id"), lists, tokenizer.decode(lists)


def _spec(docs: DataFrame, tokenizer_path: str):
    with open(tokenizer_path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the token ids of every whole text and the text they decode to.

    ``tokenizer_path`` is read on the driver and broadcast; its size does not depend on the data.  Special tokens in a text
    are recognised, none are added.  A null text counts as empty and gives no ids and an empty decoded text.  Nothing is
    shuffled; rows are independent, so ties and repeated rows give repeated results.  Other columns are ignored.
    """
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in _encoded(spec, REMEMBERED, common.CHUNK_BYTES, batches):
            yield pa.record_batch({"doc_id": doc_id, "ids": ids, "decoded": decoded.cast(pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, remembered: int = REMEMBERED, chunk_bytes: int = common.CHUNK_BYTES) -> DataFrame:
    """``doc_id, ids, n_tokens, ids_sha256, decoded_sha256`` as of ``digests``, with decoded texts hashed where they are made.

    Less ``remembered`` pairs and smaller chunks take less memory and more time; the rows are the same.
    """
    spec = _spec(docs, tokenizer_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, decoded in _encoded(spec, remembered, chunk_bytes, batches):
            names = pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string()))
            yield pa.record_batch(
                {
                    "doc_id": doc_id,
                    "ids": ids,
                    "n_tokens": pc.list_value_length(ids).cast(pa.int64()),
                    "ids_sha256": _sha256(pc.binary_join(names, " ")),
                    "decoded_sha256": _sha256(decoded),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and digests of encoded documents."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def word_tokenizer() -> str:
    """Where the public word tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(common.table(spark, sf_dir, "documents"), word_tokenizer()))

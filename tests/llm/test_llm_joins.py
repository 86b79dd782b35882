"""N-gram join, line dedup, top-k and mixing against plain versions and SQL."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from llm_plain import edits, frame, groups, near_duplicates, normal_line, odd_rows, prose, words
from pyspark.sql import functions as F

from conftest import SF
from corpusreview.llm import common, components, lines, mixing, ngram_join, topk


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert sorted(tuple(r) for r in found) == sorted(groups(nodes, [x for x in links if x[0] != x[1]]).items())
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def variants(n):
    """Copies of one text with one to many words changed, so that links chain and cross lists."""
    base = prose(40, 90).split()
    rows = []
    for i in range(n):
        own = list(base)
        for k in range(i % 9):
            own[(i * 31 + k * 17) % 90] = f"v{i}x{k}"
        rows.append((1000 + i, " ".join(own), "en", "s", 0))
    return rows


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows() + variants(60)
    found = ngram_join.near_duplicates(frame(spark, rows).repartition(4)).collect()
    assert in_order(found) == in_order(near_duplicates([r[:2] for r in rows]))
    assert ngram_join.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicate_query(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert in_order(ngram_join.op9_ngram_join(spark, SF).collect()) == in_order(near_duplicates(rows))


def plain_line_links(texts):
    """Pairs of positions of distinct word sequences that at most 15 % of the longer one's words apart."""
    bags, holders = [Counter(w) for w in texts], defaultdict(list)
    for i, w in enumerate(texts):
        shared = Counter()
        for x in bags[i]:
            for j in holders[x]:
                shared[j] += min(bags[i][x], bags[j][x])
            holders[x].append(i)
        for j, k in shared.items():
            longer = max(len(w), len(texts[j]))
            allowed = longer * 15 // 100
            # an edit changes one of the longer one's words at most
            if longer - k <= allowed and edits(w, texts[j]) <= allowed:
                yield i, j


def plain_line_dedup(rows):
    """Texts without repeated lines, and the places (row, line) that go with their numbers of words; rows with equal id and text are one document."""
    rows = list(dict.fromkeys(rows))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    found = [(r, k, normal_line(line)) for r in order for k, line in enumerate((r[1] or "").split("\n"))]
    found = [x for x in found if x[2]]
    distinct = list(dict.fromkeys(x[2] for x in found))
    group = groups(range(len(distinct)), plain_line_links(distinct))
    number = {w: i for i, w in enumerate(distinct)}
    seen, gone = set(), {}
    for r, k, w in found:
        g = group[number[w]]
        if g in seen:
            gone[r, k] = len(w)
        seen.add(g)
    cut = lambda r: None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r, k) not in gone)
    return {r: cut(r) for r in rows}, gone


def removed_lines(before, after):
    """Numbers of the lines of a text that are gone; equal lines that stay are those that come first."""
    left, gone = after.split("\n") if after else [], []
    kept = iter(left)
    now = next(kept, None)
    for k, line in enumerate(before.split("\n")):
        if line == now:
            now = next(kept, None)
        else:
            gone.append(k)
    assert now is None
    return gone


def check_line_dedup(rows, found):
    """Nothing goes that brute force keeps, all short lines go that it removes, and nine tenths of all lines."""
    expected, gone = plain_line_dedup(rows)
    removed = {(r, k) for r in dict.fromkeys(rows) if r[1] is not None for k in removed_lines(r[1], found[r])}
    assert removed <= set(gone)
    short = {x for x, n in gone.items() if n <= 11}
    assert short <= removed
    assert len(removed) >= 0.9 * len(gone)
    return gone


def test_simhash_is_the_majority_of_the_words():
    texts = pa.array(["a b c", "d", " ".join(f"w{i % 700}" for i in range(1000))], pa.large_string())
    codes, counts, dictionary = lines.normal_words(texts)
    hashes = common.hash_words(dictionary)
    wide = np.stack([common.mix(hashes + np.uint64(31 * (i + 1))) for i in range(-(-lines.BLOCKS * lines.BLOCK_BITS // 64))], axis=1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1).astype(int)[:, : lines.BLOCKS * lines.BLOCK_BITS]
    codes, counts = lines.distinct_words(codes, counts)
    assert counts.tolist() == [3, 1, 700]
    plain = [2 * bits[c].sum(axis=0) > len(c) for c in np.split(codes, np.cumsum(counts)[:-1])]
    weights = 1 << np.arange(lines.BLOCK_BITS)
    expected = [b.reshape(lines.BLOCKS, lines.BLOCK_BITS) @ weights for b in plain]
    assert (lines.simhashes(hashes, codes, counts) == expected).all()


def test_edits():
    for a, b in (("a b c", "a b c"), ("a b c d", "a x c"), ("a", "b c d"), ("a b a b a", "b a b a b"), ("x y", "")):
        assert lines.edits(a.split(), b.split()) == edits(a.split(), b.split())


def test_line_dedup_of_odd_rows(spark):
    long = prose(60, 80)
    near = long.replace(long.split()[40], "other")
    rows = odd_rows() + [(50, f"{long}\nkeep me\n{long}", "en", "s", 0), (51, near, "en", "s", 0), (52, f"{near.upper()}!\n\n{prose(61, 12)}", "en", "s", 0)]
    rows = [r for r in rows if r[:2] != (5, odd_rows()[4][1])] + [odd_rows()[4]] * 2
    rows += [(53, "Yes.\nNo\n...\nyes", "en", "s", 0), (54, "YES\n...\nmaybe not", "en", "s", 0)]
    expected, _ = plain_line_dedup([r[:2] for r in rows])
    table = common.write_stage(frame(spark, rows).repartition(3), "t")
    found = lines.dedup_lines(table).select("row.doc_id", "row.text", "text", "n_lines", "n_removed").collect()
    assert len(found) == len(rows)
    for row in found:
        assert row[2] == expected[row[0], row[1]]
        assert row.n_lines == (0 if row[1] is None else len(row[1].split("\n"))) and row.n_removed == (len(removed_lines(row[1], row[2])) if row[1] else 0)
    assert {r[0]: r[2] for r in found}[54] == "...\nmaybe not"
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_line_dedup_query(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = {r.doc_id: r.text for r in lines.op10_line_dedup(spark, SF).collect()}
    assert len(check_line_dedup(rows, {r: found[r[0]] for r in rows})) > 100


def edited(draw, own, k):
    """A line with ``k`` words replaced, inserted or deleted at places spread over it."""
    own = list(own)
    for at in sorted(draw.choice(len(own), k, replace=False).tolist(), reverse=True):
        kind = draw.integers(0, 4)
        own[at : at + 1] = [] if kind == 0 else [own[at], f"in{draw.integers(1 << 40)}"] if kind == 1 else [f"re{draw.integers(1 << 40)}"]
    return own


def test_line_dedup_finds_what_brute_force_finds(spark):
    draw = np.random.default_rng(10)
    texts = []
    for length in (5, 6, 7, 10, 13):  # lines of no more than 13 words lose no link
        for _ in range(30):
            base = [f"c{int(x)}" for x in np.minimum(draw.zipf(1.3, length), 400)] if draw.integers(2) else [f"w{x}" for x in draw.integers(0, 4000, length)]
            texts += [edited(draw, base, k) for k in {0, 1, 2, length * 15 // 100, length * 15 // 100 + 1} if k < length]
    texts = [list(x) for x in dict.fromkeys(map(tuple, texts)) if len(x) >= 5]
    longer = lambda i, j: max(len(texts[i]), len(texts[j]))
    near = lambda i, j: abs(len(texts[i]) - len(texts[j])) <= 0.15 * longer(i, j) and edits(texts[i], texts[j]) * 100 <= 15 * longer(i, j)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if set(texts[i]) & set(texts[j]) and near(i, j)]
    expected = {i: 0 if least == i else 1 for i, least in groups(range(len(texts)), links).items()}
    rows = [(i, " ".join(x), None, None, None) for i, x in enumerate(texts)]
    found = lines.dedup_lines(frame(spark, rows).repartition(5)).select("row.doc_id", "n_removed").collect()
    assert sum(expected.values()) > 100 and {r.doc_id: r.n_removed for r in found} == expected


def test_word_ranks_count_every_document(spark):
    rows = [(i, f"{'oft ' * 3}\nw{i} Oft!", "en", "s", 0) for i in range(200)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    ranks = lines.word_ranks(frame(spark, rows))

    def rank(word):
        return ranks[int(common.hash_words(pa.array([word]).cast(pa.large_string()))[0]) & (lines.COUNT_SLOTS - 1)]

    assert rank("oft") == int(4 * np.log2(801))
    # 201 slots of 2 ** 20 hardly ever meet; a word of any one document is counted
    assert all(rank(f"w{i}") >= int(4 * np.log2(2)) for i in range(200))


def test_words_of_long_lines_have_no_rank(spark):
    long = [f"long{i}" for i in range(100)]
    ranks = lines.word_ranks(frame(spark, [(1, " ".join(long) + "\nshort line", "en", "s", 0), (2, "- short - - - - - -", "en", "s", 0)]))
    slots = common.hash_words(pa.array(["short", "line", *long]).cast(pa.large_string())) & np.uint64(lines.COUNT_SLOTS - 1)
    assert ranks[slots.astype(int)].tolist() == [int(4 * np.log2(3)), 4, *[0] * 100]


def test_near_words_are_those_of_few_edits():
    draw = np.random.default_rng(3)
    found = []
    for _ in range(4000):
        a = [f"w{x}" for x in draw.integers(0, 12, draw.integers(6, 40))]
        b = edited(draw, a, int(draw.integers(0, min(6, len(a)))))
        if draw.integers(4) == 0:
            draw.shuffle(b)
        found.append(lines.near_words(a, b))
        assert found[-1] == (edits(a, b) * 100 <= 15 * max(len(a), len(b)))
    assert 500 < sum(found) < 3500


def test_pairs_of_texts_link_as_their_words_do(monkeypatch):
    """Groups of pairs side by side, few pairs one by one, and texts that repeat words."""
    draw = np.random.default_rng(5)
    pairs = []
    for _ in range(1500):
        a = [f"w{x}" for x in draw.integers(0, draw.integers(2, 60), draw.integers(1, 90))]
        b = list(a)
        for _ in range(draw.integers(0, len(a) // 4 + 2)):
            at, what = draw.integers(0, len(b)), draw.integers(3)
            b[at : at + (what > 0)] = [f"w{draw.integers(60)}"] if what < 2 or len(b) == 1 else []
        pairs.append((a, b))
    u, v = (pa.array([" ".join(p[i]) for p in pairs]) for i in range(2))
    expected = [edits(a, b) * 100 <= 15 * max(len(a), len(b)) for a, b in pairs]
    assert 300 < sum(expected) < 1300
    assert lines.near_texts(u, v).tolist() == expected
    monkeypatch.setattr(lines, "SIDE_BY_SIDE", 8)
    assert lines.near_texts(u, v).tolist() == expected
    assert lines.near_texts(u[:0], v[:0]).tolist() == []


def test_simhashes_of_lines_of_any_length_agree_with_counted_words():
    draw = np.random.default_rng(6)
    hashes = common.mix(np.arange(3000).astype(np.uint64))
    counts = np.concatenate([[1, 2, 3, 254, 255, 256, 900], draw.integers(1, 40, 1500), draw.integers(1, 300, 60)])
    codes = draw.integers(0, 3000, int(counts.sum()))
    assert (lines.simhashes(hashes, codes, counts) == lines._long_simhashes(hashes, codes, counts)).all()


def test_lines_without_a_partner_do_not_become_rows(spark, monkeypatch):
    """Only copies and lines with another in reach are rows; they were all lines before."""
    rows = [(i, "\n".join([*(prose(900 + 7 * i + k, 20) for k in range(6)), "the same line", f"short {i}"]), None, None, None) for i in range(40)]
    rows += [(None, rows[3][1], None, None, None), (3, rows[3][1], None, None, None)]
    written = {}
    write = common.write_stage

    def kept(df, purpose):
        written[purpose] = write(df, purpose)
        return written[purpose]

    monkeypatch.setattr(common, "write_stage", kept)
    found = lines.repeated_lines(write(frame(spark, rows).repartition(3), "t")).collect()
    # rows with equal id and text are one document; the null id comes first and keeps its lines
    assert {r.doc_id: sorted(r.lines) for r in found} == {i: list(range(8)) if i == 3 else [6] for i in range(40)}
    assert written["lines"].filter(f"kind <> {lines._PLACED}").count() < 60


def test_keys_of_many_chunks_are_packed_together(monkeypatch):
    monkeypatch.setattr(lines, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(lines, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    texts = [prose(70 + i, 60) for i in range(40)]
    batch = pa.record_batch({"doc_id": pa.array(range(40)), "text": pa.array(texts), "text_key": pa.array(range(40))})

    def entries(packed):
        monkeypatch.setattr(lines, "PACKED", packed)
        rows = [r for b in lines._line_parts(np.zeros(lines.COUNT_SLOTS, np.uint8), 8, [batch]) for r in b.to_pylist()]
        keyed = [r for r in rows if r["kind"]]
        found = [(r["kind"], r["part"], int(k), int(n)) for r in keyed for x in [common.unpack(r["data"])] for k, n in zip(np.cumsum(x[0], dtype=np.uint64), x[1])]
        return len(keyed), sorted(found), sum(r["kind"] == 0 for r in rows)

    one, many = entries(1 << 19), entries(1)
    assert one[0] <= 16 < many[0] and one[1] == many[1] and one[2] == many[2] > 10


def test_hot_keys_of_lines_are_compared_whole(spark, monkeypatch):
    """More near-equal lines than are thinned out where they are found: one group, whatever the size of the lists."""
    base = [f"h{k}" for k in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"own{i}", *base[i % 40 + 1 :]]), None, None, None) for i in range(150)]
    assert len(rows) > 2 * lines.THINNED
    found = lines.dedup_lines(common.write_stage(frame(spark, rows).repartition(3), "t")).select("row.doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: int(i > 0) for i in range(150)}


def test_lists_larger_than_are_compared_where_they_are_found_are_compared_whole(spark):
    base = [f"h{k}" for k in range(40)]
    rows = [(i, " ".join([*base[: i % 40], f"own{i}", *base[i % 40 + 1 :]]), None, None, None) for i in range(lines.COMPARED + 200)]
    found = lines.dedup_lines(common.write_stage(frame(spark, rows).repartition(3), "t")).select("row.doc_id", "n_removed").collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: int(i > 0) for i in range(len(rows))}


def matched(groups):
    """``_matched`` of groups of (node, words, mark) by key: the pairs, and the nodes of the lists by key."""
    rows = sorted((key, node, words, mark) for key, group in groups.items() for node, words, mark in group)
    keys, node, words, mark = (np.array(x, np.uint64) for x in zip(*rows))
    data = common.pack(np.diff(keys, prepend=np.uint64(0)), node, words, mark, np.zeros(0, np.uint64))
    batch = pa.record_batch({"part": pa.array([0], pa.int32()), "kind": pa.array([lines._HASHED], pa.int32()), "data": pa.array([data], pa.binary())})
    found = [r for b in lines._matched([batch]) for r in b.to_pylist()]
    listed = {}
    for r in found:
        if r["kind"] == lines._LIST:
            listed.setdefault(r["key"] & 0xFFFFFFFF, set()).add(r["node"])
    return {(r["u"], r["v"]) for r in found if r["kind"] == lines._PAIR}, listed


def test_large_groups_of_unlike_lines_give_pairs(monkeypatch):
    """Groups of a key that are large but not alike are no lists; from 65 lines on, all of them were."""
    draw = np.random.default_rng(12)
    groups = {}
    for key, size in ((3, 1500), (4, 300), (9, 40), (10, 5)):
        marks = draw.integers(0, 1 << 63, size).tolist()
        # some are near to one before them
        for i in draw.integers(1, size, size // 5).tolist():
            marks[i] = marks[i - 1] ^ 1 << int(draw.integers(0, 60))
        groups[key] = [(int(n), int(w), m) for n, w, m in zip(draw.permutation(2000)[:size], draw.integers(14, 30, size), marks)]
    groups[4].append(groups[4][7])  # from another chunk
    allowed = {w: int(lines.allowed_edits(np.array([w]))[0]) for w in range(14, 30)}

    def near(a, b):
        most = allowed[max(a[1], b[1])]
        return a[0] != b[0] and abs(a[1] - b[1]) <= most and (a[2] ^ b[2]).bit_count() <= 2 * most

    plain = {key: {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(group) for b in group[:i] if near(a, b)} for key, group in groups.items()}
    pairs, listed = matched(groups)
    assert pairs == set().union(*plain.values()) and len(pairs) > 50 and not listed
    # alike lines stay a list, and meet one of them at once
    alike = {5: [(n, 20, 1 << n % 5) for n in range(100)]}
    assert matched(alike) == ({(0, n) for n in range(1, 100)}, {5: set(range(100))})
    # larger groups are handed on
    monkeypatch.setattr(lines, "COMPARED", 200)
    pairs, listed = matched(groups)
    assert pairs == plain[9] | plain[10] and listed == {key: {n for n, _, _ in groups[key]} for key in (3, 4)}


def test_no_more_star_rounds_where_few_members_are_near(spark, monkeypatch):
    """One round with a member of each list, then all pairs; there were three such rounds whatever they found."""
    write, written = common.write_stage, []

    def kept(df, purpose):
        written.append(purpose)
        return write(df, purpose)

    monkeypatch.setattr(common, "write_stage", kept)
    lists = spark.createDataFrame([(1, i, i) for i in range(200)] + [(2, i, i) for i in range(500, 504)], "key bigint, node bigint, at int")
    near = lambda a, b: F.abs(F.col(f"{a}.at") - F.col(f"{b}.at")) == 1
    asked = []

    def verified(pairs):
        asked.extend((r.u, r.v) for r in pairs.collect())
        return pairs.filter("u % 50 <> 0")

    found = {r.node: r.label for r in components.linked_by_lists(lists, near, verified).collect()}
    assert written.count("pairs") == 2
    assert sorted(asked) == [(i, i + 1) for i in [*range(199), *range(500, 503)]]
    assert found == {i: 0 if i == 0 else (i - 1) // 50 * 50 + 1 for i in range(200)} | {500: 500, 501: 501, 502: 501, 503: 501}


def test_shingles_are_made_of_small_pieces_of_a_chunk(monkeypatch):
    """The words of a whole chunk were held at a time, at many times the size of the text."""
    monkeypatch.setattr(ngram_join, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 0)}))
    texts = [prose(70 + i, 60) for i in range(40)] + [None, "", "one two"]
    batch = pa.record_batch({"doc_id": pa.array(range(43)), "text": pa.array(texts), "text_key": pa.array(range(43))})
    words, held = common.words, []

    def counted(texts, lower=True):
        held.append(sum(len(t) for t in texts.to_pylist()))
        return words(texts, lower)

    monkeypatch.setattr(common, "words", counted)
    whole = [r for b in ngram_join._invert(8)([batch]) for r in b.to_pylist()]
    assert len(held) == 1
    held.clear()
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 1000)
    assert [r for b in ngram_join._invert(8)([batch]) for r in b.to_pylist()] == whole
    assert len(held) > 5 and max(held) <= 1000


def test_tables_are_written_from_small_batches(spark, monkeypatch):
    """Up to 10,000 whole texts were one batch in memory."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.num_rows]), "size": pa.array([b.nbytes])})

    docs = common.write_stage(spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text")), "t")
    before = spark.conf.get(common.BATCH_BYTES)
    monkeypatch.setattr(common, "CHUNK_BYTES", 20000)
    rows = common.write_stage(docs.mapInArrow(sizes, "n bigint, size bigint"), "t").collect()
    assert sum(r.n for r in rows) == 400 and max(r["size"] for r in rows) <= 20000
    assert spark.conf.get(common.BATCH_BYTES) == before


def test_normal_words_are_letters_and_digits_in_lower_case():
    odd = ["", "--", "don't", "(The", "the)", "THE,", "a-b", "\u00c4rger!", "\u0130x", "x\u0301y", "\u00b2", "_a_", "9.5%", "\u201cthe\u201d", "\u4e2d\u6587", "$", "e\u00e9E"]
    text = pa.array([" ".join(odd), " ".join(odd[::-1]), "..."]).cast(pa.large_string())
    codes, counts, dictionary = lines.normal_words(text)
    plain = pc.replace_substring_regex(pc.utf8_lower(pa.array(odd)), r"[^\p{L}\p{N}]+", "").to_pylist()
    assert dictionary.take(pa.array(codes)).to_pylist() == [w for w in plain if w] + [w for w in plain[::-1] if w]
    assert counts.tolist() == [len([w for w in plain if w])] * 2 + [0] and len(set(dictionary.to_pylist())) == len(dictionary)


def plain_topk(queries, rows, k):
    import math

    whole = lambda v: [math.floor(1024 * x) for x in v]
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for q in sorted({i for i, v in queries if i is not None and good(v)}):
        vector = whole(min(v for i, v in queries if i == q and good(v)))
        scored = [(-sum(a * b for a, b in zip(vector, whole(v))), i) for i, v in rows if i is not None and i != q and good(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_topk_of_odd_vectors(spark, scale):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) * scale for x in draw.normal(size=40)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1])]  # ties and a repeated row
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 40), (403, [float("inf")] * 40), (None, rows[1][1]), (404, [2.0]), (405, []), (406, [0.0] * 50)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")
    asked = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    queries = table.filter("vec_id % 50 = 0")
    found = topk.top_products(queries, table.repartition(3), query_block=4).collect()
    assert sorted(tuple(r) for r in found) == sorted(plain_topk(asked, rows, 10))
    assert topk.top_products(queries, table.limit(0)).count() == 0
    assert topk.top_products(queries.limit(0), table).count() == 0
    assert topk.top_products(queries.limit(1), table.filter("vec_id in (1, 2)")).count() <= 2


def sql(statement, **tables):
    connection = duckdb.connect()
    for name, table in tables.items():
        connection.register(name, table)
    return connection.execute(statement).fetchall()


def test_topk_query(spark):
    found = topk.op5_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert in_order(found) == in_order(sql(topk.OP5_SQL.replace("FROM embeddings", f"FROM '{SF}/embeddings.parquet'")))


def mixed(df):
    return in_order(df.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again").collect())


def test_mixture_of_odd_rows(spark):
    rows = odd_rows() + [(2000 + i, prose(i, 50), "en", "hot", 0) for i in range(200)]
    table = frame(spark, rows)
    found = mixed(mixing.mixture(table))
    assert found == in_order(sql(mixing.OP8_SQL, documents=frame(spark, rows, clashes=False).toArrow()))
    assert all(r[4] <= 2 * r[1] for r in found) and [r[1] for r in found] == [len(words(t)) for _, t in sorted([r[:2] for r in rows], key=lambda r: (r[0] is None, r[0] or 0, len(words(r[1]))))]
    assert mixing.mixture(table.limit(0)).count() == 0
    assert [r[4] for r in mixed(mixing.mixture(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])))] == [0, 0]


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 400)], "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weights, mix = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0, None: 1.0}, 1.5 * 2415
    capped = {}
    while True:  # plain re-sharing
        open_ = {s: w for s, w in weights.items() if s not in capped}
        shares = {s: (mix - sum(capped.values())) * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: 2.0 * n for s, n in (("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 400)) if s in shares and shares[s] > 2 * n}
        if not over:
            break
        capped |= over
    assert found == pytest.approx({**capped, **shares})
    assert sum(found.values()) == pytest.approx(mix)


def test_mixing_query(spark):
    expected = sql(mixing.OP8_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'"))
    query = mixing.op8_mix_sources(spark, SF)
    assert mixed(query) == in_order(expected)
    places = [r.position for r in query.collect() if r.position is not None]
    assert places == sorted(places) and places[0] >= 0 and places[-1] <= 1

"""Fingerprints, token ids and licenses against plain versions."""

import dataclasses
import hashlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from llm_plain import frame, odd_rows, prose, shingle_set, words
from tokenizers import Tokenizer

from conftest import SF
from corpusreview.llm import bpe, common, fingerprints, html_text, licenses


def test_words_and_shingles_follow_the_definition():
    texts = ["", " a  B\tc\n", "x\x0by\x0cz\r", "\x1c\x85 é É", "a b c d e f", "a b c d", "\x00 \x00a"]
    codes, counts, dictionary = common.words(pa.array(texts, pa.large_string()))
    flat = [dictionary[int(c)].as_py() for c in codes]
    assert [flat[sum(counts[:i]) : sum(counts[: i + 1])] for i in range(len(texts))] == [words(t) for t in texts]
    hashes, owner = common.shingles(common.hash_words(dictionary)[codes], counts)
    assert [len(set(h)) for h in common.split_by(hashes, [sum(owner == i) for i in range(len(texts))])] == [len(shingle_set(t)) for t in texts]


def test_words_of_pieces_of_a_batch():
    texts = [prose(i, 40 + i).upper() for i in range(60)] + [None, ""]
    batch = pa.record_batch({"text": pa.array(texts)})
    found = []
    for piece in common.text_chunks([batch.slice(0, 20), batch.slice(20)], limit=1000):
        codes, counts, dictionary = common.words(common.plain_texts(piece.column("text")))
        flat = [dictionary[int(c)].as_py() for c in codes]
        found += [flat[sum(counts[:i]) : sum(counts[: i + 1])] for i in range(len(counts))]
    assert found == [words(t) for t in texts]


def test_pack_gives_back_what_it_got():
    import numpy as np

    arrays = [np.array([], np.uint64), np.array([0, 0]), np.array([1, 2**63, 2**64 - 1], np.uint64)]
    assert [a.tolist() for a in common.unpack(common.pack(*arrays))] == [a.tolist() for a in arrays]


def check_fingerprints(found, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))] == [r[0] for r in order]
    ids = [r[0] for r in order]
    marks = {}
    for at, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)]
        if ids.count(doc_id) > 1 or ids.count(following[0]) > 1:
            continue
        row = next(r for r in found if r.doc_id == doc_id)
        half = len(text) // 2
        edited = text[: len(text) - half] + (following[1] or "")[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((row.near_edited, edited), (row.near_next, following[1])):
            a, b = shingle_set(text), shingle_set(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) < 0.2
        marks.setdefault(tuple(words(text)), set()).add(row.fingerprint)
    assert all(len(m) == 1 for m in marks.values())


def test_fingerprints_of_odd_rows(spark):
    rows = odd_rows()
    found = fingerprints.fingerprint_documents(frame(spark, rows).repartition(3)).collect()
    check_fingerprints(found, [r[:2] for r in rows])
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].fingerprint == by_id[3].fingerprint == "" and by_id[7].fingerprint


def test_fingerprints_of_one_and_no_document(spark):
    one = fingerprints.fingerprint_documents(frame(spark, odd_rows()[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_documents(frame(spark, odd_rows()[:1]).limit(0)).count() == 0


def test_fingerprint_query(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    check_fingerprints(fingerprints.op2_fingerprints(spark, SF).collect(), rows)


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.word_tokenizer())


def same_as_library(reference, found, rows):
    expected = []
    for doc_id, text in rows:
        ids = reference.encode(text or "", add_special_tokens=False).ids
        decoded = reference.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), decoded))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in found), key=key) == sorted(expected, key=key)


def test_ids_of_odd_rows(spark, reference):
    extra = ["a" * 3000, "aab" * 200, "ΑΣ ΣΑΣ", "İ x’s we'll I'M", "<|startoftext|>a<|endoftext|>", "</w> <|end", "é ẛ̣", "\U00010d50"]
    rows = odd_rows() + [(100 + i, t, None, None, None) for i, t in enumerate(extra)]
    encoded = bpe.digests(bpe.encode_documents(frame(spark, rows), bpe.word_tokenizer()))
    same_as_library(reference, encoded.collect(), [r[:2] for r in rows])
    assert bpe.encode_documents(frame(spark, rows).limit(0), bpe.word_tokenizer()).count() == 0


def test_id_query(spark, reference):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    same_as_library(reference, bpe.op6_bpe(spark, SF).collect(), rows)


def test_words_share_prefixes(reference):
    import random

    draw = random.Random(5)
    made = ["".join(draw.choice("abeinorst") for _ in range(draw.randint(1, 12))) for _ in range(4000)]
    own = bpe.Tokenizer(open(bpe.word_tokenizer(), encoding="utf-8").read())
    own.encode_words(set(made))
    assert all(list(own.known[w]) == reference.encode(w, add_special_tokens=False).ids for w in made)


def test_words_of_a_text_are_walked_together(reference, monkeypatch):
    """No step of Python code for each word: the lookups of boundaries follow the levels of the trie."""
    import random

    draw = random.Random(6)
    texts = [" ".join("".join(draw.choice("aeinorstéß") for _ in range(draw.randint(1, 14))) + draw.choice(["", ".", "'s", "42"]) for _ in range(3000)) for _ in range(2)]
    texts += ["", "!\0 ! \0\0", "b" * 95 + " " + "b" * 98 + " \u0301a e\u0301<|endoftext|>x <| Σ", "a\x85b\u00a0c"]
    own = bpe.Tokenizer(open(bpe.word_tokenizer(), encoding="utf-8").read(), remembered=1000)
    calls = []
    walk = bpe.Tokenizer._fits
    monkeypatch.setattr(bpe.Tokenizer, "_fits", lambda self, a, b: calls.append(len(a)) or walk(self, a, b))
    ids, offsets = own.encode(pa.array(texts, pa.large_string()))
    expected = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected
    assert sum(calls) > 10_000 and len(calls) < 3000


def test_licenses_are_told_apart_by_wording():
    assert all(licenses._CUE.search(text) for text in licenses.TEXTS.values())
    for name, text in licenses.TEXTS.items():
        found = licenses.scan(f"Prose before. {text}\nProse after it.")
        assert [(f.license, f.edits) for f in found] == [(name, 0)]
    changed = licenses.scan(licenses.TEXTS["MIT"].replace("merge, ", ""))
    assert [(f.license, f.missing, f.added) for f in changed] == [("MIT", "merge", "")]
    both = licenses.scan("Licensed under CC BY-NC 4.0. Released under the MIT License.")
    assert [f.license for f in both] == ["CC-BY-NC-4.0", "MIT"]
    assert not licenses.scan("He had no license to warrant such permission.") and not licenses.scan("")


def test_statement_beside_part_of_a_long_text():
    part = " ".join(licenses.TEXTS["GPL-3.0"].split()[:45])
    assert [f.license for f in licenses.scan(f"Released under the MIT License. {part}")] == ["MIT"]
    half = licenses.TEXTS["BSD-3-Clause"].split()
    found = licenses.scan(f"Released under the MIT License. {' '.join(half[: len(half) // 2])}")
    assert [(f.license, f.edits) for f in found] == [("MIT", 0)]


def test_blocks_are_compressed_with_every_template(monkeypatch):
    """Whether a template can be confirmed or not, it takes part in the ranking, and every long text is compared."""
    used, compared, difference = [], [], licenses.difference

    class Spy:
        def __init__(self, template):
            self.template = template

        def compress(self, data):
            used.append(self.template.words)
            return self.template.compressor.compress(data)

    every = licenses.templates()
    spied = [dataclasses.replace(t, compressor=Spy(t)) for t in every]
    monkeypatch.setattr(licenses, "templates", lambda: spied)
    monkeypatch.setattr(licenses, "difference", lambda words, *rest: compared.append(words) or difference(words, *rest))
    texts = sorted(t.words for t in every if len(t.words) > licenses.STATEMENT_WORDS)
    for block, names in (
        ("He had no license to warrant such permission.", []),
        ("Released under the MIT License.", ["MIT"]),
        (licenses.TEXTS["ISC"].replace("fee ", ""), ["ISC"]),
    ):
        used.clear(), compared.clear()
        assert [f.license for f in licenses._identified(block)] == names
        assert sorted(used) == sorted(t.words for t in every) and sorted(compared) == texts


def test_cues_of_two_words_over_spaces_and_lines():
    for text in ("Released  under CC0 1.0.", "Prose first.\nReleased\nunder CC0 1.0.", "Released under\nCC0 1.0.\nProse after."):
        assert [f.license for f in licenses.scan(text)] == ["CC0-1.0"]
    rows = [(1, "Released\n\tunder CC BY 4.0.", None, None, None)]
    assert pc.match_substring_regex(pa.array([r[1] for r in rows]), licenses.CUE, ignore_case=True).to_pylist() == [True]


def test_license_query_finds_all_statements(spark):
    statements = {
        "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Released under the MIT License": "MIT",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
    }
    rows = common.table(spark, SF, "documents").collect()
    expected = sorted((r.doc_id, r.text.index(s), n) for r in rows for s, n in statements.items() if s in r.text)
    found = licenses.op4_licenses(spark, SF).collect()
    assert expected and sorted((r.doc_id, r.start, r.license) for r in found) == expected
    assert licenses.find_licenses(frame(spark, odd_rows())).count() == 0
    long = [(1, prose(1, 3000) + " Released under the MIT License. " + prose(2, 3000), None, None, None)] * 2
    assert [r.license for r in licenses.find_licenses(frame(spark, long)).collect()] == ["MIT", "MIT"]


def test_long_and_odd_attribute_values():
    """Values of any length keep their ">"; a value that is never closed ends with the first one, in linear time."""
    import time

    long = "x > y <p>no</p> " * 1000
    text = lambda page: html_text.main_text(html_text.parse(page))
    assert text(f"<article><p data-props='{long}'>Hello</p></article>") == "Hello"
    assert text(f'<article><p data-a = "{long}" title=it\'s>Hello</p> it\'s so</article>') == "Hello it's so"
    assert text("<article><p title=\"never closed>Hello</p><p>there</p></article>") == "Hello there"
    assert text("<article><p a=1>3 = 4 \"quoted\"</p></article>") == '3 = 4 "quoted"'
    start = time.perf_counter()
    assert text("<article>" + "<p a='>w</p>" * 1 + "<p b=\"x\">v</p>" * 100_000 + "</article>").count("v") == 100_000
    text("<a b='" * 200_000 + ">")
    assert time.perf_counter() - start < 20


def test_many_statements_in_one_text():
    """All of them are found, in time that grows with the text."""
    import time

    names = [form.format(name) for names in licenses.NAMES.values() for name in names[:1] for form in licenses.FORMS[:2]]
    text = "\n".join(names[i % len(names)] for i in range(2000))
    start = time.perf_counter()
    found = licenses.scan(text)
    assert time.perf_counter() - start < 15 and len(found) == 2000
    own = [licenses.scan(n) for n in names]
    assert [f.license for f in found[: len(names)]] == [x[0].license for x in own] and all(len(x) == 1 for x in own)
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))

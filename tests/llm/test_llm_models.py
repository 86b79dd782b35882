"""Quality classifier, page texts, language model and pipeline."""

import html
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_plain import frame, near_duplicates, odd_rows, prose, words
from pyspark.sql import functions as F
from test_llm_joins import in_order, plain_line_dedup, removed_lines

import corpus_pipeline
from conftest import SF
from corpusreview.llm import common, gru, html_text, lm, mixing, quality


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def test_pool_adjacent_is_the_monotone_fit():
    values, weights = np.array([1.0, 3.0, 2.0, 2.0, 5.0, 0.0]), np.array([1.0, 1.0, 1.0, 2.0, 1.0, 1.0])
    assert quality.pool_adjacent(values, weights).tolist() == pytest.approx([1.0, 2.25, 2.25, 2.25, 2.5, 2.5])


def test_normal_equations_give_the_ridge_fit(spark):
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(400, len(quality.STATISTICS)))
    labels = (rows[:, 0] + rows[:, 1] ** 2 > 1).astype(int)
    stats = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "doc_id bigint, stats array<double>").repartition(5)
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id bigint, quality int")
    model = quality.fit(stats, marks)
    learned = [i for i in range(400) if crc(i) % 5 in (1, 2, 3)]
    z = model.features(rows[learned])
    penalty = np.full(z.shape[1], quality.PENALTY * len(learned))
    penalty[-1] = 1e-9 * len(learned)
    residual = z.T @ (z @ model.weights - labels[learned]) + penalty * model.weights
    assert np.abs(residual).max() < 1e-6
    assert np.all(np.diff(model.levels) >= 0)


def test_quality_of_odd_rows(spark):
    stats = quality.document_statistics(frame(spark, odd_rows()))
    empty = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.score_statistics(stats, quality.fit(stats, empty)).collect()} == {1.0}
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 15)] + [(3, None), (None, 1)], "doc_id bigint, quality int")
    scores = quality.score_statistics(stats, quality.fit(stats, marks)).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 for r in scores)
    none = quality.document_statistics(frame(spark, odd_rows()).limit(0))
    assert quality.score_statistics(none, quality.fit(none, marks)).count() == 0


def test_quality_query_on_held_out_labels(spark):
    folder = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.quality for r in common.table(spark, folder, "labels").collect()}
    rows = quality.op7_quality(spark, folder).collect()
    assert {r.doc_id: r.held_out for r in rows} == {r.doc_id: crc(r.doc_id) % 5 == 0 for r in rows}
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header>
<div class="cookie-notice">We use</div><main><article class="post"><header><h1>Head &amp; line</h1></header><p>One<b> two</b>three<br>four
<p>five &copy; six&nbsp;x<ul><li>a<li>b</ul><div class="ad">BUY</div><form>F<input name=x></form><script>var t="</p>";</script>
<div><p>in div</div> tail</article><section id="comments"><article>bad</article></section></main><aside>side</aside><footer>foot</footer>"""


def test_page_text():
    text = lambda page: html_text.main_text(html_text.parse(page))
    assert text(PAGE) == "Head & line One twothree four five © six x a b in div tail"
    odd = {
        "": "", "a < b": "a < b", "<p>x": "x", "</p></div>": "", "<script>a": "", "<!-- x": "", "a<!-- x > y": "a", "a<style>b > c": "a", '<a "x>y': "y", "&amp &am &#65;": "& &am A",
        "<article><p>in</article>out": "in", "<b>a</p>b</b>c": "abc", "<div>a</i>b": "ab", "x<img alt='>'>y": "xy", "a <div": "a",
    }
    assert {page: text(page) for page in odd} == odd
    for page in ("<div>" * 20000 + "x", "<b>x " * 20000, "<a '" * 20000, "<b>" * 20000 + "</i>" * 20000, "x " * 500000):
        text(page)


def test_recurring_subtrees_go(spark):
    body = "<div>Common bar</div><p>Common line</p><div><p>Own {0} text</p></div><div>Rare {1}</div>"
    rows = [(i, f"http://a.example/{i}", body.format(prose(i, 8), i // 3), "x") for i in range(40)]
    rows += [(100 + i, "https://B.example:80/p", "<article><p>Same line</p><div class='box'>More</div></article>", "x") for i in range(20)]
    rows += [(200, None, None, "x"), (201, "odd", "", "x"), (None, "http://a.example", "<p>Only here</p>", "x"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, template string").repartition(3)
    found = {(r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()}
    texts = {(i, f"Own {prose(i, 8)} text Rare {i // 3}") for i in range(40)} | {(100 + i, "Same line") for i in range(20)}
    texts |= {(200, ""), (201, ""), (None, "Only here")}
    assert found == {(i, t, len(t)) for i, t in texts}
    assert html_text.extract_pages(pages).count() == len(rows) and html_text.extract_pages(pages.limit(0)).count() == 0


def test_page_query(spark):
    pages = common.table(spark, SF, "pages").collect()
    inner = {p.page_id: re.search(r"<article>(.*)</article>", p.html, re.S)[1] for p in pages}
    plain = {i: re.sub(r"</?[^>]+>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", s) for i, s in inner.items()}
    assert {r.page_id: r.text for r in html_text.op3_html_text(spark, SF).collect()} == {i: " ".join(html.unescape(s).split()) for i, s in plain.items()}


def test_gradient_of_the_recurrent_model():
    draw = np.random.default_rng(0)
    model = gru.Gru(np.array([0, 2, 5]), 9, 4)
    model.seed(np.ones(9))
    model.flat += draw.normal(0, 0.3, model.flat.shape).astype(np.float32)
    inputs, targets = draw.integers(0, 9, (5, 3)), draw.integers(0, 9, (5, 3))
    state = draw.normal(0, 0.5, (3, 4)).astype(np.float32)
    gradient = model.gradient(inputs, targets, state)[0]
    for i in draw.choice(len(model.flat), 60, replace=False):
        model.flat[i] += 0.01
        up = model.gradient(inputs, targets, state)[2]
        model.flat[i] -= 0.02
        down = model.gradient(inputs, targets, state)[2]
        model.flat[i] += 0.01
        assert abs((up - down) / 0.02 / inputs.size + gradient[i]) < 1e-4


def test_training_works_out_no_probabilities_and_steps_as_adam_does(monkeypatch):
    """The gradient is the same without them, and the optimiser's pieces are whole whatever their size."""
    draw = np.random.default_rng(4)
    frequencies = draw.integers(1, 90, 70).astype(float)
    tokens = draw.integers(0, 70, 16 * gru.WINDOW)
    model = gru.Gru(gru.classes_of(frequencies), 70)
    model.seed(frequencies)
    first = model.flat.copy()
    targets = tokens[: gru.WINDOW, None]
    inputs = np.concatenate([[[gru.END]], targets[:-1]])
    state = np.zeros((1, gru.HIDDEN), np.float32)
    told, plain = model.gradient(inputs, targets, state), model.gradient(inputs, targets, state, told=False)
    assert (told[0] == plain[0]).all() and plain[2] is None and told[2] < 0
    monkeypatch.setattr(gru, "PIECE", 100)
    monkeypatch.setattr(gru, "WINDOW", len(tokens))
    monkeypatch.setattr(gru.Gru, "gradient", lambda *_, told: (plain[0].copy(), state, None if not told else 1 / 0))
    model.train(tokens)
    grad = plain[0].astype(float)
    grad /= max(1.0, np.sqrt((grad**2).sum()))
    # after one step the moments are a tenth and a hundredth of the gradient and its square
    step = gru.RATE * np.sqrt(0.01) / 0.1 * 0.1 * grad / (np.sqrt(0.01 * grad**2) + 1e-6)
    assert np.allclose(first - model.flat, step, atol=1e-5)


def test_packed_numbers_come_back_as_they_were():
    draw = np.random.default_rng(3)
    arrays = [draw.integers(0, 1 << bits, size).astype(np.uint64) for bits in (1, 8, 23, 62) for size in (0, 1, 5, 700)]
    assert [x.tolist() for x in common.unpack(common.pack(*arrays))] == [x.tolist() for x in arrays]


def test_scores_do_not_depend_on_company():
    model = gru.Gru(gru.classes_of(np.arange(50.0)), 50)
    model.seed(np.arange(50.0))
    model.flat += np.random.default_rng(1).normal(0, 0.2, model.flat.shape).astype(np.float32)
    tokens = np.random.default_rng(2).integers(1, 50, 600)
    ends = [0, 1, 99, 100, 399, 598, 599]
    tokens[ends] = gru.END
    counts = np.diff([-1, *ends])
    together = model.score(tokens, counts)
    alone = [model.score(part, np.array([len(part)]))[0] for part in np.split(tokens, np.cumsum(counts)[:-1])]
    assert together == pytest.approx(alone, rel=1e-5)
    first = model.losses(model.step(np.array([gru.END]), np.zeros((1, gru.HIDDEN), np.float32))[0].repeat(50, 0), np.arange(50))[0]
    assert np.exp(first).sum() == pytest.approx(1.0, rel=1e-5)


def check_base(found, rows):
    tokens = [(i, [*words(t), None]) for i, t in rows]
    counts = Counter(w for i, t in tokens if crc(i) % 5 != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    expected = [(i, crc(i) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)) for i, t in tokens]
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for got, want in zip(sorted((tuple(r) for r in found), key=order), sorted(expected, key=order), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5]) and math.isfinite(got[6]) and got[6] < 0 or not total


def test_lm_scores_of_odd_rows(spark):
    rows = odd_rows()
    check_base(lm.score_documents(frame(spark, rows).repartition(3)).collect(), [r[:2] for r in rows])
    assert lm.score_documents(frame(spark, rows).limit(0)).count() == 0
    held = [(i, "a b", None, None, None) for i in range(60) if crc(i) % 5 == 1]
    assert {r.base_score for r in lm.score_documents(frame(spark, held)).collect()} == {0.0}


def test_lm_query(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = lm.op1_lm_scores(spark, SF).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    check_base(found, rows)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_training_document_trains_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEED_DOCUMENTS", 0)  # else the few documents of a test all reach the first weights
    rows = [(i, " ".join(["the", f"own{i}", "word"] * 40), None, None, None) for i in range(40)]
    docs = frame(spark, rows).repartition(2).withColumn("text_key", F.xxhash64("text")).withColumn("held_out", lm.held_out(F.col("doc_id")))
    docs = common.write_stage(docs.select("doc_id", "text", "text_key", "held_out"), "test-docs")
    corpus = lm.corpus_counts(docs)[1]
    moved = np.abs(lm.train(docs, corpus).part["x"] - lm.new_model(corpus).part["x"]).sum(axis=1)
    for i in range(40):
        tokens, _, keys = lm.keyed_words(pa.array([f"own{i}"], pa.large_string()))
        if crc(i) % 5 != 1:
            assert moved[corpus.outputs(keys)[tokens[0]]] > 0


def documents(spark, df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage on what the stage before it kept."""
    folder = str(tmp_path)
    extra = [r for r in odd_rows()]
    tables = common.table(spark, SF, "documents")
    frame(spark, extra, clashes=False).unionByName(tables).write.parquet(f"{folder}/documents.parquet")
    os.symlink(f"{SF}/labels.parquet", f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "mixing", "encoding"]
    stage = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, folder, "documents")
    before = documents(spark, docs)

    docs = common.write_stage(stage["quality"](spark, docs, folder), "t")
    kept = documents(spark, docs)
    assert not Counter(kept) - Counter(before)
    labels = {r.doc_id: r.quality for r in common.table(spark, folder, "labels").collect() if r.doc_id is not None}
    ids = {r[0] for r in kept}
    known = [(labels[r[0]], r[0] in ids) for r in documents(spark, tables) if r[0] in labels]
    assert sum(bool(y) == k for y, k in known) >= 0.95 * len(known)

    docs = common.write_stage(stage["line_dedup"](spark, docs, folder), "t")
    after = {r[0]: r for r in documents(spark, docs)}
    unique = {r[:2]: r for r in kept if r[0] is not None and Counter(x[0] for x in kept)[r[0]] == 1}
    check = {r: after[r[0]][1] if r[0] in after else "" for r in unique if r[1]}
    gone = plain_line_dedup([r[:2] for r in kept])[1]
    removed = {(r, k) for r in check for k in removed_lines(r[1], check[r])}
    assert removed <= set(gone) and len(removed) >= 0.9 * len([x for x in gone if x[0] in check])
    for r in check:  # other columns follow the text; what has no words left is gone, everything else stays
        assert (r[0] in after) == (check[r] == r[1] or bool(words(check[r])))
        if r[0] in after:
            assert after[r[0]][2:4] == unique[r][2:4] and after[r[0]][4] == (unique[r][4] if check[r] == r[1] else len(check[r]))
    assert {r[0] for r in kept if not words(r[1])} <= set(after)

    before = documents(spark, docs)
    docs = common.write_stage(stage["near_duplicates"](spark, docs, folder), "t")
    plain = near_duplicates([r[:2] for r in before])
    loners = [r for r in before if not words(r[1])]
    after = documents(spark, docs)
    assert not Counter(after) - Counter(before)
    assert len({g for _, n, g in plain if n}) + len(set(r[:2] for r in loners)) <= len(after) + 2
    again = near_duplicates([r[:2] for r in after if words(r[1])])
    assert all(i == g for i, _, g in again if i is not None)

    docs = common.write_stage(stage["mixing"](spark, docs, folder), "t")
    connection = duckdb.connect()
    connection.register("documents", pa.Table.from_pylist([dict(zip(corpus_pipeline.COLUMNS, r)) for r in after], frame(spark, [], clashes=False).toArrow().schema))
    names = [d[0] for d in connection.execute(mixing.OP8_SQL).description]
    mix = [dict(zip(names, r)) for r in connection.execute(mixing.OP8_SQL).fetchall()]
    times = Counter({(m["doc_id"], m["size"]): (m["position"] is not None) + (m["position_again"] is not None) for m in mix})
    taken = Counter((r[0], len(words(r[1]))) for r in documents(spark, docs))
    unique = [k for k, n in Counter((r[0], len(words(r[1]))) for r in after).items() if n == 1]
    assert all(taken[k] == times[k] for k in unique)

    last = stage["encoding"](spark, docs, folder)
    assert last.count() == docs.count() and last.filter("n_tokens <> size(ids)").count() == 0


def test_pipeline_query_runs_all_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_statistics_are_made_of_small_pieces(spark):
    """Pieces of 4 MB were worked on at a time, whose words took 130 MB."""
    texts = [(i, prose(i, 40)) for i in range(60)]
    sizes = [sum(len(t) for t in p.column("text").to_pylist()) for p in common.pieces(pa.table({"text": [t for _, t in texts] * 200}).combine_chunks().to_batches()[0], "text", quality.PIECE_BYTES)]
    assert max(sizes) <= quality.PIECE_BYTES <= common.CHUNK_BYTES // 4
    docs = common.write_stage(frame(spark, [(i, t, None, None, None) for i, t in texts], clashes=False), "t")
    found = {r.doc_id: r.stats for r in quality.document_statistics(docs).collect()}
    plain = quality.statistics(pa.array([t for _, t in texts]).cast(pa.large_string()))
    assert all(np.allclose(found[i], plain[i]) for i in range(60))


def test_pipeline_encodes_from_small_batches(spark, monkeypatch):
    """The last stage was sent up to 10,000 whole texts at a time, as nothing wrote its rows."""
    write, written = common.write_stage, []

    def kept(df, purpose):
        written.append(purpose)
        return write(df, purpose)

    docs = write(frame(spark, odd_rows(), clashes=False), "t")
    monkeypatch.setattr(common, "write_stage", kept)
    found = dict(corpus_pipeline.STAGES)["encoding"](spark, docs, SF)
    assert found.count() == docs.count() and written == ["pipeline-digests"]


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    """Columns with the names the stages use inside, null and repeated rows; and no rows at all."""
    docs = common.write_stage(frame(spark, odd_rows()).repartition(3), "t")
    nothing = common.write_stage(docs.limit(0), "t")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "encoding":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            allowed = {r[:2] for r in odd_rows()}
            assert name == "line_dedup" or {(r.doc_id, r.text) for r in rows} <= allowed
        else:
            assert len(rows) == len(odd_rows()) and all(r.n_tokens == len(r.ids) for r in rows)
        assert stage(spark, nothing, SF).count() == 0

"""Spelling groups, quality rules and the Merkle manifest against plain versions and SQL."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_plain import CLASHES, FOLD, frame, odd_rows, words

from checks.compare import compare, connect
from conftest import SF
from corpusreview.llm import common, manifest, rules, spelling

MORE_CLASHES = [c for c in "grp h rank total at run node word size of n near form root stats host text_key keys leaf given".split() if c not in CLASHES]


def wide(spark, rows):
    """Rows as documents with columns of all names that the operators use inside."""
    df = frame(spark, rows)
    return df.select("*", *[df["lang"].alias(c) for c in MORE_CLASHES])


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def plain_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_spelling(rows):
    vocabulary = plain_vocabulary(rows)
    letters = {c for w in vocabulary for c in w}
    near = {}
    for w in vocabulary:
        cuts = {w[:i] + w[i + 1 :] for i in range(len(w))}
        swaps = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        grown = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = [x for x in (cuts | swaps | grown) - {w} if x in vocabulary]
    forms = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        forms[w] = best if best and vocabulary[best] >= 2 * vocabulary[w] else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), vocabulary[forms[w]] if forms[w] else None))
    return out


def misspelt_rows():
    """Words of few letters, so that all kinds of errors, ties, chains and words of one group occur; long words too."""
    draw = np.random.default_rng(11)
    pool = ["".join(draw.choice(list("abé"), draw.integers(4, 8))) for _ in range(300)] + ["Ünder" + "x" * k for k in (60, 90, 91)]
    share = 1 / np.arange(1, len(pool) + 1)
    texts = [" ".join(draw.choice(pool, 60, p=share / share.sum())) for _ in range(120)] + [" ".join([pool[-1], pool[-2], pool[-3]] * 4), "x" * 5000 + "y " + "x" * 5000]
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3000 + i, "x" * 5000 + "y;" + "x" * 5000, "en", "s", 0) for i in range(2)]


@pytest.mark.parametrize("part", [1 << 13, 7])
def test_spelling_groups_of_odd_rows(spark, monkeypatch, part):
    rows = odd_rows() + misspelt_rows() + [(7000, "don't Ünderx", "en", "s", 0)] * 3
    monkeypatch.setattr(spelling, "PART_WORDS", part)  # 7: groups are cut into cells
    monkeypatch.setattr(spelling, "STEP_PAIRS", 1 << 13)
    found = spelling.spelling_groups(wide(spark, rows).repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    expected = plain_spelling([r[:2] for r in rows])
    assert by_id(found) == by_id(expected)
    assert len({len(r[0]) for r in expected}) > 5 and any(r[1] != r[2] for r in expected if r[1])
    assert spelling.spelling_groups(wide(spark, rows).limit(0)).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None, None, None, None), (2, "", None, None, 0)])).count() == 0


def test_near_words_by_brute_force():
    draw = np.random.default_rng(5)
    drawn = sorted({"".join(draw.choice(list("ab"), draw.integers(5, 7))) for _ in range(150)})
    members, group = drawn * 2, np.repeat([0, 1], len(drawn))
    asking = [w for w in drawn if len(w) == 5]
    u, v = spelling.near_words(5, members, group, asking, np.full(len(asking), 1))
    one_off = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    expected = {(i, len(drawn) + j) for i, a in enumerate(asking) for j, b in enumerate(drawn) if one_off(a, b)}
    assert set(zip(u.tolist(), v.tolist())) == expected and len(u) == len(expected)


def run_sql(statement, table):
    connection = duckdb.connect()
    connection.register("documents", table)
    result = connection.execute(statement)
    return [d[0] for d in result.description], result.fetchall()


def plain_rules(rows):
    per_host, texts = defaultdict(set), defaultdict(set)
    normal = lambda line: " ".join(words(line))
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if words(line):
                per_host[host, normal(line)].add(text)
    out = []
    for i, text, _, host, _ in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
        times = Counter(windows)
        again = len({k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)})
        filled = [x for x in text.split("\n") if words(x)]
        failed = len(found) < 10 or 100 * again > 20 * len(found)
        gone = [x for x in filled if len(per_host[host, normal(x)]) > max(rules.LINE_DOCS, rules.LINE_SHARE * len(texts[host]))]
        removed = sum(len(words(x)) for x in gone)
        out.append(
            (i, len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(filled) - len(set(filled)), again, failed, len(gone), removed)
            + (not failed and 100 * removed <= 70 * len(found),)
        )
    return out


def template_rows():
    """A hot host with a menu on most documents, one document of hardly more than the menu, and many copies of one text."""
    menu = "Home  News\tABOUT us and our partners"
    rows = [(5000 + i, f"{menu}\n" + " ".join(f"own{i}x{k}" for k in range(12)), "en", "hot", 0) for i in range(30)]
    rows += [(5100, f"{menu.lower()}\n{menu}\nread more now please", "en", "hot", 0), (5101, f"{menu}\n{menu}\nread more now", "en", "cold", 0)]
    rows += [(5200 + i, " ".join(f"copied{k}" for k in range(30)), "en", "hot", 0) for i in range(40)]
    rows += [(5300, "a b c d e " * 3 + " ".join(f"u{k}" for k in range(30)), "en", None, 0), (5301, "a " * 20, "en", None, 0), (5302, "|#<> $%&* x", "en", None, 0)]
    rows += [(5303, "a b c d e f g a b c d e f g h i j k " + " ".join(f"u{k}" for k in range(60)), "en", "s", 0)]
    return rows


def test_quality_rules_of_odd_rows(spark):
    rows = odd_rows() + template_rows()
    found = rules.quality_rules(wide(spark, rows).repartition(3))
    expected = plain_rules(rows)
    assert by_id(found.collect()) == by_id(expected)
    names, values = run_sql(rules.OP12_SQL, frame(spark, rows, clashes=False).toArrow())
    assert by_id(found.select(*names).collect()) == by_id(values)
    verdicts = {r[0]: r[-1] for r in expected}
    assert not verdicts[5100] and verdicts[5000] and verdicts[5200] and not verdicts[5301]
    assert rules.quality_rules(wide(spark, rows).limit(0)).count() == 0


def test_quality_rules_run_without_python(spark):
    plan = rules.op12_quality_rules(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: sha(*map(field, (i, source, lang, n, text)))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
        return out

    def path(tree, i):
        return [(i >> k & 1, level[(i >> k) ^ 1] if (i >> k) ^ 1 < len(level) else "") for k, level in enumerate(tree[:-1])]

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], i) + path(top, k)
            h = leaf(*r[:4], r[4] + 1) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for side, other in steps:
                h = sha(other, h) if side else sha(h, other)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha(*[x for _, x in steps]), h, h == top[-1][0]))
    return out


def leaf_rows():
    rows = [(i, f"text {i}\n", lang, "é" if i % 3 else None, i) for lang, n in (("a", 37), ("Z", 1), ("é", 2), ("", 8), (None, 5), ("b", 16)) for i in range(n)]
    rows += [(None, "no id", "a", "s", 1), (None, None, "a", None, None), (3, "text 3\n", "a", None, 3), (2**63 - 1, "", "b", "s", 2**63 - 1), (-7, "t", "b", "s", -1)]
    return rows + [(3000 + i, "x", "b", "s", 2**63 - 1) for i in range(12)]


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest_of_odd_rows(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BLOCK_BITS", bits)  # 2: blocks of four nodes, several tiers
    rows = leaf_rows() + odd_rows()
    found = manifest.manifest(wide(spark, rows).repartition(3)).collect()
    expected = plain_manifest(rows)
    assert by_id(found) == by_id(expected)
    assert {r[-1] for r in expected} == {True, False}
    assert manifest.manifest(wide(spark, rows).limit(0)).count() == 0


def test_manifest_of_one_row(spark):
    row = (1, "t", None, "s", 5)
    assert by_id(manifest.manifest(frame(spark, [row])).collect()) == plain_manifest([row])


def test_a_block_is_one_sort_and_needs_no_second_shuffle(spark):
    rows = spark.range(100).selectExpr("int(id < 0) as grp", "100 + id % 1 as total", "id as rank", "struct(unhex(sha2(string(id), 256)) as h, id) as node")
    plan = manifest.rolled_up(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and "Join" not in plan


@pytest.mark.parametrize(
    "query, sql",
    [(spelling.op11_spelling_groups, spelling.OP11_SQL), (rules.op12_quality_rules, rules.OP12_SQL), (manifest.op13_merkle_manifest, manifest.OP13_SQL)],
)
def test_new_queries(spark, query, sql):
    problem, rows, _ = compare(spark, connect(SF), SF, query, sql)
    assert problem is None and rows > 0


def test_sql_of_odd_rows(spark):
    rows = leaf_rows() + odd_rows() + misspelt_rows()
    table = frame(spark, rows, clashes=False).toArrow()
    assert by_id(run_sql(manifest.OP13_SQL, table)[1]) == by_id(plain_manifest(rows))
    assert by_id(run_sql(spelling.OP11_SQL, table)[1]) == by_id(plain_spelling([r[:2] for r in rows]))


def test_crc_is_put_together():
    ids = pa.array([None, 7, -3, 12345], pa.int64())
    texts = pa.array(["Abcdefg abcdefg", "ététait ×÷×÷×", "", "z" * 200 + " zzzzz"], pa.large_string())
    found = dict(zip(*spelling.run_counts(ids, texts)))
    counts = Counter()
    for i, t in zip(ids.to_pylist(), texts.to_pylist()):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert found == {w: n for w, n in counts.items() if len(w) >= 5}
    assert common.SHINGLE_WORDS == 5

"""Replies, issues, scores and reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusreview import constants as K
from corpusreview.operators import issues as I
from corpusreview.operators import prompts
from corpusreview.operators import replies as RP
from corpusreview.operators import scoring as SC
from corpusreview.operators.ranking import position
from tests.conftest import values

ISSUE = {"severity": "info", "category": "c", "file_path": "p", "description": "d", "suggestion": "s"}
REVIEW = {"issues": [ISSUE], "score": 80, "summary": "fine"}


def review(**changes):
    return json.dumps({k: v for k, v in {**REVIEW, **changes}.items() if v != "DROP"})


def with_issue(**changes):
    return review(issues=[ISSUE, {k: v for k, v in {**ISSUE, **changes}.items() if v != "DROP"}])


REPLIES = [
    (review(), None),
    (review(issues="DROP"), None),
    (review(issues=[]), None),
    (review(issues=None), "issues_not_a_list"),
    (review(issues={}), "issues_not_a_list"),
    (review(issues=[1]), "invalid_issue"),
    (review(score="87.5"), None),
    (review(score=" 1e1 "), None),
    (review(score=True), None),
    (review(score="12d"), "score_not_a_number"),
    (review(score=None), "score_not_a_number"),
    (review(score="DROP"), "score_not_a_number"),
    (review(score=100.0), None),
    (review(score=100.01), "score_out_of_range"),
    (review(score=-1), "score_out_of_range"),
    (review(summary="DROP"), "summary_not_a_text"),
    (review(summary=5), "summary_not_a_text"),
    (review(extra={"a": [1]}), None),
    (with_issue(severity="suggestion"), "invalid_issue"),
    (with_issue(severity="DROP"), "invalid_issue"),
    (with_issue(category=None), "invalid_issue"),
    (with_issue(category=3), "invalid_issue"),
    (with_issue(line_number=None), None),
    (with_issue(line_number=12), None),
    (with_issue(line_number="12"), None),
    (with_issue(line_number=12.0), None),
    (with_issue(line_number=12.5), "invalid_issue"),
    (with_issue(line_number="12.5"), "invalid_issue"),
    (with_issue(line_number="x"), "invalid_issue"),
    (with_issue(line_number=[1]), "invalid_issue"),
    (with_issue(code_snippet=None), None),
    (with_issue(code_snippet="x"), None),
    (with_issue(code_snippet=1), "invalid_issue"),
    ("[]", "not_an_object"),
    ('"text"', "not_an_object"),
    ("null", "not_an_object"),
    ("", "invalid_json"),
    ("{", "invalid_json"),
    (review() + " x", "invalid_json"),
    (review() + "] x", "invalid_json"),
    (review() + "," + review(), "invalid_json"),
    ("  " + review() + "\n", None),
    ("```json\n" + review() + "\n```", "invalid_json"),
    (None, "no_reply"),
]


def test_reply_validation(spark):
    df = spark.createDataFrame([(i, "f.py", raw) for i, (raw, _) in enumerate(REPLIES)], "seq int, file_path string, raw string")
    bad = dict(values(RP.invalid_reviews(df), "seq", "reason"))
    assert [bad.get(i) for i in range(len(REPLIES))] == [want for _, want in REPLIES]
    out = {r["seq"]: r for r in RP.parse_reviews(df).collect()}
    assert len(out) == len(REPLIES)
    for i, (_, reason) in enumerate(REPLIES):
        assert out[i]["is_fallback"] == (reason is not None) and out[i]["file_path"] == "f.py"
        if reason:
            assert (out[i]["score"], out[i]["issues"], out[i]["summary"]) == (50.0, [], f"Analysis failed: {reason}")
    assert out[6]["score"] == 87.5 and out[7]["score"] == 10.0 and out[8]["score"] == 1.0
    assert [out[i]["issues"][1]["line_number"] for i in (22, 23, 24, 25)] == [None, 12, 12, 12]


def test_later_duplicate_key_wins(spark):
    df = spark.createDataFrame([('{"score": 1, "score": 2, "summary": "s"}',)], "raw string")
    assert RP.parse_reviews(df).first()["score"] == 2.0


def test_extract_issues(spark):
    texts = {
        "plain": 'Found: [{"description": "x"}] end',
        "none": "no list here",
        "reversed": "] before [",
        "two": '[{"description": "x"}] and [{"description": "y"}]',
        "empty": "[]",
        "null": '[{"severity": null}]',
        "bad": '[{"description": "x"}, {"severity": "blocker"}]',
        "scalar": "[1]",
        "lines": 'a\n[{"severity": "critical",\n "line_number": "7"}]\nb',
    }
    df = spark.createDataFrame([(k, "f.py", v) for k, v in texts.items()], "id string, file_path string, raw string")
    out = sorted(tuple(r) for r in RP.extract_issues(df).collect())
    assert out == [
        ("lines", 1, "critical", "general", "f.py", 7, "", "", None),
        ("plain", 1, "info", "general", "f.py", None, "x", "", None),
    ]


def test_parse_docs(spark):
    rows = [('{"documentation": "# A"}', "# A"), ('{"other": 1}', '{"other": 1}'), ("oops", None), ("[1]", None), (None, None)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "id int, raw string")
    out = values(RP.parse_docs(df).orderBy("id"), "doc")
    assert out[:2] == ["# A", '{"other": 1}'] and all(d.startswith("_Documentation generation failed") for d in out[2:])


SCHEMA = (
    "run_id long, seq long, file_path string, language string, score double, summary string, issues array<struct<"
    "severity:string,category:string,file_path:string,line_number:bigint,description:string,suggestion:string>>"
)


def issue(severity="info", category="c", path="", text="d"):
    return (severity, category, path, None, text, "")


@pytest.fixture
def reviews(spark):
    def build(rows):
        full = [(run, seq, path, "python", float(score), "s", found) for run, seq, path, score, found in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


def test_overall_score(spark, reviews):
    df = reviews([
        (1, 1, "a", 40, [issue("critical"), issue()]), (1, 2, "b", 90, [issue()]), (1, 3, "c", 100, []),
        (2, 1, "a", 50, []), (2, 2, "b", 50, []), (3, 1, "a", 70, [issue("suggestion")]),
    ])
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "run_id long")
    want = {1: round((40 * 1.5 + 90 + 100 * 0.8) / 3.3, 1), 2: 50.0, 3: 70.0, 4: 100.0}
    assert dict(values(SC.overall_score(df, runs), "run_id", "overall_score")) == want
    counts = {r["run_id"]: (r["critical_count"], r["warning_count"], r["info_count"]) for r in SC.severity_counts(df).collect()}
    assert counts == {1: (1, 0, 2), 2: (0, 0, 0), 3: (0, 0, 1)}


def test_run_report(spark, reviews):
    df = reviews([(1, 1, "a", 91, [issue("warning")])])
    discovered = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "run_id long, path string")
    out = {r["run_id"]: r for r in SC.run_report(df, discovered).collect()}
    assert (out[1]["total_files"], out[1]["files_analyzed"], out[1]["quality_label"]) == (2, 1, "excellent")
    assert out[1]["summary"] == (
        "Repository analysis complete. Reviewed 1 file(s) with an overall quality score of 91.0/100 (excellent). "
        "Found 0 critical issue(s), 1 warning(s), and 0 informational note(s)."
    )
    assert (out[2]["files_analyzed"], out[2]["overall_score"], out[2]["warning_count"]) == (0, 100.0, 0)


def test_fallback_stats(spark, reviews):
    df = reviews([(1, 1, "a", 50, [issue("critical"), issue("odd")]), (1, 2, "b", 51, []), (2, 1, "a", 10, [])])
    finished = spark.createDataFrame([(2,)], "run_id long")
    out = SC.fallback_stats(df, finished).collect()
    assert [tuple(r)[:6] for r in out] == [(1, 2, 2, 51, 1, 0)]  # 50.5 is rounded up


def test_score_bands(reviews):
    df = reviews([(1, i, "a", s, []) for i, s in enumerate((49, 49.5, 50, 74, 74.5, 75, 89, 89.5, 90, 100, 0))])
    assert values(I.score_distribution(df).orderBy("band_no"), "files") == [2, 2, 2, 2]


def test_worst_files_ties_by_arrival(reviews):
    df = reviews([(1, i, f"f{i}", 50 if i % 2 else 60, []) for i in range(9, 0, -1)])
    assert values(I.worst_files(df).orderBy("rank"), "seq") == [1, 3, 5, 7, 9]
    assert values(I.live_feed(df).orderBy("position"), "seq") == [9, 8, 7, 6, 5, 4, 3, 2, 1]


def test_issue_views(reviews):
    df = reviews([
        (1, 1, "b", 1, [issue("info", "style"), issue("odd", ""), issue("critical", "style", "lib/x", "100%_A")]),
        (1, 2, "", 2, [issue("warning", "bug")]),
        (1, 3, "b", 3, [issue("critical", "style")]),
    ])
    flat = RP.flatten_issues(df)
    assert values(flat.orderBy("seq", "issue_no"), "file_path") == ["b", "b", "lib/x", "", "b"]
    ranked = I.sort_by_severity(flat).orderBy("position")
    assert values(ranked, "seq", "issue_no") == [(1, 3), (3, 1), (2, 1), (1, 1), (1, 2)]
    groups = {r["file_path"]: (r["issue_count"], r["score"], r["issue_text"]) for r in I.issues_by_file(flat, df).collect()}
    assert groups == {"b": (3, 1.0, "3 issues"), "lib/x": (1, None, "1 issue"), K.UNKNOWN_FILE: (1, None, "1 issue")}
    assert values(I.issue_categories(flat), "category") == ["all", "bug", "style"]
    top = I.category_breakdown(flat).orderBy("rank")
    assert values(top, "category", "critical", "info", "total") == [("style", 2, 1, 3), ("other", 0, 0, 1), ("bug", 0, 0, 1)]
    assert values(I.category_share(flat).orderBy("rank"), "share") == [100.0, 1 / 3 * 100, 1 / 3 * 100]
    dims = values(I.with_severity_dim(flat).orderBy("seq", "issue_no"), "severity_label", "severity_rank", "known_category")
    assert dims[1] == ("odd", 99, "other") and dims[2] == ("Critical", 0, "style")
    assert tuple(I.shown_counts(flat, df, severity="critical").first()) == (1, 2, 5, 3)


def test_search_is_plain_text(reviews):
    flat = RP.flatten_issues(reviews([(1, 1, "p", 1, [issue(text="100%_A"), issue(text="100xxA"), issue(text="a 100%_a")])]))
    assert I.search_issues(flat, "0%_a").count() == 2
    assert I.search_issues(flat, " 100%").count() == 1
    assert I.search_issues(flat, "   ").count() == 3
    assert I.filter_issues(flat, severity="info", category="c", term="XX").count() == 1


def test_text_that_closes_the_array_itself_is_no_json(spark):
    body = '{"issues":[],"score":9,"summary":"s"}'
    texts = [body, body + ", 1] trailing", body + ',"x"]', body + ',"~end of reply~"]', body + " x", " " + body + "\n", "[1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert values(df.select("i", RP.strict_json(F.col("t")).isNotNull().alias("ok")).orderBy("i"), "ok") == [True, False, False, False, False, True, False, False]


def test_failing_prompts_are_found_by_halves(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts, temperature):
        calls.add(1)
        if any("bad" in t for t in texts):
            raise ValueError("quota")
        return [t.upper() for t in texts]

    rows = [(i, "bad" if i == 37 else f"p{i}") for i in range(64)]
    df = spark.createDataFrame(rows, "i int, prompt string").coalesce(1)
    out = {r["i"]: (r["raw"], r["error"]) for r in prompts.infer(df, model, batch=64).collect()}
    assert out == {i: (None, "ValueError: quota") if i == 37 else (t.upper(), None) for i, t in rows}
    assert calls.value <= 2 * 6 + 1


def test_sort_by_file_is_locale_aware(reviews):
    paths = ["b", "_z", "B", "a", "A"]
    flat = RP.flatten_issues(reviews([(1, i, p, 1, [issue()]) for i, p in enumerate(paths)]))
    assert values(I.sort_by_file(flat), "file_path") == ["_z", "a", "A", "b", "B"]


def test_positions_across_blocks(spark):
    rng = random.Random(2)
    rows = [(run, lead, seq) for run, n in ((1, 400), (2, 3), (None, 5)) for seq in rng.sample(range(-1000, 1000), n) for lead in [rng.randint(0, 2)]]
    df = spark.createDataFrame(rows, "run_id int, lead int, seq long")
    out = position(df, ["run_id"], ["seq"], lead=("lead",), blocks=(16, 4)).collect()
    assert len(out) == len(rows)
    for run in (1, 2, None):
        mine = sorted((r["lead"], r["seq"], r["position"]) for r in out if r["run_id"] == run)
        assert [p for _, _, p in mine] == list(range(1, len(mine) + 1))


def test_positions_of_sparse_ids(spark):
    """Ids a block apart each: no window holds the whole run."""
    df = spark.range(3000).selectExpr("1 AS run_id", "id * 1000003L * 1048576L AS seq")
    out = position(df, ["run_id"], ["seq"], blocks=(1 << 20, 1 << 22))
    assert out.filter("position <> seq div (1000003L * 1048576L) + 1").count() == 0
    windows = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in line and "windowspecdefinition" in line]
    assert sum("_block" in line for line in windows) >= 2


def test_recent_items(spark):
    rows = [(1, item, t) for t, item in enumerate(["a", "b", "c", "a", "d", "e", "f", "b"])]
    df = spark.createDataFrame(rows, "user_id long, item string, at long")
    assert values(I.recent_items(df).orderBy("rank"), "item") == ["b", "f", "e", "d", "a"]

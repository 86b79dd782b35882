"""Event logs, progress, streams, trees and sinks."""

import json
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corpusreview import constants as K
from corpusreview.plans import catalog
from corpusreview.plans import records as R
from corpusreview.plans import review
from corpusreview.operators import selection as SEL
from corpusreview.operators import smells
from corpusreview.session import fresh_folder, shared_folder
from corpusreview.sources import event_log, sinks, source_tree
from corpusreview.sources.locations import open_location
from corpusreview.streaming import jobs, progress
from tests.conftest import SF, values


def log_twin(text):
    """Events of one log, record by record."""
    out, start = [], 0
    chunks = text.split("\n\n")
    for chunk in chunks[:-1]:
        event, data = "message", None
        for line in chunk.split("\n"):
            line = line.strip()
            if line.startswith("event:"):
                event = line[6:].strip()
            elif line.startswith("data:"):
                body = line[5:].strip()
                if body == "[DONE]":
                    return out
                try:
                    data = body if json.loads(body) is not None else None
                except ValueError:
                    pass
        if data is not None:
            out.append((start, event, data))
        start += len(chunk.encode()) + 2
    return out


def logs():
    rng = random.Random(4)
    pieces = ["event: a", "event: b ", " data: {\"x\": 1}", "data: {bad", "data: [1, 2]", "data:7", ": note", "id: 3", "data: \"é\""]
    out = []
    for i in range(25):
        text = ""
        for _ in range(rng.randint(0, 30)):
            text += "\n".join(rng.choices(pieces, k=rng.randint(0, 4))) + rng.choice(["\n\n", "\n\n", "\n\n\n", "\n\n\n\n", "\n"])
            if rng.random() < 0.02:
                text += "data: [DONE]\n\n"
        out.append(text + rng.choice(["", "event: cut\ndata: 1"]))
    return out


@pytest.mark.parametrize("split_bytes", [7, 100, None])
def test_event_log_files(spark, tmp_path, split_bytes):
    want = {}
    for i, text in enumerate(logs()):
        (tmp_path / f"run{i}.log").write_bytes(text.encode())
        want[f"run{i}.log"] = log_twin(text)
    (tmp_path / "_SUCCESS").write_text("data: 1\n\n")
    got: dict[str, list] = {name: [] for name in want}
    for r in event_log.read_event_log(spark, str(tmp_path), split_bytes).orderBy("file", "start").collect():
        got[r["file"].rsplit("/", 1)[1]].append((r["start"], r["event"], r["data"]))
    assert got == want and sum(map(len, want.values())) > 50


@pytest.mark.parametrize("text", [b"event: a\r\n\r\n" * 30000, b"x" * 400000, b"data: 1\n\n" + b"y\n" * 200000])
def test_logs_without_separators_are_read_about_once(tmp_path, monkeypatch, text):
    """Ranges without a separator stop at their ends, and an open record is not held in memory."""
    (tmp_path / "a.log").write_bytes(text)
    read = [0]

    class Counted:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def seek(self, at):
            self.stream.seek(at)

        def read(self, n):
            data = self.stream.read(n)
            read[0] += len(data)
            return data

    class Files:
        def __init__(self, files):
            self.files = files

        def get_file_info(self, at):
            return self.files.get_file_info(at)

        def open_input_file(self, path):
            return Counted(self.files.open_input_file(path))

    def opened(path):
        files, inner = open_location(path)
        return Files(files), inner

    monkeypatch.setattr(event_log, "open_location", opened)
    reader = event_log.EventLogReader({"path": str(tmp_path / "a.log"), "splitbytes": "20000", "chunkbytes": "4096", "recordbytes": "8192"})
    records = [r for part in reader.partitions() for r in reader.read(part)]
    assert len(records) == text.count(b"\n\n")
    assert read[0] < 2 * len(text)


def test_a_closed_record_above_the_limit_fails(tmp_path):
    (tmp_path / "a.log").write_bytes(b"data: " + b"1" * 50000 + b"\n\ndata: 2\n\n")
    reader = event_log.EventLogReader({"path": str(tmp_path / "a.log"), "chunkbytes": "4096", "recordbytes": "8192"})
    with pytest.raises(ValueError, match="longer than 8192"):
        [r for part in reader.partitions() for r in reader.read(part)]


def test_null_data_is_dropped_only_when_it_is_last(spark):
    rows = [(1, 1, "data: null"), (1, 2, "data: 1\ndata: null"), (1, 3, "data: null\ndata: 2")]
    df = spark.createDataFrame(rows, "run_id int, seq int, record string")
    assert values(event_log.parse_records(df, "run_id", "seq").orderBy("seq"), "seq", "data") == [(3, "2")]


def fold(events):
    """Progress of one run, event by event."""
    total = current = index = reviewed = issues = 0
    file, phase, state = "", K.PHASE_CLONING, "cloning"
    for event, data in events:
        data = json.loads(data)
        if event == "clone_start":
            phase, state = K.PHASE_CLONING, "cloning"
        elif event == "clone_complete":
            total, current, file, state = data.get("files") or 0, 0, "", "analyzing"
            phase = K.PHASE_FOUND % total
        elif event == "file_start":
            index += 1
            current, file = index, data.get("file") or ""
            phase = K.PHASE_FILE % (index, total)
        elif event == "file_skip":
            phase = K.PHASE_SKIP % (data.get("file") or "file", data.get("reason") or "too large")
        elif event == "file_complete" and data.get("review") is not None:
            reviewed += 1
            issues += len(data["review"].get("issues") or [])
        elif event == "analysis_complete":
            state = "complete"
        elif event == "error":
            state = "error"
    percent = int(current / total * 100 + 0.5) if total else 0
    return (total, current, file, reviewed, issues, percent, phase), state


@pytest.fixture(scope="module")
def folded(spark):
    rows = R.review_events(spark, SF).orderBy("run_id", "seq").collect()
    runs: dict[int, list] = {}
    for r in rows:
        runs.setdefault(r["run_id"], []).append((r["event"], r["data"]))
    return {run: fold(events) for run, events in runs.items()}


def test_progress_equals_the_fold(spark, folded):
    out = progress.run_progress(R.review_events(spark, SF)).collect()
    assert {r["run_id"]: tuple(r)[1:] for r in out} == {run: p for run, (p, _) in folded.items()}
    states = dict(values(progress.run_state(R.review_events(spark, SF), closed=False), "run_id", "state"))
    assert states == {run: s for run, (_, s) in folded.items()}


@pytest.fixture
def event_stream(spark, tmp_path):
    """Events in several files, read one file per micro-batch."""
    folder = str(tmp_path / "events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartitionByRange(4, "event_id").write.parquet(folder)
    return R.events_from(jobs.stream_table(spark, folder, events.schema, "*.parquet", files_per_trigger=1))


def test_streaming_progress_equals_batch(spark, tmp_path, folded, event_stream):
    target = str(tmp_path / "out")
    jobs.update_stream(progress.run_progress(event_stream), target, str(tmp_path / "check"))
    out = jobs.latest(spark, target, ["run_id"]).collect()
    assert {r["run_id"]: tuple(r)[1:] for r in out} == {run: p for run, (p, _) in folded.items()}
    assert spark.read.option("basePath", target).parquet(target).select("batch_id").distinct().count() == 4


def test_streaming_state_and_severity_equal_batch(spark, tmp_path, event_stream):
    events = R.review_events(spark, SF)
    for name, op, keys in (("state", progress.run_state, ["run_id"]), ("sev", progress.stream_severity, ["run_id", "severity"])):
        target = str(tmp_path / name)
        jobs.update_stream(op(event_stream), target, str(tmp_path / f"check-{name}"))
        got = {tuple(r) for r in jobs.latest(spark, target, keys).collect()}
        assert got == {tuple(r) for r in op(events).collect()} and got


def test_stream_keeps_running_and_compacts(spark, tmp_path):
    folder, target, check, small = (str(tmp_path / n) for n in ("in", "out", "check", "small"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.filter("event_id % 2 = 0").write.parquet(folder)
    stream = R.events_from(jobs.stream_table(spark, folder, events.schema, "*.parquet"))
    query = jobs.update_stream(progress.stream_severity(stream), target, check, wait=False, every="1 second")
    try:
        query.processAllAvailable()
        events.filter("event_id % 2 = 1").write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    jobs.compact(spark, target, small, ["run_id", "severity"])
    want = sorted(map(tuple, progress.stream_severity(R.review_events(spark, SF)).collect()))
    for table in (target, small):
        assert sorted(map(tuple, jobs.latest(spark, table, ["run_id", "severity"]).collect())) == want


def test_stream_resumes_without_repeating(spark, tmp_path):
    folder, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.filter("doc_id % 2 = 0").write.parquet(folder)

    def run():
        stream = jobs.stream_table(spark, folder, documents.schema, "*.parquet")
        jobs.stream_smells(R.doc_rows(stream), target, check, lambda d: SEL.analysed(d))

    run()
    documents.filter("doc_id % 2 = 1").write.mode("append").parquet(folder)
    run()
    run()
    want = smells.all_smells(SEL.analysed(R.doc_rows(documents)))
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want.collect()))


def test_source_tree(spark, tmp_path):
    texts = {
        "pkg/__init__.py": b"a\r\nb", "_u.py": b"x", "a.PY": b"\xff", ".eslintrc.js": b"x", "node_modules/m.js": b"x",
        "deep/er/st/z.ts": b"t", "big.py": b"x" * 51201, "edge.py": b"x" * 51200, "note.md": b"x", ".git/h.py": b"x",
    }
    for path, raw in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    for root in (str(tmp_path), tmp_path.as_uri()):
        out = {r["path"]: r for r in source_tree.read_source_tree(spark, {"one": root}).collect()}
        assert sorted(out) == ["_u.py", "a.PY", "big.py", "deep/er/st/z.ts", "edge.py", "pkg/__init__.py"]
        assert out["pkg/__init__.py"]["content"] == "a\nb" and out["a.PY"]["content"] == "�"
        assert (out["big.py"]["content"], out["big.py"]["skip_reason"]) == (None, K.SKIP_REASON)
        assert out["edge.py"]["skip_reason"] is None and out["deep/er/st/z.ts"]["language"] == "typescript"


def test_deep_and_uneven_trees_are_dealt_anew(spark, tmp_path):
    """A chain of folders and one wide folder: the same files whatever the budget, in more rounds the smaller it is."""
    at = tmp_path / "chain"
    for depth in range(30):
        at = at / f"d{depth}"
        at.mkdir(parents=True)
        for i in range(3):
            (at / f"f{i}.py").write_text("x")
    for i in range(40):
        (tmp_path / "wide" / f"w{i}").mkdir(parents=True)
        (tmp_path / "wide" / f"w{i}" / "a.py").write_text("x")
    roots = spark.createDataFrame([("r", str(tmp_path))], "repo string, root string")
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.py"))
    for budget, rounds in ((10**6, 1), (20, 8), (1, 32)):
        listed = source_tree.list_source_tree(roots, budget)
        assert sorted(values(listed, "path")) == want and len(want) == 130
        folders = {f.rsplit("/", 2)[1] for f in listed.inputFiles()}
        assert len(folders) >= rounds and (budget > 1000) == (len(folders) == 1)
    # many folders left over are many tasks, on any number of cores
    wide = spark.createDataFrame([("r", str(tmp_path / "wide"))], "repo string, root string")
    files = source_tree.list_source_tree(wide, 1).inputFiles()
    assert sum("part-" in f for f in files) >= 40 // source_tree.TASK_FOLDERS


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(PythonException):
        source_tree.read_source_tree(spark, {"one": str(tmp_path / "nowhere")}).collect()


def test_only_missing_files_are_skipped(spark, tmp_path, monkeypatch):
    """A vanished folder or file becomes a row with a reason; a store that fails to answer fails the task."""
    (tmp_path / "a.py").write_text("x")
    listing = "repo string, root string, path string, size bigint, is_dir boolean, gone boolean"
    gone = spark.createDataFrame([("r", str(tmp_path), "lost", 0, True, False)], listing)
    assert gone.mapInPandas(source_tree._lister(100), listing).collect()[0].gone
    columns = "repo string, root string, path string, size bigint, language string, skip_reason string"
    files = spark.createDataFrame([("r", str(tmp_path), p, 1, "python", None) for p in ("a.py", "b.py")], columns)
    assert {r.path: r.skip_reason for r in source_tree.read_contents(files).collect()} == {"a.py": None, "b.py": K.SKIP_REASON}
    down = spark.createDataFrame([("r", "file:///proc/self/mem", "", 1, "python", None)], columns)
    slow = down.withColumn("root", F.lit("/proc/self")).withColumn("path", F.lit("mem"))
    with pytest.raises(PythonException):
        source_tree.read_contents(slow).collect()


def test_events_skip_or_complete(spark):
    rows = catalog.QUERIES["event_rows"](spark, SF).collect()
    kinds = {}
    for r in rows:
        if r.stage == 3:
            kinds.setdefault((r.run_id, r.seq), set()).add(r.event)
    assert all(not {"file_skip", "file_complete"} <= k for k in kinds.values())
    ended = {r.run_id for r in rows if r.event == "error"}
    assert not any(r.run_id in ended and r.stage > 2 for r in rows)


def test_source_tree_reads_gz_names_as_they_are(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"\x1f\x8bnot gzip")
    assert source_tree.read_source_tree(spark, {"one": str(tmp_path)}).first()["skip_reason"] is None


def test_sinks(spark, tmp_path):
    reviews, discovered = R.reviews(spark, SF), R.discovered(spark, SF)
    report = catalog.QUERIES["run_report"](spark, SF)
    sinks.write_report(report, reviews, str(tmp_path / "report"))
    back = spark.read.parquet(str(tmp_path / "report/reports"))
    assert spark.read.parquet(str(tmp_path / "report/reviews")).count() == reviews.count()
    assert back.count() == discovered.select("run_id").distinct().count() and "generated_at" in back.columns
    one = sinks.report_json(report, reviews).filter("kind = 'review'").orderBy("seq").first()
    assert json.loads(one["body"])["issues"][0]["severity"] == "critical"
    docs = spark.createDataFrame([("r", "src/a.test.py", "d"), ("r", "README.md", "m")], "repo string, path string, doc string")
    sinks.write_docs(docs, str(tmp_path / "docs"))
    names = spark.read.parquet(str(tmp_path / "docs")).select("file_name")
    assert sorted(r[0] for r in names.collect()) == ["README.md", "a_docs.md"]


def test_documentation_of_files(spark, files):
    def model(prompts, temperature):
        if temperature == 0.4:
            return ["# readme"] * len(prompts)
        return [json.dumps({"documentation": f"doc of {p.splitlines()[0][-4:]}"}) for p in prompts]

    corpus = files({"a.py": "x", "b.py": "y" * 51201, "c.md": "z", "d.go": "w"}).drop("language")
    out = sorted(tuple(r) for r in review.document_files(corpus, model).collect())
    assert out == [("r", "README.md", "# readme", None), ("r", "a.py", "doc of a.py", None)]
    assert [r["path"] for r in review.document_files(corpus, model, ["zz"]).collect()] == ["README.md"]
    bare = files({"note.txt": "x"}).drop("language")
    assert [(r["path"], r["error"]) for r in review.document_files(bare, model).collect()] == [(None, K.NO_FILES_MESSAGE)]


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark)
    assert folder == shared_folder(spark) and fresh_folder(spark, "x") != fresh_folder(spark, "x")


PYTHON_ALLOWED = {
    "smell_long_function", "smell_missing_docstring", "smell_deep_nesting", "all_smells", "py_nodes", "py_functions", "py_classes",
    "py_imports", "py_complexity", "py_nesting", "file_metrics", "review_prompts", "infer_stub", "static_report",
    "generate_docs", "static_categories", "scan_source_tree", "scan_event_log", "stream_smells", "stream_severity",
    "infer_ledger", "follow_event_log", "run_sessions",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm(spark):
    for name, query in catalog.QUERIES.items():
        if name not in PYTHON_ALLOWED:
            plan = plan_of(query(spark, SF))
            assert "Python" not in plan and "InPandas" not in plan, name
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_file_work_is_not_shuffled(spark):
    corpus = spark.read.schema("repo string, path string, size bigint, content string").parquet(f"{SF}/documents.parquet")
    for op in (smells.all_smells, catalog.SEC.security_scan, catalog.prompts.review_prompts, catalog.M.file_metrics):
        assert "Exchange" not in plan_of(op(SEL.analysed(corpus)))


def test_size_test_reaches_the_scan(spark):
    corpus = spark.read.schema("repo string, path string, size bigint, content string").parquet(f"{SF}/documents.parquet")
    plan = plan_of(SEL.analysed(corpus).select("path"))
    assert "LessThanOrEqual(size,51200)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_top_n_is_cut_before_the_shuffle(spark):
    for name in ("worst_files", "recent_items", "category_breakdown"):
        assert "WindowGroupLimit" in plan_of(catalog.QUERIES[name](spark, SF)), name


def test_tasks_do_not_grow_with_small_logs(tmp_path):
    for i in range(1000):
        (tmp_path / f"{i:04}.log").write_bytes(b"data: {}\n\n" * 9)
    reader = event_log.EventLogReader({"path": str(tmp_path), "splitbytes": "64"})
    parts = [part.ranges for part in reader.partitions()]
    assert len(parts) <= 2 * event_log.TASKS  # what is left open in a task is less than the next range
    # all ranges are there, cut as before
    assert [r for ranges in parts for r in ranges] == [
        (str(tmp_path / f"{i:04}.log"), begin, min(begin + 64, 90)) for i in range(1000) for begin in (0, 64)
    ]


def test_logs_without_new_bytes_are_not_opened(tmp_path, monkeypatch):
    (tmp_path / "a.log").write_bytes(b"data: {}\n\n")
    reader = event_log.EventLogStreamReader({"path": str(tmp_path), "positions": str(tmp_path / "positions"), "shards": "1"})
    monkeypatch.setattr(reader, "_complete", lambda *_: 1 / 0)
    assert reader._planned(0, {str(tmp_path / "a.log"): (10, False)}) == {str(tmp_path / "a.log"): (10, 10, False)}


def test_followed_logs_take_no_task_and_no_folder_each(spark, tmp_path):
    events = spark.range(2100).selectExpr("id AS event_id", "id % 700 AS user_id", "TIMESTAMP '2024-01-01' AS ts", "'view' AS event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.sparkContext.setJobGroup("followed", "")
    tracker = spark.sparkContext.statusTracker()
    found = sorted(catalog.QUERIES["follow_event_log"](spark, str(tmp_path)).collect())
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("followed") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 100
    parsed = event_log.parse_records(R.event_records(spark, str(tmp_path)), "run_id", "seq")
    want = parsed.groupBy("run_id", "event").agg(F.count("*").alias("events"), F.sum(F.length("data")).alias("chars"))
    assert len(found) > 700 and found == sorted(want.collect())


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_logs_are_written_up_to_a_share_of_their_bytes(spark, tmp_path, share):
    events = spark.range(3000).selectExpr("id AS event_id", "CAST(sqrt(id) AS BIGINT) AS user_id", "TIMESTAMP '2024-01-01' AS ts", "'click' AS event_type")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    catalog._write_logs(spark, str(tmp_path), f"{tmp_path}/logs", 1.0)
    catalog._write_logs(spark, str(tmp_path), f"{tmp_path}/logs", share)  # written anew, not added to
    whole = {}
    for r in R.event_records(spark, str(tmp_path)).orderBy("seq").collect():
        whole[r["run_id"]] = whole.get(r["run_id"], b"") + r["record"].encode() + b"\n\n"
    logs = {int(p.stem.removeprefix("run=")): p.read_bytes() for p in (tmp_path / "logs").rglob("run=*.log")}
    assert logs == {run: text[: int(len(text) * share)] for run, text in whole.items()}
    assert len([p for p in (tmp_path / "logs").iterdir()]) <= catalog.LOG_FOLDERS


def test_a_table_without_events_has_no_log_rows(spark, tmp_path):
    R.table(spark, SF, "events").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["scan_event_log"](spark, str(tmp_path)).count() == 0
    assert catalog.QUERIES["follow_event_log"](spark, str(tmp_path)).count() == 0

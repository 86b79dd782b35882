"""Logs that grow, sessions of runs, the ledger of answers and publication: what they do when something fails half-way."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import values
from corpusreview.operators import issues as I
from corpusreview.operators import prompts, ranking
from corpusreview.sources import event_log, sinks
from corpusreview.streaming import jobs, sessions

RECORDS = [f'event: e{i}\ndata: {{"n": {i}}}' for i in range(40)]


def follow(spark, root, shards=3):
    """One run of a query that follows the logs below ``root``; all events so far."""
    stream = event_log.read_event_log(spark, f"{root}/logs", positions=f"{root}/positions", shards=shards)
    jobs.append_stream(stream, f"{root}/out", f"{root}/checkpoint")
    return sorted((os.path.basename(r["file"]), r["start"], r["event"], r["data"]) for r in spark.read.parquet(f"{root}/out").collect())


def batch(spark, root):
    rows = event_log.read_event_log(spark, f"{root}/logs").collect()
    return sorted((os.path.basename(r["file"]), r["start"], r["event"], r["data"]) for r in rows)


def test_growing_logs_give_the_rows_of_a_batch_read(spark, tmp_path):
    root = str(tmp_path)
    os.makedirs(f"{root}/logs/deep")
    wholes = {
        "a.log": "\n\n".join(RECORDS) + "\n\n",
        "deep/b.log": "\n\n\n".join(RECORDS[:9]) + "\n\n\n\n\n" + RECORDS[9] + "\n\n",
        "c.log": "\n\n".join(RECORDS[:5]) + "\n\ndata: [DONE]\n\n" + "\n\n".join(RECORDS[5:9]) + "\n\n",
        "d.log": "event: never closed\ndata: 1",
        "_own.log": RECORDS[0] + "\n\n",
    }
    sizes = {name: [len(w) * k // 7 for k in (1, 1, 3, 6, 7)] for name, w in wholes.items()}
    sizes["deep/b.log"] = [0, 51, 52, 53, len(wholes["deep/b.log"])]  # ends inside runs of line breaks
    for step in range(5):
        for name, whole in wholes.items():
            with open(f"{root}/logs/{name}", "w") as out:
                out.write(whole[: sizes[name][step]])
        assert follow(spark, root) == batch(spark, root)
    assert len(batch(spark, root)) == 40 + 10 + 5
    with open(f"{root}/logs/new.log", "w") as out:
        out.write(RECORDS[0] + "\n\n")
    os.remove(f"{root}/logs/a.log")
    assert len(follow(spark, root)) == 56 and len(batch(spark, root)) == 16


def test_a_repeated_task_reads_what_was_planned(tmp_path):
    """A task that runs again gives the same rows, whatever was written meanwhile; older positions go."""
    os.makedirs(f"{tmp_path}/logs")
    log = f"{tmp_path}/logs/a.log"
    with open(log, "w") as out:
        out.write("\n\n".join(RECORDS[:3]) + "\n\n")
    reader = event_log.EventLogStreamReader({"path": f"{tmp_path}/logs", "positions": f"{tmp_path}/positions", "shards": "1"})
    first = event_log.EventLogShard(0, 0, 10)
    start = reader.read(first)
    next(start)  # the attempt ends after its first row
    start.close()
    with open(log, "a") as out:
        out.write("\n\n".join(RECORDS[3:5]) + "\n\n")
    assert [r[2] for r in reader.read(first)] == RECORDS[:3]
    assert [r[2] for r in reader.read(event_log.EventLogShard(0, 10, 20))] == RECORDS[3:5]
    assert [r[2] for r in reader.read(event_log.EventLogShard(0, 20, 30))] == []
    assert sorted(os.listdir(f"{tmp_path}/positions/shard=0")) == ["20.done", "20.plan", "30.done", "30.plan"]
    with pytest.raises(ValueError, match="no positions"):
        list(reader.read(event_log.EventLogShard(0, 15, 40)))
    assert [p.shard for p in reader.partitions({"at": 1}, {"at": 2})] == [0] and reader.latestOffset() != reader.latestOffset()


EVENTS = "run_id bigint, seq bigint, ts string, event string"


def run_stream(spark, root, batches, silence=60):
    """Sessions after each of several batches of events."""
    os.makedirs(f"{root}/in", exist_ok=True)
    seen = []
    for rows in batches:
        table = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        table.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = jobs.stream_table(spark, f"{root}/in", table.schema)
        sessions.with_rocksdb(spark, lambda: jobs.update_stream(sessions.run_sessions(stream, silence), f"{root}/out", f"{root}/cp"))  # noqa: B023
        found = jobs.latest(spark, f"{root}/out", ["run_id", "started"]).collect()
        seen.append(sorted((r["run_id"], r["started"].strftime("%H:%M:%S"), r["events"], r["files"], r["state"], r["closed"]) for r in found))
    return seen


def test_sessions_close_by_event_timer_and_gap(spark, tmp_path):
    day = "2024-01-01 10:"
    first = [
        (1, 1, f"{day}00:00", "clone_start"), (1, 2, f"{day}00:10", "clone_complete"), (1, 3, f"{day}00:20", "file_start"),
        (2, 4, f"{day}00:05", "clone_start"), (2, 5, f"{day}00:06", "analysis_complete"), (2, 6, f"{day}00:40", "clone_start"),
        (3, 7, f"{day}00:00", "clone_complete"), (3, 8, f"{day}01:01", "file_start"),
    ]
    second = [(1, 9, f"{day}01:15", "file_start"), (4, 10, f"{day}02:10", "error")]
    third = [(1, 11, f"{day}05:00", "clone_start")]
    one, two, three = run_stream(spark, str(tmp_path), [first, second, third])
    # run 2 ends with a final event and begins anew; run 3 falls silent inside the batch, for one second too long
    assert one == [
        (1, "10:00:00", 3, 1, "analyzing", False), (2, "10:00:05", 2, 0, "complete", True), (2, "10:00:40", 1, 0, "cloning", False),
        (3, "10:00:00", 1, 0, "failed", True), (3, "10:01:01", 1, 1, "cloning", False),
    ]
    # 55 s are no silence; the watermark of 10:02:10 closes the open session of run 2, and that of run 3
    assert two == [
        (1, "10:00:00", 4, 2, "analyzing", False), (2, "10:00:05", 2, 0, "complete", True), (2, "10:00:40", 1, 0, "failed", True),
        (3, "10:00:00", 1, 0, "failed", True), (3, "10:01:01", 1, 1, "failed", True), (4, "10:02:10", 1, 0, "error", True),
    ]
    assert three[0] == (1, "10:00:00", 4, 2, "failed", True) and three[1] == (1, "10:05:00", 1, 0, "cloning", False)
    # what is closed has no state: only the last session of run 1 is kept
    state = spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/cp")
    assert state.count() == 1


LEDGER_JOB = """
import sys
sys.path.insert(0, {root!r})
from corpusreview.session import build_session
from corpusreview.operators import prompts
spark = build_session("ledger", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
df = spark.createDataFrame([(i, None if i == 99 else f"prompt {{i % 60}}") for i in range(100)], "id int, prompt string")
def model(texts, temperature):
    import os
    with open({calls!r}, "a") as log:
        log.write("".join(t + "\\n" for t in texts))
    if "prompt 7" in texts and os.path.exists({bomb!r}):
        os.remove({bomb!r})
        os._exit(1)  # the worker is lost in the middle of a call
    return [t.upper() for t in texts]
rows = prompts.infer_ledger(df, model, {ledger!r}, batch=2).collect()
assert len(rows) == 100 and all(r["raw"] == (r["prompt"] and r["prompt"].upper()) and r["error"] is None for r in rows)
print("done")
"""


def test_only_missing_answers_are_asked_after_a_lost_worker(tmp_path):
    """The first run loses its worker in the middle; the second asks what is missing, the third asks nothing."""
    names = {n: f"{tmp_path}/{n}" for n in ("calls", "bomb", "ledger")}
    open(names["bomb"], "w").close()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    job = LEDGER_JOB.format(root=root, **names)
    runs = [subprocess.run([sys.executable, "-c", job], capture_output=True, text=True, timeout=300) for _ in range(3)]
    assert ["done" in r.stdout for r in runs] == [False, True, True], runs[1].stderr[-2000:]
    with open(names["calls"]) as log:
        asked = log.read().splitlines()
    assert set(asked) == {f"prompt {i}" for i in range(60)}
    # what was under way when the worker was lost, two prompts at a time in two tasks, is asked again
    assert 60 < len(asked) <= 60 + 4


def test_ledger_keeps_errors_apart(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i % 10}") for i in range(30)], "id int, prompt string")

    def model(bad):
        def ask(texts, temperature):
            if any(t in bad for t in texts):
                raise ValueError("no")
            return [f"{t}@{temperature}" for t in texts]

        return ask

    ledger = f"{tmp_path}/ledger"
    first = prompts.infer_ledger(df, model({"p3", "p4"}), ledger).collect()
    assert {r["prompt"]: r["error"] for r in first if r["error"]} == {"p3": "ValueError: no", "p4": "ValueError: no"}
    second = prompts.infer_ledger(df, model({"p4"} | {f"p{i}" for i in range(3)}), ledger).collect()
    assert {r["prompt"] for r in second if r["error"]} == {"p4"} and len(second) == 30
    # another temperature is another question
    third = prompts.infer_ledger(df, model(set()), ledger, temperature=0.9).collect()
    assert {r["raw"] for r in third} == {f"p{i}@0.9" for i in range(10)}
    assert prompts.infer_ledger(df.limit(0), model(set()), ledger).count() == 0


def test_publication_is_all_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/runs"
    good = spark.range(3).selectExpr("id AS run_id")
    with pytest.raises(LookupError):
        sinks.published(spark, path, "reports")
    first = sinks.publish({"reports": good, "reviews": good}, path)
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("run_id"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish({"reports": spark.range(7).selectExpr("id AS run_id"), "reviews": bad}, path)
    # the reports of the failed run are written, and nobody sees them
    assert sinks.versions(spark, path).count() == 1 and sinks.published(spark, path, "reports").count() == 3
    docs = spark.createDataFrame([("r", "a/b.c.py", "x"), ("r", "README.md", "y")], "repo string, path string, doc string")
    sinks.publish_run(good.withColumn("repo_url", F.lit("u")), good, docs, path)
    assert sinks.published(spark, path, "reports").filter("generated_at IS NOT NULL AND repo_url = 'u'").count() == 3
    assert sorted(values(sinks.published(spark, path, "docs"), "file_name")) == ["README.md", "b_docs.md"]
    assert sinks.published(spark, path, "reviews", first).count() == 3 and sinks.versions(spark, path).count() == 2


def test_positions_by_ranges(spark):
    """Dense and sparse keys, a hot group over all partitions, null groups and a collated order."""
    rows = [("hot", i * 10**12, f"p{i % 50}") for i in range(3000)] + [(None, i, "x") for i in range(5)] + [("b", 7, "É"), ("b", 8, "e"), ("b", 9, "F")]
    df = spark.createDataFrame(rows, "run_id string, seq bigint, file_path string").repartition(5)
    found = ranking.range_position(df, ["run_id"], [F.col("seq")], descending=(0,)).collect()
    place = {(r["run_id"], r["seq"]): r["position"] for r in found}
    assert len(found) == len(rows) and all(place["hot", i * 10**12] == 3000 - i for i in range(3000)) and place[None, 4] == 1
    by_file = I.sort_by_file(df.withColumn("issue_no", F.lit(0))).collect()
    assert [r["file_path"] for r in sorted((r for r in by_file if r["run_id"] == "b"), key=lambda r: r["position"])] == ["e", "É", "F"]
    assert ranking.range_position(df.limit(0), ["run_id"], [F.col("seq")]).count() == 0


def test_current_rows_cost_the_same_after_any_number_of_batches(spark, tmp_path):
    target, schema = f"{tmp_path}/t", "k bigint, j string, n bigint"
    want = {}
    for batch in range(10):
        rows = [(k, None if k % 5 == 0 else "j", batch) for k in range(batch, 40, batch + 1)]
        want |= {r[:2]: batch for r in rows}
        for _ in range(2 if batch % 3 == 0 else 1):  # a batch that is repeated adds nothing
            jobs.merge_rows(spark.createDataFrame(rows, schema), batch, target, ["k", "j"], 4)
        found = jobs.current(spark, target, schema)
        assert {(r["k"], r["j"]): r["n"] for r in found.collect()} == want and found.count() == len(want)
        assert len(found.inputFiles()) <= 4 and len(os.listdir(f"{target}/manifest")) <= 2
    assert len([d for d in os.listdir(target) if d.startswith("v=")]) <= 8
    # a batch that fails before its manifest changes nothing, also when it runs again
    jobs.merge_rows(spark.createDataFrame([(1, "j", 77)], schema), 10, target, ["k", "j"], 4)
    os.remove(f"{target}/manifest/batch=10/_SUCCESS")
    assert {(r["k"], r["j"]): r["n"] for r in jobs.current(spark, target, schema).collect()} == want
    jobs.merge_rows(spark.createDataFrame([(1, "j", 78)], schema), 10, target, ["k", "j"], 4)
    assert {(r["k"], r["j"]): r["n"] for r in jobs.current(spark, target, schema).collect()} == want | {(1, "j"): 78}
    assert jobs.current(spark, f"{tmp_path}/none", schema).count() == 0


def test_requests_run_with_the_query(spark):
    from corpusreview.operators.selection import restrict_paths

    files = spark.range(2000).selectExpr("'r' AS repo", "concat('p', id) AS path", "id AS size")
    many = spark.range(500, 200_000).selectExpr("concat('p', id) AS path").unionAll(spark.sql("SELECT CAST(NULL AS STRING) AS path"))
    group = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("requests", "")
    frames = [restrict_paths(files, x) for x in (many, many.limit(0), ["p1", "p1", "p7", "gone"], [], None, many.selectExpr("'r' AS repo", "path"), many.selectExpr("'q' AS repo", "path"))]
    assert not group.getJobIdsForGroup("requests")
    assert [f.count() for f in frames] == [1500, 2000, 2, 2000, 2000, 1500, 0]
    assert frames[0].columns == files.columns

"""Progress of runs folded from their events; the same code serves batch tables and streams.

The state per run is a fixed set of counts and last-by-``seq`` values, so it is an ordinary aggregation: it combines
before the shuffle (one run may hold most events) and runs in ``update`` or ``complete`` mode without a watermark.  For
``append`` mode add ``withWatermark('ts', …)`` to the events first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import scores as S
from corpusreview.functions import text as T

_ISSUE = "struct<severity:string,category:string,file_path:string,line_number:bigint,description:string,suggestion:string>"
PAYLOAD = (
    "files bigint, file string, reason string, message string, "
    f"review struct<file_path:string,language:string,score:double,summary:string,issues:array<{_ISSUE}>>, "
    "report struct<total_files:bigint,files_analyzed:bigint,overall_score:double,critical_count:bigint,"
    "warning_count:bigint,info_count:bigint,summary:string>"
)
STATES = {
    "clone_start": "cloning",
    "clone_complete": "analyzing",
    "analysis_complete": "complete",
    "error": "error",
}


def with_payload(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("data", PAYLOAD))


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"p.{name}"), F.lit("")), F.lit(default))


def run_progress(events: DataFrame) -> DataFrame:
    """Total, current file, reviewed files, issues, percent and phase text per run."""
    event, seq = F.col("event"), F.col("seq")
    is_start, is_found = event == "file_start", event == "clone_complete"
    has_review = (event == "file_complete") & F.col("p.review").isNotNull()
    # the last of these events decides what the progress line says
    shown = event.isin("clone_start", "clone_complete", "file_start", "file_skip")
    last = F.struct(
        event.alias("event"), _text("file", "").alias("file"), _text("file", "file").alias("skipped"),
        _text("reason", "too large").alias("reason"),
    )
    # current file and index go back to nothing when the file list (re)starts
    resets = is_start | is_found
    folded = (
        with_payload(events)
        .groupBy("run_id")
        .agg(
            F.count_if(is_start).alias("_starts"),
            F.coalesce(F.max_by(F.when(is_found, F.coalesce("p.files", F.lit(0))), F.when(is_found, seq)), F.lit(0)).alias("total"),
            F.count_if(has_review).alias("reviewed"),
            F.sum(F.when(has_review, F.coalesce(F.size("p.review.issues"), F.lit(0))).otherwise(0)).alias("issues"),
            F.max_by(F.when(resets, F.struct(is_start.alias("started"), _text("file", "").alias("file"))), F.when(resets, seq)).alias("_at"),
            F.max_by(F.when(shown, last), F.when(shown, seq)).alias("_last"),
        )
    )
    started = F.coalesce(F.col("_at.started"), F.lit(False))
    staged = folded.select(
        "run_id", "total", "reviewed", "issues", "_starts", "_last",
        F.when(started, F.col("_starts")).otherwise(F.lit(0)).alias("current"),
        F.when(started, F.col("_at.file")).otherwise(F.lit("")).alias("current_file"),
    )
    phase = (
        F.when(F.col("_last.event") == "clone_complete", T.format_text(K.PHASE_FOUND, F.col("total")))
        .when(F.col("_last.event") == "file_start", T.format_text(K.PHASE_FILE, F.col("_starts"), F.col("total")))
        .when(F.col("_last.event") == "file_skip", T.format_text(K.PHASE_SKIP, F.col("_last.skipped"), F.col("_last.reason")))
        .otherwise(F.lit(K.PHASE_CLONING))
    )
    percent = S.percent_done(F.col("current"), F.col("total"))
    return staged.select(
        "run_id", "total", "current", "current_file", "reviewed", "issues", percent.alias("percent"), phase.alias("phase")
    )


def run_state(events: DataFrame, closed: bool = True) -> DataFrame:
    """Last state of each run; a log that has ended turns unfinished runs into complete ones."""
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event")]
    last = events.groupBy("run_id").agg(
        F.coalesce(F.max_by(state, F.when(state.isNotNull(), F.col("seq"))), F.lit("cloning")).alias("open_state")
    )
    ended = F.when(F.col("open_state").isin("cloning", "analyzing"), F.lit("complete")).otherwise(F.col("open_state"))
    return last.withColumn("state", ended if closed else F.col("open_state"))


def reviews_of(events: DataFrame) -> DataFrame:
    """Reviews inside ``file_complete`` events."""
    done = with_payload(events.filter(F.col("event") == "file_complete")).filter(F.col("p.review").isNotNull())
    return done.select("run_id", "seq", "p.review.*")


def finished_runs(events: DataFrame) -> DataFrame:
    """Runs that have a final report."""
    final = with_payload(events.filter(F.col("event") == "analysis_complete")).filter(F.col("p.report").isNotNull())
    return final.select("run_id").distinct()


def stream_severity(events: DataFrame) -> DataFrame:
    """Running number of issues per run and severity as reviews arrive."""
    rows = reviews_of(events).select("run_id", F.explode_outer("issues").alias("issue"))
    issues = rows.filter(F.col("issue").isNotNull())
    return issues.groupBy("run_id", F.col("issue.severity").alias("severity")).agg(F.count("*").alias("issues"))

"""Counts, weighted scores and reports per run, from reviews with nested issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.functions import scores as S
from corpusreview.functions import text as T

_SCORE = "decimal(18,6)"


def count_severity(issues: Column, severity: str) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == severity))


def review_counts(reviews: DataFrame) -> DataFrame:
    """Add ``critical_count, warning_count, info_count`` (any other severity counts as info) and ``issue_count``."""
    issues = F.col("issues")
    return reviews.withColumns(
        {
            "issue_count": F.size(issues),
            "critical_count": count_severity(issues, "critical"),
            "warning_count": count_severity(issues, "warning"),
        }
    ).withColumn("info_count", F.col("issue_count") - F.col("critical_count") - F.col("warning_count"))


def severity_counts(reviews: DataFrame) -> DataFrame:
    names = ("critical_count", "warning_count", "info_count")
    return review_counts(reviews).groupBy("run_id").agg(*[F.sum(n).alias(n) for n in names])


def file_severity_counts(reviews: DataFrame) -> DataFrame:
    """One row per review and severity that occurs; severities outside the enum are ignored."""
    issues = F.col("issues")
    counts = F.array(
        *[F.struct(F.lit(s).alias("severity"), count_severity(issues, s).alias("issues")) for s in K.SEVERITIES]
    )
    rows = reviews.select("run_id", "seq", "file_path", F.inline(counts))
    return rows.filter(F.col("issues") > 0)


def _weight() -> Column:
    value = (
        F.when(F.col("critical_count") > 0, F.lit(K.WEIGHT_CRITICAL))
        .when(F.col("issue_count") == 0, F.lit(K.WEIGHT_CLEAN))
        .otherwise(F.lit(K.WEIGHT_ISSUES))
    )
    return value.cast("decimal(2,1)")


def _report_sums(reviews: DataFrame) -> DataFrame:
    """All sums a report needs, in one partial + final aggregation per run."""
    weighted = review_counts(reviews).select(
        "run_id",
        F.col("score").cast(_SCORE).alias("_score"),
        _weight().alias("_weight"),
        "critical_count",
        "warning_count",
        "info_count",
    )
    return weighted.groupBy("run_id").agg(
        F.count("*").alias("files_analyzed"),
        F.sum(F.col("_score") * F.col("_weight")).alias("_weighted"),
        F.sum("_weight").alias("_weights"),
        *[F.sum(n).alias(n) for n in ("critical_count", "warning_count", "info_count")],
    )


def _overall() -> Column:
    # exact decimals, so the result does not depend on the order rows are summed in
    ratio = F.bround(F.col("_weighted") / F.col("_weights"), 1).cast("double")
    return F.coalesce(ratio, F.lit(K.NO_REVIEWS_SCORE))


def overall_score(reviews: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Weighted mean score per run; 100 for runs (when given) without reviews."""
    sums = _report_sums(reviews)
    if runs is not None:
        sums = runs.select("run_id").distinct().join(sums, "run_id", "left")
    return sums.select("run_id", _overall().alias("overall_score"))


def run_report(reviews: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """One report row per run.

    ``discovered`` has a row per file found (``run_id``, before any language filter); without it the total is the
    number of reviews.  The time of the report is added by the sink, not here, so the row is reproducible.
    """
    sums = _report_sums(reviews)
    if discovered is None:
        joined = sums.withColumn("total_files", F.col("files_analyzed"))
    else:
        found = discovered.groupBy("run_id").agg(F.count("*").alias("total_files"))
        joined = found.join(sums, "run_id", "left")
    counts = ("critical_count", "warning_count", "info_count")
    out = joined.withColumn("overall_score", _overall()).na.fill(0, ["files_analyzed", *counts])
    score = F.col("overall_score")
    out = out.withColumn("quality_label", S.quality_label(score))
    summary = T.format_text(
        K.REPORT_TEXT, F.col("files_analyzed"), score, F.col("quality_label"), *[F.col(c) for c in counts]
    )
    return out.select(
        "run_id", "total_files", "files_analyzed", "overall_score", *counts, "quality_label", summary.alias("summary")
    )


def with_address(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """Reports with ``repo_url``, the address of the run's repository in ``runs`` (``run_id, repo_url``); null if it has none."""
    addresses = runs.groupBy("run_id").agg(F.min("repo_url").alias("repo_url"))
    return reports.join(addresses, "run_id", "left")


def fallback_stats(reviews: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """Totals of runs that ended without a final report: plain mean rounded half up, counts by exact severity."""
    none = F.array().cast(reviews.schema["issues"].dataType)
    issues = F.coalesce(F.col("issues"), none)
    per_file = reviews.select(
        "run_id",
        F.coalesce(F.col("score"), F.lit(0.0)).cast(_SCORE).alias("_score"),
        *[count_severity(issues, s).alias(s) for s in K.SEVERITIES],
    )
    sums = per_file.groupBy("run_id").agg(
        F.count("*").alias("files_analyzed"),
        F.sum("_score").alias("_sum"),
        *[F.sum(s).alias(f"{s}_count") for s in K.SEVERITIES],
    )
    if finished is not None:
        # after the sums: one small row per run meets the finished runs
        sums = sums.join(finished.select("run_id").distinct(), "run_id", "left_anti")
    mean = F.col("_sum") / F.col("files_analyzed").cast("decimal(20,0)")
    return sums.select(
        "run_id",
        F.col("files_analyzed").alias("files_scanned"),
        "files_analyzed",
        F.floor(mean + F.lit("0.5").cast("decimal(2,1)")).cast("bigint").alias("overall_score"),
        *[f"{s}_count" for s in K.SEVERITIES],
        T.format_text(K.FALLBACK_TEXT, F.col("files_analyzed")).alias("summary"),
    )


def score_classes(reviews: DataFrame) -> DataFrame:
    score = F.col("score")
    return reviews.select(
        "run_id",
        "seq",
        "score",
        S.dial_class(score).alias("dial_class"),
        S.chip_class(score).alias("chip_class"),
        S.quality_label(score).alias("quality_label"),
        S.round_half_up(score).alias("shown_score"),
        F.concat(S.capitalised(S.dial_class(score)), F.lit(" Quality")).alias("dial_label"),
    )

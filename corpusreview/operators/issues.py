"""Views on reviews and issues: filters, rankings, groupings.

``issues`` is the flat table of ``flatten_issues`` with ``(run_id, seq, issue_no)`` as arrival order; ``reviews`` has one
row per file with a nested ``issues`` array.  A run may hold any share of the rows: aggregates combine before the
shuffle, top-n rankings cut inside the partitions first, and full positions use block-wise running sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corpusreview import constants as K
from corpusreview.functions import scores as S
from corpusreview.operators.ranking import position, range_position, running_sum

ALL = "all"


def _lower(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def passes(severity: str = ALL, category: str = ALL, term: str = "") -> Column:
    """Whether an issue has a severity, a category and contains a term (plain substring, any case, not trimmed)."""
    out = F.lit(True)
    if severity != ALL:
        out &= F.col("severity") == severity
    if category != ALL:
        out &= F.col("category") == category
    if term.strip():
        out &= F.greatest(*[F.contains(_lower(c), F.lit(term.lower())) for c in ("description", "file_path", "category")])
    return out


def filter_issues(issues: DataFrame, severity: str = ALL, category: str = ALL, term: str = "") -> DataFrame:
    """Issues that pass the filters."""
    return issues.filter(passes(severity, category, term))


def search_issues(issues: DataFrame, term: str) -> DataFrame:
    return filter_issues(issues, term=term)


def sort_by_severity(issues: DataFrame) -> DataFrame:
    """Issues with their position in the run: most severe first, arrival order inside a severity."""
    ranked = issues.withColumn("severity_rank", S.severity_rank(F.col("severity")))
    return position(ranked, ["run_id"], ["seq", "issue_no"], lead=("severity_rank",))


def sort_by_file(issues: DataFrame) -> DataFrame:
    """Issues with their position in the run: path order of a root-locale collation, arrival order inside a path."""
    path = F.collate(F.coalesce("file_path", F.lit("")), "UNICODE")
    return range_position(issues, ["run_id"], [path, F.col("seq"), F.col("issue_no")])


def shown_counts(issues: DataFrame, reviews: DataFrame, **filters: str) -> DataFrame:
    """Issues that pass the filters, all issues and reviewed files per run."""
    counts = issues.groupBy("run_id").agg(F.count_if(passes(**filters)).alias("shown"), F.count("*").alias("issues"))
    files = reviews.groupBy("run_id").agg(F.count("*").alias("files"))
    out = files.join(counts, "run_id", "left")
    return out.na.fill(0, ["shown", "issues"]).select("run_id", "shown", "issues", "files")


def category_breakdown(issues: DataFrame, n: int = K.TOP_CATEGORIES) -> DataFrame:
    """The ``n`` largest categories per run with counts per severity; ties by first appearance."""
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("other"))
    severity = F.col("severity")
    counted = issues.groupBy("run_id", category.alias("category")).agg(
        *[F.count_if(severity == s).alias(s) for s in K.SEVERITIES],
        F.count("*").alias("total"),
        F.min(F.struct("seq", "issue_no")).alias("_first"),
    )
    w = W.partitionBy("run_id").orderBy(F.desc("total"), "_first")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("_first")


def category_share(issues: DataFrame, n: int = K.TOP_CATEGORIES) -> DataFrame:
    """Share of each kept category in percent of the largest one."""
    largest = F.max("total").over(W.partitionBy("run_id"))
    return category_breakdown(issues, n).select(
        "run_id", "rank", "category", "total", (F.col("total") / largest * 100).alias("share")
    )


def issue_categories(issues: DataFrame) -> DataFrame:
    """Filter choices per run: ``all``, then the distinct non-empty categories in order."""
    every = F.struct(F.lit(0).alias("_kind"), F.lit(ALL).alias("category"))
    named = F.when(F.col("category") != "", F.struct(F.lit(1).alias("_kind"), F.col("category").alias("category")))
    choices = issues.select("run_id", F.explode(F.array_compact(F.array(every, named))).alias("c")).select("run_id", "c.*")
    return choices.distinct().orderBy("run_id", "_kind", "category").drop("_kind")


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews per score band; all four bands per run, fractional scores between bands are in none."""
    bands = [
        F.count_if(F.col("score").between(low, high)).alias(f"_{i}") for i, (_, low, high) in enumerate(K.SCORE_BANDS)
    ]
    per_run = reviews.groupBy("run_id").agg(*bands, F.count("*").alias("_files"))
    entries = [
        F.struct(F.lit(i + 1).alias("band_no"), F.lit(label).alias("band"), F.col(f"_{i}").alias("files"))
        for i, (label, _, _) in enumerate(K.SCORE_BANDS)
    ]
    rows = per_run.select("run_id", "_files", F.inline(F.array(*entries)))
    return rows.select("run_id", "band_no", "band", "files", (F.col("files") / F.col("_files") * 100).alias("share"))


def worst_files(reviews: DataFrame, n: int = K.TOP_FILES) -> DataFrame:
    """The ``n`` lowest scores per run with rank; ties by arrival."""
    w = W.partitionBy("run_id").orderBy("score", "seq")
    summary = F.when(F.col("summary") != "", F.concat(F.left("summary", F.lit(K.SUMMARY_CHARS)), F.lit("…")))
    slim = reviews.select("run_id", "seq", "file_path", "score", summary.alias("summary_start"))
    return slim.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_reviews(reviews: DataFrame) -> DataFrame:
    """First review by arrival per run and path."""
    first = F.min_by(F.struct("language", "score", "summary"), "seq").alias("r")
    return reviews.groupBy("run_id", "file_path").agg(first).select("run_id", "file_path", "r.*")


def issues_by_file(issues: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per run and path that has issues: how many, and the first review of that path if there is one.

    ``group_no`` is the order in which the paths first appear among the run's issues sorted by severity.
    """
    path = F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.lit(K.UNKNOWN_FILE))
    place = F.struct(S.severity_rank(F.col("severity")).alias("_rank"), F.col("seq").alias("_seq"), F.col("issue_no").alias("_no"))
    groups = issues.groupBy("run_id", path.alias("file_path")).agg(F.count("*").alias("issue_count"), F.min(place).alias("_first"))
    groups = groups.select("run_id", "file_path", "issue_count", "_first.*")
    groups = position(groups, ["run_id"], ["_seq", "_no"], "group_no", lead=("_rank",)).drop("_rank", "_seq", "_no")
    joined = groups.join(first_reviews(reviews), ["run_id", "file_path"], "left")
    return joined.withColumn("issue_text", S.counted(F.col("issue_count"), "issue"))


def issues_in_file(issues: DataFrame) -> DataFrame:
    """Issues with their position inside their file's group, most severe first."""
    path = F.coalesce(F.nullif(F.col("file_path"), F.lit("")), F.lit(K.UNKNOWN_FILE))
    keyed = issues.withColumn("file_path", path).withColumn("severity_rank", S.severity_rank(F.col("severity")))
    return position(keyed, ["run_id", "file_path"], ["seq", "issue_no"], lead=("severity_rank",))


def with_severity_dim(issues: DataFrame) -> DataFrame:
    """Label, order and known category of each issue; a literal lookup, nothing is joined."""
    return issues.withColumns(
        {
            "severity_label": S.severity_label(F.col("severity")),
            "severity_rank": S.severity_rank(F.col("severity")),
            "known_category": S.known_category(F.col("category")),
        }
    )


def live_feed(reviews: DataFrame) -> DataFrame:
    """Reviews newest first, with position."""
    slim = reviews.select("run_id", "seq", "file_path", "language", "score").withColumn("_newest", -F.col("seq"))
    out = position(slim, ["run_id"], ["_newest"]).drop("_newest")
    return out.withColumn("score_class", S.chip_class(F.col("score")))


def file_index(events: DataFrame) -> DataFrame:
    """The n-th ``file_start`` of each run, skipped files included."""
    starts = events.filter(F.col("event") == "file_start").select("run_id", "seq", "data")
    numbered = running_sum(starts, F.lit(1), ["run_id"], ["seq"], "file_index")
    file = F.coalesce(F.get_json_object("data", "$.file"), F.lit(""))
    return numbered.select("run_id", "seq", "file_index", file.alias("file"))


def recent_items(visits: DataFrame, n: int = K.RECENT_ITEMS, user: str = "user_id", item: str = "item", at: str = "at"):
    """The ``n`` items a user touched last; an item counts once, at its latest time; ties by item."""
    latest = visits.groupBy(user, item).agg(F.max(at).alias("last_at"))
    w = W.partitionBy(user).orderBy(F.desc("last_at"), item)
    return latest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

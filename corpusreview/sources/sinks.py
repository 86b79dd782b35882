"""Writers of reports, documentation and event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from corpusreview import constants as K
from corpusreview.functions import paths


def report_json(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """Report rows and their reviews as JSON documents: ``run_id, kind, seq, body``.

    A run's reviews are unbounded, so they are not gathered into one value: a report is one document, followed by one
    document per review in ``seq`` order.
    """
    head = reports.select(
        "run_id", F.lit("report").alias("kind"), F.lit(-1).cast("bigint").alias("seq"), F.to_json(F.struct("*")).alias("body")
    )
    body = F.to_json(F.struct(*[c for c in reviews.columns if c not in ("run_id", "seq")]))
    each = reviews.select("run_id", F.lit("review").alias("kind"), F.col("seq").cast("bigint"), body.alias("body"))
    return head.unionByName(each)


def write_report(reports: DataFrame, reviews: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet tables ``reports``, with the time they were generated, and ``reviews`` below ``path``."""
    reports.withColumn("generated_at", F.current_timestamp()).write.mode(mode).parquet(f"{path}/reports")
    reviews.write.mode(mode).parquet(f"{path}/reviews")


MANIFEST = "version string, published_at timestamp, tables array<string>"


def publish(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None) -> str:
    """Publish several tables together below ``path``; returns the name of their version.

    Every table is written to a folder of the new version first.  Readers find versions by a manifest, to which one row in
    one file is added last; a file appears when its task is committed.  So a reader sees all tables of a version or none, and
    what a failed run has written stays out of sight.  Earlier versions stay readable.
    """
    version = uuid.uuid4().hex
    by = partition_by or {}
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by[name]) if name in by else writer).parquet(f"{path}/{version}/{name}")
    row = spark.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.array(*map(F.lit, tables)).alias("tables")
    )
    row.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``version, published_at, tables`` of everything published below ``path``."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def published(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A published table, of the newest version or of the named one."""
    try:
        known = versions(spark, path).filter(F.array_contains("tables", name))
        known = known.filter(F.col("version") == version) if version else known
        found = known.orderBy(F.desc("published_at"), "version").first()
    except AnalysisException:
        found = None  # nothing has been published here
    if found is None:
        raise LookupError(f"{path} has no published table {name!r}")
    return spark.read.parquet(f"{path}/{found['version']}/{name}")


def publish_run(reports: DataFrame, reviews: DataFrame, docs: DataFrame, path: str) -> str:
    """Reports with their time and address, reviews and documentation files of some runs, published together."""
    stamped = reports.withColumn("generated_at", F.current_timestamp())
    return publish({"reports": stamped, "reviews": reviews, "docs": with_file_name(docs)}, path, {"docs": "repo"})


def with_doc_name(docs: DataFrame) -> DataFrame:
    return docs.withColumn("file_name", paths.doc_file_name(F.col("path")))


def write_docs(docs: DataFrame, path: str, by: str = "repo", mode: str = "overwrite") -> None:
    """One row per documentation file, in one folder per repository; a README row has path ``README.md``."""
    with_file_name(docs).write.mode(mode).partitionBy(by).parquet(path)


def with_file_name(docs: DataFrame) -> DataFrame:
    name = F.when(F.col("path") == "README.md", F.col("path")).otherwise(paths.doc_file_name(F.col("path")))
    return docs.withColumn("file_name", name)


def to_event_json(runs: DataFrame, discovered: DataFrame, files: DataFrame, reports: DataFrame) -> DataFrame:
    """The seven kinds of progress events as rows ``run_id, stage, seq, event, data``.

    ``runs`` (run_id, repo_url, branch), ``discovered`` (run_id, files, total_files), ``files`` (run_id, seq, path,
    language, skip_reason, review - a struct, null if there is none), ``reports`` (one row per run).  ``stage`` and ``seq``
    give the order inside a run.  A file is skipped or completed, never both.  A run without files ends with its error.
    """

    def event(stage: int, name: str, payload, seq=None, when=None):
        row = F.struct(
            F.lit(stage).alias("stage"),
            (F.lit(0) if seq is None else F.col(seq)).cast("bigint").alias("seq"),
            F.lit(name).alias("event"),
            F.to_json(payload, {"ignoreNullFields": "false"}).alias("data"),
        )
        return row if when is None else F.when(when, row)

    def rows(df: DataFrame, *events) -> DataFrame:
        return df.select("run_id", F.explode(F.array_compact(F.array(*events))).alias("e")).select("run_id", "e.*")

    known = F.col("files").isNotNull()
    head = rows(
        runs.select("run_id", "repo_url", "branch").join(discovered.select("run_id", "files", "total_files"), "run_id", "left"),
        event(0, "clone_start", F.struct("repo_url", "branch")),
        event(1, "clone_complete", F.struct("files", "total_files", "repo_url"), when=known),
        event(2, "error", F.struct(F.lit(K.NO_FILES_MESSAGE).alias("message")), when=F.col("files") == 0),
    )
    skipped = F.col("skip_reason").isNotNull()
    body = rows(
        files,
        event(3, "file_start", F.struct(F.col("path").alias("file"), "language"), "seq"),
        event(3, "file_skip", F.struct(F.col("path").alias("file"), F.col("skip_reason").alias("reason")), "seq", skipped),
        event(3, "file_complete", F.struct("review"), "seq", ~skipped & F.col("review").isNotNull()),
    )
    report = F.struct(*[c for c in reports.columns if c != "run_id"])
    tail = rows(reports, event(4, "analysis_complete", F.struct(report.alias("report"))))
    ended = discovered.filter(F.col("files") == 0).select("run_id")
    return head.unionByName(body.unionByName(tail).join(ended, "run_id", "left_anti"))

"""Whole reviews: from files to reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusreview import constants as K
from corpusreview.operators import prompts, replies, scoring, selection
from corpusreview.operators.metrics import with_metrics
from corpusreview.operators.security import with_vulnerabilities

# Points a finding costs in the model-free score; a rule of this engine, used nowhere else.
COST = {"critical": 10, "warning": 3, "info": 1}
ISSUE = replies.ISSUE


def _issue(severity: Column, category: str, line: Column, description: Column) -> Column:
    return F.struct(
        severity.alias("severity"),
        F.lit(category).alias("category"),
        F.col("path").alias("file_path"),
        line.cast("bigint").alias("line_number"),
        description.alias("description"),
        F.lit("").alias("suggestion"),
        F.lit(None).cast("string").alias("code_snippet"),
    )


def static_review(files: DataFrame) -> DataFrame:
    """Reviews without a model: vulnerabilities are critical issues, smells keep their severity.

    The score is 100 less a fixed cost per issue, at least 0.  One row per file, computed in the file's own row.
    """
    found = with_vulnerabilities(with_metrics(files))
    security = F.transform(
        "vulnerabilities", lambda v: _issue(F.lit("critical"), "security", v["line"], v["description"])
    )
    style = F.transform(
        "smells", lambda s: _issue(s["severity"], "code-quality", s["line"], s["description"])
    )
    cost = sum((scoring.count_severity(F.col("issues"), s) * c for s, c in COST.items()), F.lit(0))
    reviewed = found.withColumn("issues", F.concat(security, style))
    score = F.greatest(F.lit(0), 100 - cost).cast("double")
    return reviewed.select(
        F.col("repo").alias("run_id"), F.col("path").alias("file_path"), "language", score.alias("score"), "issues"
    )


def static_report(corpus: DataFrame, languages=K.DEFAULT_LANGUAGES, max_kb: int = K.MAX_FILE_SIZE_KB) -> DataFrame:
    """Report per repository of a corpus of ``repo, path, size, content``, without a model.

    ``files_skipped`` counts the files of the wanted languages that are too large to be read.
    """
    listed = selection.with_language(selection.drop_vendored(selection.with_extension(corpus)))
    large = selection.filter_languages(selection.size_guard(listed, max_kb)[1], languages)
    skipped = large.groupBy(F.col("repo").alias("run_id")).agg(F.count("*").alias("files_skipped"))
    discovered = listed.select(F.col("repo").alias("run_id"))
    report = scoring.run_report(static_review(selection.analysed(corpus, languages, max_kb)), discovered)
    return report.join(skipped, "run_id", "left").na.fill(0, ["files_skipped"])


def model_review(files: DataFrame, model: Callable[[list[str], float], Sequence[str | None]], batch: int = 32) -> DataFrame:
    """Reviews by a model: prompt, answer, checked answer; ``files`` are the selected files of a corpus.

    Where the model itself fails, the review's summary carries its error text.
    """
    asked = prompts.infer(prompts.review_prompts(files), model, prompts.TEMPERATURE["review"], batch=batch)
    answered = asked.select(F.col("repo").alias("run_id"), F.col("path").alias("file_path"), "language", "error", "raw")
    failed = F.concat(F.lit("Analysis failed: "), F.col("error"))
    return replies.parse_reviews(answered).withColumn("summary", F.coalesce(failed, "summary")).drop("error")


def document_files(
    corpus: DataFrame, model: Callable[[list[str], float], Sequence[str | None]], requested=None,
    max_kb: int = K.MAX_FILE_SIZE_KB, batch: int = 32,
) -> DataFrame:
    """Documentation of the (requested) files: ``repo, path, doc, error``, with a ``README.md`` row per repository.

    Languages are not filtered here; files that are too large are left out of the documents but stay in the README's
    file list.  Every repository with source files gets a README, requested or not; one without any gets an error row
    without path.  ``error`` is the model's error text, which the document shows as well.
    """
    listed = selection.with_language(selection.drop_vendored(selection.with_extension(corpus)))
    wanted = selection.restrict_paths(listed, requested)
    readable = selection.size_guard(wanted, max_kb)[0]
    asked = prompts.infer(prompts.doc_prompts(readable), model, prompts.TEMPERATURE["documentation"], batch=batch)
    docs = replies.parse_docs(asked.select("repo", "path", "error", "raw"))
    failed = F.concat(F.lit("_Documentation generation failed: "), F.col("error"), F.lit("_"))
    docs = docs.select("repo", "path", F.coalesce(failed, "doc").alias("doc"), "error")
    repos = listed.select("repo").distinct()
    readme = prompts.readme_prompts(wanted, readable, groups=repos)
    readme = prompts.infer(readme, model, prompts.TEMPERATURE["readme"], batch=batch)
    failed = F.concat(F.lit("# README\n\n_Generation failed: "), F.col("error"), F.lit("_"))
    readme = readme.select("repo", F.lit("README.md").alias("path"), F.coalesce("raw", failed, F.lit("")).alias("doc"), "error")
    bare = corpus.select("repo").distinct().join(repos, "repo", "left_anti")
    nothing = F.lit(None).cast("string")
    bare = bare.select("repo", nothing.alias("path"), nothing.alias("doc"), F.lit(K.NO_FILES_MESSAGE).alias("error"))
    return docs.unionByName(readme).unionByName(bare)

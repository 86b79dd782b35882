"""Every operator as a named query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Nested results are flattened or joined to text here so that they can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusreview import constants as K
from corpusreview.functions import paths as P
from corpusreview.functions import scores as S
from corpusreview.functions import text as T
from corpusreview.functions import urls as U
from corpusreview.operators import (
    issues as I,
    js_structure as JS,
    lines as L,
    metrics as M,
    prompts,
    py_structure as PY,
    quality as Q,
    replies,
    scoring,
    security as SEC,
    selection as SEL,
    smells as SM,
)
from corpusreview.plans import records as R
from corpusreview.plans import review
from corpusreview.session import fresh_folder
from corpusreview.sources import event_log, sinks, source_tree
from corpusreview.sources.locations import open_location
from corpusreview.streaming import jobs, progress, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(array: Column, by: str = ",") -> Column:
    return F.array_join(array, by)


# ---- scans, sources, sinks -------------------------------------------------------------------------------------------
def _export_pages(spark: SparkSession, sf_dir: str) -> str:
    """Write each page as a file of a source tree below the shared folder; returns its root."""
    root = fresh_folder(spark, "tree")
    pages = R.table(spark, sf_dir, "pages")

    def save(batches):
        import pandas as pd

        files, base = open_location(root)
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"]):
                folder = f"{base}/site{page_id % 7}/{'_pkg' if page_id % 2 else 'node_modules'}"
                files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/_{page_id}.js") as out:
                    out.write(html.replace("\n", "\r\n").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    # an action of its own: the files must exist before they are listed
    pages.mapInPandas(save, "n bigint").agg(F.sum("n")).write.format("noop").mode("overwrite").save()
    return root


@query
def scan_source_tree(spark, sf_dir):
    root = _export_pages(spark, sf_dir)
    files = source_tree.read_source_tree(spark, {"pages": root})
    return files.select("repo", "path", "size", "language", F.md5("content").alias("content_md5"), "skip_reason")


@query
def filter_extension(spark, sf_dir):
    return SEL.with_extension(R.source_files(spark, sf_dir)).select("repo", "path")


@query
def filter_vendored(spark, sf_dir):
    return SEL.drop_vendored(R.source_files(spark, sf_dir)).select("repo", "path")


@query
def size_guard(spark, sf_dir):
    return SEL.with_skip_reason(R.source_files(spark, sf_dir)).select("repo", "path", "size", "skip_reason")


@query
def decode_text(spark, sf_dir):
    """Texts with Windows and old Mac line ends, read back from bytes."""
    docs = R.table(spark, sf_dir, "documents", "doc_id", "text")
    raw = F.encode(F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")), "UTF-8")
    return docs.select("doc_id", F.md5(T.decode(raw)).alias("text_md5"))


@query
def parse_event_log(spark, sf_dir):
    return event_log.parse_records(R.event_records(spark, sf_dir), "run_id", "seq")


#: Seconds without an event that end a session of the sample's runs.
SESSION_SILENCE = 40_000


#: Folders over which written logs are dealt, so that no folder holds them all and none holds only one.
LOG_FOLDERS = 256


def _write_logs(spark, sf_dir, folder: str, share: float = 1.0) -> None:
    """One text log per run, its records in order, as far as the first ``share`` of its bytes.

    A task writes its logs one after the other, a piece at a time, and a log that is there is written anew: there is no
    listing, no folder and no move per log.
    """

    def save(batches):
        import zlib
        from itertools import groupby

        import pyarrow as pa

        files, base = open_location(folder)
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        logs = 0
        for run, parts in groupby(rows, key=lambda row: row[0]):
            path = f"{base}/{zlib.crc32(str(run).encode()) % LOG_FOLDERS:03}"
            files.create_dir(path, recursive=True)
            with files.open_output_stream(f"{path}/run={run}.log", buffer_size=1 << 16) as out:
                at = 0
                for _, size, part in parts:
                    out.write(part[: max(int(size * share) - at, 0)])
                    at += len(part)
            logs += 1
        yield pa.record_batch({"n": [logs]})

    files, base = open_location(folder)
    files.create_dir(base, recursive=True)  # is there without any log, too
    records = R.event_records(spark, sf_dir).selectExpr("run_id AS run", "seq", "CAST(coalesce(record, '') || '\n\n' AS BINARY) AS part")
    whole = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = records.withColumn("size", F.sum(F.octet_length("part")).over(whole)).sortWithinPartitions("run", "seq")
    sized.select("run", "size", "part").mapInArrow(save, "n bigint").agg(F.sum("n")).write.format("noop").mode("overwrite").save()


def _log_counts(events: DataFrame) -> DataFrame:
    run = F.regexp_extract("file", "run=([0-9]+)", 1).cast("bigint")
    return events.groupBy(run.alias("run_id"), "event").agg(
        F.count("*").alias("events"), F.sum(F.length("data")).alias("chars")
    )


@query
def scan_event_log(spark, sf_dir):
    """The same events through log files: one text log per run, written and read back by byte ranges."""
    folder = fresh_folder(spark, "log")
    _write_logs(spark, sf_dir, folder)
    return _log_counts(event_log.read_event_log(spark, folder.removeprefix("file:"), split_bytes=1 << 16))


@query
def follow_event_log(spark, sf_dir):
    """Log files that are followed while they grow: two fifths of each, then the rest, then nothing new."""
    folder, positions, checkpoint, target = (fresh_folder(spark, n) for n in ("log", "positions", "checkpoint", "events"))
    for share in (0.4, 1.0, None):
        if share:
            _write_logs(spark, sf_dir, folder, share)
        # the query is started again each time, and goes on where its checkpoint and positions say
        stream = event_log.read_event_log(spark, folder, positions=positions, shards=8)
        jobs.append_stream(stream, target, checkpoint)
    return _log_counts(spark.read.parquet(target))


@query
def report_json(spark, sf_dir):
    reviews = R.reviews(spark, sf_dir)
    return sinks.report_json(scoring.run_report(reviews, R.discovered(spark, sf_dir)), reviews)


def _runs(spark, sf_dir):
    return R.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS run_id", "'https://example.org/r' || CAST(c_custkey AS STRING) AS repo_url",
        "CAST(NULL AS STRING) AS branch",
    )


def _published_run(spark, sf_dir) -> str:
    """Publish reports, reviews and documents of all runs below the shared folder; returns where."""
    path = fresh_folder(spark, "published")
    reviews = R.reviews(spark, sf_dir)
    reports = scoring.with_address(scoring.run_report(reviews, R.discovered(spark, sf_dir)), _runs(spark, sf_dir))
    sinks.publish_run(reports, reviews, replies.parse_docs(R.doc_replies(spark, sf_dir)), path)
    return path


@query
def published_reports(spark, sf_dir):
    """Reports with their repository's address and their reviews, written together and read back."""
    path = _published_run(spark, sf_dir)
    reviews = sinks.published(spark, path, "reviews").groupBy("run_id").agg(
        F.count("*").alias("reviews"), F.sum(F.size("issues")).alias("issues"), F.max("file_path").alias("last_path")
    )
    reports = sinks.published(spark, path, "reports").filter("generated_at IS NOT NULL")
    return reports.join(reviews, "run_id", "left").select(
        "run_id", "repo_url", "total_files", "files_analyzed", "overall_score", "quality_label", "reviews", "issues", "last_path"
    )


@query
def published_docs(spark, sf_dir):
    """Documentation files, one folder per repository, read back from what was published."""
    docs = sinks.published(spark, _published_run(spark, sf_dir), "docs")
    return docs.select("repo", "path", "file_name", "status", F.md5("doc").alias("doc_md5"))


@query
def doc_file_names(spark, sf_dir):
    files = R.source_files(spark, sf_dir).select("repo", "path")
    named = sinks.with_doc_name(files)
    return named.withColumns({"base": P.basename(F.col("path")), "ext": P.extension(F.col("path"))})


@query
def event_rows(spark, sf_dir):
    reviews = R.reviews(spark, sf_dir)
    discovered = R.discovered(spark, sf_dir)
    runs = _runs(spark, sf_dir)
    counts = SEL.discovery_counts(discovered, by="run_id")
    size = (F.col("seq") * 37) % 60000
    review = F.struct(*[c for c in reviews.columns if c not in ("run_id", "seq")])
    files = reviews.select("*", review.alias("review"), F.col("file_path").alias("path"), size.alias("size"))
    files = SEL.with_skip_reason(files)
    report = scoring.run_report(files.filter("skip_reason IS NULL"))
    return sinks.to_event_json(runs, counts, files, report)


# ---- projections and filters -----------------------------------------------------------------------------------------
@query
def detect_language(spark, sf_dir):
    return SEL.with_language(R.source_files(spark, sf_dir)).select("repo", "path", "language")


@query
def filter_languages(spark, sf_dir):
    files = SEL.with_language(R.source_files(spark, sf_dir))
    return SEL.filter_languages(files, ["Python", "JAVA", "unknown"]).select("repo", "path", "language")


@query
def restrict_paths(spark, sf_dir):
    labelled = R.table(spark, sf_dir, "labels").selectExpr(f"{R.DOC_PATH} AS path")
    return SEL.restrict_paths(R.source_files(spark, sf_dir).select("repo", "path"), labelled)


def _issues(spark, sf_dir):
    return replies.flatten_issues(R.reviews(spark, sf_dir))


@query
def issues_by_severity(spark, sf_dir):
    return I.filter_issues(_issues(spark, sf_dir), severity="critical")


@query
def issues_by_category(spark, sf_dir):
    return I.filter_issues(_issues(spark, sf_dir), category="best-practice")


@query
def search_issues(spark, sf_dir):
    return I.search_issues(_issues(spark, sf_dir), " 100%_DONE")


@query
def invalid_reviews(spark, sf_dir):
    return replies.invalid_reviews(R.model_replies(spark, sf_dir))


@query
def valid_repo_urls(spark, sf_dir):
    return R.repo_urls(spark, sf_dir).withColumn("is_valid", U.is_repo_url(F.col("url")))


@query
def repo_slugs(spark, sf_dir):
    slug = U.repo_slug(F.col("url"))
    return R.repo_urls(spark, sf_dir).withColumn("slug", slug).withColumn("is_repo", F.col("slug").isNotNull())


# ---- lines and text --------------------------------------------------------------------------------------------------
@query
def explode_lines(spark, sf_dir):
    return L.explode_lines(R.analysed_files(spark, sf_dir))


@query
def truncate_text(spark, sf_dir):
    return L.truncate_text(R.analysed_files(spark, sf_dir)).select("repo", "path", "truncated")


@query
def line_counts(spark, sf_dir):
    return L.line_counts(R.analysed_files(spark, sf_dir))


@query
def text_samples(spark, sf_dir):
    text = F.col("content")
    return R.analysed_files(spark, sf_dir).select(
        "repo",
        "path",
        T.sample(text, K.DOC_SAMPLE_CHARS).alias("doc_sample"),
        T.sample(text, K.README_SAMPLE_CHARS).alias("readme_sample"),
        T.sample(text, K.MATCH_CHARS).alias("match_sample"),
        F.concat(T.sample(text, K.SUMMARY_CHARS), F.lit("…")).alias("summary_sample"),
    )


@query
def markdown_blocks(spark, sf_dir):
    return L.markdown_blocks(R.markdown_docs(spark, sf_dir))


# ---- smells and quality ----------------------------------------------------------------------------------------------
def _smell_query(name: str, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(R.analysed_files(spark, sf_dir))


_smell_query("smell_long_file", lambda df: SM.line_smell(df, SM.long_file))
_smell_query("smell_magic_number", lambda df: SM.line_smell(df, SM.magic_number))
_smell_query("smell_console_log", lambda df: SM.js_line_smell(df, SM.console_log))
_smell_query("smell_var_usage", lambda df: SM.js_line_smell(df, SM.var_usage))
_smell_query("smell_long_function", lambda df: SM.function_smell(df, SM.long_function))
_smell_query("smell_missing_docstring", lambda df: SM.function_smell(df, SM.missing_docstring))
_smell_query("smell_deep_nesting", lambda df: SM.function_smell(df, SM.deep_nesting))
_smell_query("all_smells", SM.all_smells)
_smell_query("quality_long_line", lambda df: Q.line_rule(df, Q.is_long_line))
_smell_query("quality_todo", lambda df: Q.line_rule(df, Q.has_todo))


@query
def code_quality(spark, sf_dir):
    out = Q.code_quality(R.analysed_files(spark, sf_dir))
    return out.withColumn("issues_detected", joined(F.col("issues_detected"), "\n"))


# ---- security and tools ----------------------------------------------------------------------------------------------
for _rule in SEC.rules_scanned():
    _smell_query(f"sec_{_rule}", lambda df, rule=_rule: SEC.security_rule(df, rule))
_smell_query("security_scan", SEC.security_scan)


@query
def sec_locations(spark, sf_dir):
    """Where rules match, over whole pages and documents as they are (no selection of files)."""
    files = R.doc_files(spark, sf_dir).unionByName(R.page_files(spark, sf_dir))
    return SEC.security_scan(files).groupBy("repo", "path", "type").agg(
        F.count("*").alias("matches"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )


@query
def refactoring_hints(spark, sf_dir):
    files = R.rendered_orders(spark, sf_dir).selectExpr("o_orderkey", "content", "CAST(o_orderkey % 9 AS INT) AS score")
    return Q.suggest_refactoring(files, "score", keys=("o_orderkey",))


@query
def element_name(spark, sf_dir):
    return R.analysed_files(spark, sf_dir).select("repo", "path", Q.element_name(F.col("content")).alias("name"))


@query
def element_params(spark, sf_dir):
    params = joined(Q.element_params(F.col("content")), "|")
    return R.analysed_files(spark, sf_dir).select("repo", "path", params.alias("params"))


@query
def docstring_templates(spark, sf_dir):
    calls = R.tool_calls(spark, sf_dir).filter(F.col("code").isNotNull())
    return calls.select(
        "call_id", "element_type", Q.docstring_template(F.col("code"), F.col("element_type")).alias("docstring")
    )


@query
def run_tools(spark, sf_dir):
    out = Q.run_tools(R.tool_calls(spark, sf_dir))
    vulnerabilities = F.transform(
        "vulnerabilities",
        lambda v: F.concat_ws("|", v["type"], v["line"].cast("string"), v["match"], v["description"]),
    )
    return out.select(
        "call_id", "tool", "status", "error", "docstring", "scan_status",
        F.col("quality.file_path").alias("file_path"),
        F.col("quality.language").alias("language"),
        F.col("quality.line_count").alias("line_count"),
        joined(F.col("quality.issues_detected"), "\n").alias("issues_detected"),
        F.col("quality.has_docstrings").alias("has_docstrings"),
        joined(vulnerabilities, "\n").alias("vulnerabilities"),
        joined(F.col("rules_scanned")).alias("rules_scanned"),
        joined(F.col("suggestions"), "\n").alias("suggestions"),
    )


# ---- structure and metrics -------------------------------------------------------------------------------------------
@query
def py_nodes(spark, sf_dir):
    nodes = PY.py_nodes(R.analysed_files(spark, sf_dir))
    return nodes.groupBy("repo", "path").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_nodes") for k in ("function", "class", "import", "branch")]
    )


@query
def py_functions(spark, sf_dir):
    out = PY.py_functions(R.analysed_files(spark, sf_dir))
    return out.select(
        "repo", "path", "name", "line", "end_line", "length", joined(F.col("args")).alias("args"), "has_docstring",
        "complexity", "nesting", "is_async",
    )


@query
def py_classes(spark, sf_dir):
    out = PY.py_classes(R.analysed_files(spark, sf_dir))
    return out.withColumns({"methods": joined(F.col("methods")), "bases": joined(F.col("bases"))})


@query
def py_imports(spark, sf_dir):
    return PY.py_imports(R.analysed_files(spark, sf_dir))


@query
def py_complexity(spark, sf_dir):
    out = PY.py_complexity(R.analysed_files(spark, sf_dir))
    return out.select("repo", "path", "function_count", "total_complexity", "avg_function_length")


@query
def py_nesting(spark, sf_dir):
    return PY.py_complexity(R.analysed_files(spark, sf_dir)).select("repo", "path", "max_nesting")


_smell_query("js_functions", JS.js_functions)
_smell_query("js_classes", JS.js_classes)
_smell_query("js_imports", JS.js_imports)
_smell_query("js_complexity", JS.js_complexity)
_smell_query("file_metrics", M.file_metrics)


@query
def language_breakdown(spark, sf_dir):
    return M.language_breakdown(R.discovered(spark, sf_dir), R.reviews(spark, sf_dir))


@query
def discovery_counts(spark, sf_dir):
    return SEL.discovery_counts(R.discovered(spark, sf_dir), ["python", "Java"], by="run_id")


# ---- prompts, model, replies -----------------------------------------------------------------------------------------
_smell_query("review_prompts", prompts.review_prompts)
_smell_query("doc_prompts", prompts.doc_prompts)


@query
def readme_prompts(spark, sf_dir):
    corpus = R.source_files(spark, sf_dir)
    listed = SEL.with_language(SEL.drop_vendored(SEL.with_extension(corpus)))
    return prompts.readme_prompts(listed, SEL.size_guard(listed)[0])


@query
def infer_stub(spark, sf_dir):
    def model(texts, temperature):
        """A deterministic stand-in: the score is the length of the prompt modulo 101."""
        return [f'{{"issues": [], "score": {len(t) % 101}, "summary": "{len(t)} characters"}}' for t in texts]

    return review.model_review(R.analysed_files(spark, sf_dir), model).drop("issues")


@query
def infer_ledger(spark, sf_dir):
    """Answers through a ledger: distinct prompts are asked once, those that failed once more by the next run.

    Files of one order kind share their prompt here.  The stand-in knows nothing but the prompt; in the first run it fails on
    one prompt of seven.
    """
    ledger = fresh_folder(spark, "ledger")
    texts = R.analysed_files(spark, sf_dir).select("repo", "path", F.concat(F.lit("Judge: "), F.left("content", F.lit(40))).alias("prompt"))

    def model(fails):
        def answers(prompts_, temperature):
            import hashlib

            marks = [hashlib.md5(p.encode()).hexdigest() for p in prompts_]
            if fails and any(int(m[:8], 16) % 7 == 0 for m in marks):
                raise ValueError("quota")
            return [f"{m} at {temperature}" for m in marks]

        return answers

    first = prompts.infer_ledger(texts, model(True), ledger)
    failed = first.filter("error IS NOT NULL").select("repo", "path", F.col("error").alias("first_error"))
    failed = failed.transform(lambda df: _kept(spark, df, "failed"))
    second = prompts.infer_ledger(texts, model(False), ledger)
    return second.join(failed, ["repo", "path"], "left").select("repo", "path", "raw", "error", "first_error")


def _kept(spark, df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder: what it shows does not change with what is done later."""
    folder = fresh_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@query
def generate_docs(spark, sf_dir):
    """Documents and read-mes of requested files; the stand-in fails on some prompts and says nothing to others."""

    def model(texts, temperature):
        import hashlib

        marks = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        if any(m[0] == "0" for m in marks):
            raise ValueError("quota")
        form = "# {}" if temperature == prompts.TEMPERATURE["readme"] else '{{"documentation": "doc {}"}}'
        return [None if m[0] == "1" else form.format(m) for m in marks]

    bare = R.table(spark, sf_dir, "region").selectExpr(
        "r_name AS repo", "'NOTES.txt' AS path", "CAST(length(r_name) AS BIGINT) AS size", "r_name AS content"
    )
    requested = R.table(spark, sf_dir, "labels").selectExpr(f"{R.DOC_PATH} AS path").distinct()
    return review.document_files(R.source_files(spark, sf_dir).unionByName(bare), model, requested)


def _issue_text(issues: Column) -> Column:
    fields = ("severity", "category", "file_path", "line_number", "description", "suggestion", "code_snippet")
    return joined(
        F.transform(
            issues, lambda i: F.concat_ws("|", *[F.coalesce(i[f].cast("string"), F.lit("-")) for f in fields])
        ),
        "\n",
    )


@query
def parse_reviews(spark, sf_dir):
    out = replies.parse_reviews(R.model_replies(spark, sf_dir))
    return out.withColumn("issues", _issue_text(F.col("issues")))


@query
def extract_issues(spark, sf_dir):
    return replies.extract_issues(R.model_replies(spark, sf_dir).drop("language"), keys=("run_id", "seq"))


@query
def parse_docs(spark, sf_dir):
    return replies.parse_docs(R.doc_replies(spark, sf_dir)).select("repo", "path", "status", "doc")


@query
def flatten_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


# ---- aggregations and rankings ---------------------------------------------------------------------------------------
@query
def severity_counts(spark, sf_dir):
    return scoring.severity_counts(R.reviews(spark, sf_dir))


@query
def overall_score(spark, sf_dir):
    return scoring.overall_score(R.reviews(spark, sf_dir), R.discovered(spark, sf_dir))


@query
def file_severity_counts(spark, sf_dir):
    return scoring.file_severity_counts(R.reviews(spark, sf_dir))


@query
def run_report(spark, sf_dir):
    return scoring.run_report(R.reviews(spark, sf_dir), R.discovered(spark, sf_dir))


@query
def fallback_stats(spark, sf_dir):
    events = R.review_events(spark, sf_dir)
    return scoring.fallback_stats(progress.reviews_of(events), progress.finished_runs(events))


@query
def category_breakdown(spark, sf_dir):
    return I.category_breakdown(_issues(spark, sf_dir))


@query
def category_share(spark, sf_dir):
    return I.category_share(_issues(spark, sf_dir))


@query
def score_distribution(spark, sf_dir):
    return I.score_distribution(R.reviews(spark, sf_dir))


@query
def issue_categories(spark, sf_dir):
    return I.issue_categories(_issues(spark, sf_dir))


@query
def issues_by_file(spark, sf_dir):
    return I.issues_by_file(_issues(spark, sf_dir), R.reviews(spark, sf_dir))


@query
def issues_in_file(spark, sf_dir):
    return I.issues_in_file(_issues(spark, sf_dir)).select(
        "run_id", "file_path", "position", "severity", "seq", "issue_no"
    )


@query
def shown_counts(spark, sf_dir):
    return I.shown_counts(_issues(spark, sf_dir), R.reviews(spark, sf_dir), severity="warning", term="needs")


@query
def severity_dim(spark, sf_dir):
    return I.with_severity_dim(_issues(spark, sf_dir)).select(
        "run_id", "seq", "issue_no", "severity", "severity_label", "severity_rank", "category", "known_category"
    )


@query
def file_index(spark, sf_dir):
    return I.file_index(R.review_events(spark, sf_dir))


@query
def worst_files(spark, sf_dir):
    return I.worst_files(R.reviews(spark, sf_dir))


@query
def live_feed(spark, sf_dir):
    return I.live_feed(R.reviews(spark, sf_dir))


@query
def issues_sorted_severity(spark, sf_dir):
    return I.sort_by_severity(_issues(spark, sf_dir)).select(
        "run_id", "position", "severity", "severity_rank", "seq", "issue_no", "file_path"
    )


@query
def issues_sorted_file(spark, sf_dir):
    return I.sort_by_file(_issues(spark, sf_dir)).select("run_id", "position", "file_path", "seq", "issue_no", "severity")


@query
def recent_items(spark, sf_dir):
    return I.recent_items(R.item_visits(spark, sf_dir))


# ---- scalar functions ------------------------------------------------------------------------------------------------
@query
def file_sizes(spark, sf_dir):
    """Sizes of files, and of files 300 times as large."""
    sizes = R.source_files(spark, sf_dir).select("repo", "path", "size")
    both = sizes.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") * 300)))
    return both.withColumn("size_text", S.file_size_text(F.col("size")))


@query
def score_classes(spark, sf_dir):
    return scoring.score_classes(R.reviews(spark, sf_dir))


# ---- progress and streams --------------------------------------------------------------------------------------------
@query
def run_progress(spark, sf_dir):
    return progress.run_progress(R.review_events(spark, sf_dir))


@query
def run_state(spark, sf_dir):
    return progress.run_state(R.review_events(spark, sf_dir))


@query
def stream_smells(spark, sf_dir):
    """Smells of documents, pages and rendered files as streams, written by a streaming query and read back."""
    target, checkpoint = fresh_folder(spark, "smells"), fresh_folder(spark, "checkpoint")

    def stream(name):
        return jobs.stream_table(spark, sf_dir, spark.read.parquet(f"{sf_dir}/{name}.parquet").schema, f"{name}.parquet")

    files = R.doc_rows(stream("documents")).unionByName(R.page_rows(stream("pages")))
    files = files.unionByName(R.code_rows(stream("orders"), once=True))
    jobs.stream_smells(SEL.analysed(files), target, checkpoint)
    return spark.read.parquet(target)


@query
def stream_severity(spark, sf_dir):
    """Issues per run and severity from a stream of events, kept by a streaming query and read back."""
    target, checkpoint = fresh_folder(spark, "severity"), fresh_folder(spark, "checkpoint")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = R.events_from(jobs.stream_table(spark, sf_dir, schema, "events.parquet"))
    jobs.update_stream(progress.stream_severity(events), target, checkpoint)
    return jobs.latest(spark, target, ["run_id", "severity"])


@query
def run_sessions(spark, sf_dir):
    """Sessions of runs by a state machine with timers over the stream of events, read back."""
    target, checkpoint = fresh_folder(spark, "sessions"), fresh_folder(spark, "checkpoint")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = R.events_from(jobs.stream_table(spark, sf_dir, schema, "events.parquet"))
    changes = sessions.run_sessions(events, SESSION_SILENCE)
    sessions.with_rocksdb(spark, lambda: jobs.upsert_stream(changes, target, checkpoint, ["run_id", "started"]))
    newest = jobs.current(spark, target, changes.schema)
    return newest.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last_at")})


# ---- whole reviews ---------------------------------------------------------------------------------------------------
@query
def static_report(spark, sf_dir):
    return review.static_report(R.source_files(spark, sf_dir))


@query
def static_categories(spark, sf_dir):
    """Issues of the model-free review per repository and category."""
    reviews = review.static_review(R.analysed_files(spark, sf_dir)).withColumn("seq", F.lit(0).cast("bigint"))
    return I.category_breakdown(replies.flatten_issues(reviews)).drop("rank")

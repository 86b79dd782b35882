"""Prompt tables for a batch model, and the call of the model itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpusreview import constants as K
from corpusreview.functions import text as T
from corpusreview.operators.lines import truncate_text
from corpusreview.operators.metrics import SCALARS, with_metrics
from corpusreview.sources.locations import open_location

# sampling temperatures per kind of request (fixed values)
TEMPERATURE = {"review": 0.2, "tools": 0.1, "documentation": 0.3, "readme": 0.4}


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _fenced(code: Column, language: Column | str = "") -> Column:
    return _concat("```", language, "\n", code, "\n```")


def review_prompts(files: DataFrame, keys=("repo", "path", "language")) -> DataFrame:
    """One prompt per file: path, metrics, smells and the first lines of the code.

    Metrics and smells describe the whole file although the code is cut.  All parts are computed in the file's own row,
    so neither the text nor the prompt is ever joined or shuffled.
    """
    metric_lines = F.concat_ws("\n", *[_concat(f"  - {m}: ", F.col(m).cast("string")) for m in SCALARS])
    smell_lines = F.array_join(
        F.transform(
            "smells", lambda s: _concat("  - [", s["severity"], "] L", s["line"].cast("string"), ": ", s["description"])
        ),
        "\n",
    )
    prompt = _concat(
        "Review this ", F.col("language"), " file and answer with one JSON review object.\n\nFile: ", F.col("path"),
        "\n\nMetrics of the whole file:\n", metric_lines,
        "\n\nSmells found by static rules:\n", F.when(F.size("smells") > 0, smell_lines).otherwise("  (none detected)"),
        "\n\nCode:\n", _fenced(F.col("truncated"), F.col("language")),
        "\n\nJudge readability, bugs, security, performance and conventions. Give a score from 0 to 100.",
    )
    return with_metrics(truncate_text(files)).select(*keys, prompt.alias("prompt"))


def doc_prompts(files: DataFrame, keys=("repo", "path", "language")) -> DataFrame:
    prompt = _concat(
        "Write Markdown documentation for this ", F.col("language"), " file: ", F.col("path"),
        "\n\nCover its purpose, every function and class with parameters and results, examples and caveats.\n\n",
        _fenced(F.col("truncated"), F.col("language")),
    )
    return truncate_text(files).select(*keys, prompt.alias("prompt"))


def readme_prompts(
    listed: DataFrame, readable: DataFrame, by: str = "repo", groups: DataFrame | None = None,
    tree_files: int = K.README_TREE_FILES, sample_files: int = K.README_SAMPLES, sample_chars: int = K.README_SAMPLE_CHARS,
) -> DataFrame:
    """One prompt per repository: its first 50 files by path, and the start of its first 5 readable files.

    ``groups`` (distinct values of ``by``) names repositories that get a prompt even if none of their files is listed.

    Both lists are cut by rank inside the partitions before anything is shuffled, so a repository of any size sends at
    most 50 short rows and 5 samples per partition.
    """
    w = W.partitionBy(by).orderBy("path")

    def first(df: DataFrame, n: int, line: Column, into: str) -> DataFrame:
        top = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
        pairs = F.sort_array(F.collect_list(F.struct("_n", line.alias("line"))))
        return top.groupBy(by).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias(into))

    entry = _concat("- ", F.col("path"), " (", F.col("language"), ", ", F.col("size").cast("string"), " bytes)")
    tree = first(listed.select(by, "path", "language", "size"), tree_files, entry, "_tree")
    if groups is not None:
        tree = groups.select(by).join(tree, by, "left").na.fill("", ["_tree"])
    start = readable.select(by, "path", T.sample(F.col("content"), sample_chars).alias("_start"))
    shown = _concat("### ", F.col("path"), "\n", _fenced(F.col("_start")))
    samples = first(start, sample_files, shown, "_samples")
    prompt = _concat(
        "Write a README for a repository with these files:\n\n", F.col("_tree"),
        "\n\nStarts of some files:\n\n", F.coalesce("_samples", F.lit("")),
        "\n\nInclude title, features, installation, usage, structure, contributing and licence sections.",
    )
    return tree.join(samples, by, "left").select(by, prompt.alias("prompt"))


def asker(model: Callable[[list[str], float], Sequence[str | None]], temperature: float):
    """Function that answers a list of prompts with ``(answer, error)`` pairs; see ``infer``."""

    def ask(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            raw = list(model(texts, temperature))
            if len(raw) != len(texts):
                raise ValueError("one answer per prompt expected")
            return [(r, None) for r in raw]
        except Exception as exc:  # noqa: BLE001 - any model failure becomes a row
            if len(texts) == 1:
                return [(None, f"{type(exc).__name__}: {exc}")]
            half = len(texts) // 2
            return ask(texts[:half]) + ask(texts[half:])

    return ask


def infer(
    df: DataFrame,
    model: Callable[[list[str], float], Sequence[str | None]],
    temperature: float = TEMPERATURE["review"],
    prompt: str = "prompt",
    batch: int = 32,
) -> DataFrame:
    """Add ``raw`` and ``error``: the model's answer to each prompt.

    ``model(prompts, temperature)`` answers at most ``batch`` prompts at a time.  When a call fails its halves are tried;
    a single prompt that fails gets a NULL answer and the error text, never a failed job.  Only prompts travel to Python.
    """

    ask = asker(model, temperature)

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = [r for start in range(0, len(prompts), batch) for r in ask(list(prompts[start : start + batch]))]
            yield pd.DataFrame(rows, columns=["raw", "error"])

    # a model call is dear: a nondeterministic function is not repeated or moved by the optimizer
    udf = F.pandas_udf(answers, "raw string, error string").asNondeterministic()
    return df.withColumn("_answer", udf(F.col(prompt))).select("*", "_answer.*").drop("_answer")


#: Hex digits of a prompt's digest that name its bucket; a task works on whole buckets.
BUCKET_DIGITS = 2
ANSWER = "key string, raw string, error string, asked_at bigint"


def prompt_key(prompt: Column, temperature: float) -> Column:
    """Digest of a prompt and the temperature it is asked at; null for a null prompt."""
    return F.sha2(F.concat(F.lit(f"{temperature}:"), prompt), 256)


def ledger_answers(spark: SparkSession, ledger: str) -> DataFrame:
    """``key, raw, error``: one answer for each prompt of a ledger; an answer goes before an error, then the oldest."""
    files, base = open_location(ledger)
    files.create_dir(base, recursive=True)
    written = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(ledger)
    best = F.min_by(F.struct("raw", "error"), F.struct(F.col("error").isNotNull(), "asked_at", "raw"))
    return written.groupBy("key").agg(best.alias("a")).select("key", "a.*")


def ask_missing(
    prompts: DataFrame, model: Callable[[list[str], float], Sequence[str | None]], ledger: str, temperature: float, batch: int = 32
) -> DataFrame:
    """Ask the model every distinct prompt of ``key, prompt`` without an answer in the ledger; ``bucket, asked, failed``.

    Prompts come in buckets of their key, and each batch of answers is a file of its bucket, moved into place when it is
    complete.  A task looks into its buckets before it asks, so a task that runs again after a lost executor, or a whole run
    after a failure, asks only what has no answer yet.  Errors are written too, and are asked again by the next run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, base = open_location(ledger)
        ask = asker(model, temperature)
        known: dict[str, set] = {}

        def answered(bucket: str) -> set:
            folder = f"{base}/{bucket}"
            files.create_dir(folder, recursive=True)
            keys: set = set()
            for info in files.get_file_info(fs.FileSelector(folder)):
                if info.base_name.endswith(".parquet") and not info.base_name.startswith((".", "_")):
                    table = pq.read_table(info.path, columns=["key", "error"], filesystem=files)
                    keys.update(k for k, e in zip(table["key"].to_pylist(), table["error"].to_pylist()) if e is None)
            return keys

        def save(bucket: str, rows: list[tuple]) -> None:
            columns = list(zip(*rows))
            types = (pa.string(), pa.string(), pa.string(), pa.int64())
            table = pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "raw", "error", "asked_at"])
            name = uuid.uuid4().hex
            pq.write_table(table, f"{base}/{bucket}/.{name}", filesystem=files)
            files.move(f"{base}/{bucket}/.{name}", f"{base}/{bucket}/{name}.parquet")

        for frame in batches:
            counts = []
            for bucket, rows in frame.groupby("bucket", sort=True):
                if bucket not in known:
                    known.clear()  # buckets come sorted
                    known[bucket] = answered(bucket)
                todo = rows[~rows["key"].isin(known[bucket])].drop_duplicates("key")
                failed = 0
                for start in range(0, len(todo), batch):
                    part = todo.iloc[start : start + batch]
                    answers = ask(list(part["prompt"]))
                    now = time.time_ns() // 1_000_000
                    save(bucket, [(k, raw, error, now) for k, (raw, error) in zip(part["key"], answers)])
                    failed += sum(error is not None for _, error in answers)
                known[bucket].update(todo["key"])
                counts.append((bucket, len(todo), failed))
            yield pd.DataFrame(counts, columns=["bucket", "asked", "failed"])

    bucket = F.left("key", F.lit(BUCKET_DIGITS))
    answered_keys = ledger_answers(prompts.sparkSession, ledger).filter("error IS NULL").select("key")
    missing = prompts.filter("key IS NOT NULL").dropDuplicates(["key"]).join(answered_keys, "key", "left_anti")
    dealt = missing.select(bucket.alias("bucket"), "key", "prompt").repartition("bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInPandas(run, "bucket string, asked bigint, failed bigint").groupBy("bucket").agg(
        F.sum("asked").alias("asked"), F.sum("failed").alias("failed")
    )


def infer_ledger(
    df: DataFrame,
    model: Callable[[list[str], float], Sequence[str | None]],
    ledger: str,
    temperature: float = TEMPERATURE["review"],
    prompt: str = "prompt",
    batch: int = 32,
) -> DataFrame:
    """``infer`` with a ledger of answers, a folder that all executors share: each distinct prompt is asked once, for ever.

    Rows with equal prompts get one answer; a null prompt gets none.  The prompts that lack an answer are asked when this is
    called; the result joins rows and answers by digest.  A ledger serves any number of runs and tables.
    """
    keyed = df.withColumn("_key", prompt_key(F.col(prompt), temperature))
    asked = ask_missing(keyed.select(F.col("_key").alias("key"), F.col(prompt).alias("prompt")), model, ledger, temperature, batch)
    asked.write.format("noop").mode("overwrite").save()
    answers = ledger_answers(df.sparkSession, ledger).withColumnRenamed("key", "_of")
    return keyed.join(answers, F.col("_key") == F.col("_of"), "left").drop("_key", "_of")

"""Source files from directory trees.

Spark's own file sources hide names that start with ``_`` or ``.``, which drops ``__init__.py``; so trees are listed by
tasks of their own.  The listing carries names and sizes only, is filtered first, and files are opened afterwards by
tasks balanced over all files - a huge repository does not stay with the task that listed it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusreview import constants as K
from corpusreview.functions import paths
from corpusreview.functions import text as T
from corpusreview.operators import selection
from corpusreview.session import fresh_folder
from corpusreview.sources.locations import open_location

LISTING = "repo string, root string, path string, size bigint, is_dir boolean, gone boolean"
GONE_REASON = "Folder vanished while it was listed"
#: Entries that a task lists below each folder it is given before it hands the folders left over to other tasks; folders
#: that a task is given; bytes and files that a task opens.
WALK_ENTRIES = 20_000
TASK_FOLDERS = 16
TASK_BYTES = 64 << 20
TASK_FILES = 20_000


def _lister(budget: int):
    """Task function: folders become what is in and below them, up to ``budget`` entries; then folders stay folders.

    A missing root fails.  A folder that vanishes below a root that exists becomes a row marked ``gone``.
    """

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import pandas as pd
        from pyarrow import fs

        names = ["repo", "root", "path", "size", "is_dir", "gone"]

        def inside(root, path):
            files, base = open_location(root)
            local = isinstance(files, fs.LocalFileSystem)
            todo, seen = [f"{base}/{path}".rstrip("/")], 0
            while todo and seen < budget:
                folder = todo.pop()
                try:
                    entries = files.get_file_info(fs.FileSelector(folder or "/"))
                except FileNotFoundError:
                    if folder == base:
                        raise
                    yield folder[len(base) + 1 :], 0, False, True
                    continue
                seen += len(entries) + 1
                for info in entries:
                    is_dir = info.type == fs.FileType.Directory
                    if is_dir and local and os.path.islink(info.path):
                        continue  # folders behind symbolic links are not followed
                    if is_dir:
                        todo.append(info.path)
                    elif info.type == fs.FileType.File:
                        yield info.path[len(base) + 1 :], info.size or 0, False, False
            for folder in todo:
                yield folder[len(base) + 1 :], 0, True, False

        for batch in batches:
            rows = []
            for repo, root, path in batch[["repo", "root", "path"]].itertuples(index=False):
                for entry in inside(root, path):
                    rows.append((repo, root, *entry))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return listing


def list_source_tree(roots: DataFrame, budget: int = WALK_ENTRIES) -> DataFrame:
    """All regular files below each root: ``repo, root, path, size, gone`` (``gone``: a folder that vanished meanwhile).

    ``roots`` has ``repo`` and ``root`` (a path or URI that executors can reach).  The listing goes on in rounds: a task walks
    down from its folders until it has seen ``budget`` entries below one, and the folders that are left are dealt anew.  So
    tasks follow what is found - however deep and uneven the trees are and however many cores there are.  Each round is
    written to the shared folder, so that folders are listed once.
    """
    spark = roots.sparkSession
    frontier = roots.select("repo", "root", F.lit("").alias("path"))
    rounds = []
    while True:
        folders = frontier.count()
        if not folders and rounds:
            break
        dealt = frontier.repartition(max(1, -(-folders // TASK_FOLDERS)), "repo", "path")
        where = fresh_folder(spark, "listing")
        dealt.mapInPandas(_lister(budget), LISTING).write.parquet(where)
        rounds.append(spark.read.schema(LISTING).parquet(where))
        frontier = rounds[-1].filter("is_dir").select("repo", "root", "path")
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionAll(more)
    return found.filter("NOT is_dir").select("repo", "root", "path", "size", "gone")


def read_contents(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """Open the listed files that have no ``skip_reason``: adds ``content`` (decoded text).

    Files are spread evenly over tasks of about ``TASK_BYTES`` and at most ``TASK_FILES`` each first.  A file that is not there, not permitted or a folder has NULL content and
    gets the reason; any other failure to read fails the task, so that Spark tries it again.
    """
    if tasks is None:
        n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("skip_reason").isNull(), F.col("size"))), F.lit(0))).first()
        tasks = max(1, -(-n // TASK_FILES), -(-size // TASK_BYTES))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def load(root, path, skip_reason):
            if skip_reason is not None:
                return None
            try:
                files, base = open_location(root)
                with files.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    return stream.read()
            except (FileNotFoundError, PermissionError, IsADirectoryError):
                return None

        for batch in batches:
            # a few files at a time: a batch of names must not become a batch of whole texts in memory
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                raw = [load(*row) for row in zip(part["root"], part["path"], part["skip_reason"])]
                yield part.assign(raw=raw)

    slim = listed.select("repo", "root", "path", "size", "language", "skip_reason").repartition(tasks, "repo", "path")
    schema = "repo string, root string, path string, size bigint, language string, skip_reason string, raw binary"
    read = slim.mapInPandas(opened, schema).withColumn("content", T.decode(F.col("raw")))
    reason = F.when(F.col("raw").isNull(), F.coalesce("skip_reason", F.lit(K.SKIP_REASON)))
    return read.withColumn("skip_reason", reason).drop("raw")


def read_source_tree(
    spark: SparkSession, roots, extensions=tuple(K.LANGUAGE_BY_EXTENSION), max_kb: int = K.MAX_FILE_SIZE_KB
) -> DataFrame:
    """``repo, path, size, language, content, skip_reason`` of the source files below the roots.

    ``roots`` is a DataFrame of ``repo, root`` or a dict.  Extension, folder and size tests come before any file is
    opened; files that are too large or cannot be read have NULL content and a reason.
    """
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame(list(roots.items()), "repo string, root string")
    listed = list_source_tree(roots)
    wanted = F.col("gone") | paths.has_extension(F.col("path"), extensions) & ~paths.is_vendored(F.col("path"))
    marked = selection.with_skip_reason(selection.with_language(listed.filter(wanted)), max_kb)
    marked = marked.withColumn("skip_reason", F.when(F.col("gone"), F.lit(GONE_REASON)).otherwise(F.col("skip_reason")))
    return read_contents(marked).select("repo", "path", "size", "language", "content", "skip_reason")

"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "corpusreview", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with; keyword ``conf`` uses ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # a later duplicate key of a JSON object wins, as in the usual JSON readers
        .config("spark.sql.variant.allowDuplicateKeys", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Root of the folder every executor can reach: ``spark.checkpoint.dir``, set here only where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine, as in tests
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusreview-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A new, empty sub-folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

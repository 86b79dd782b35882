"""Streaming runs of the operators: files or events arrive, tables are kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corpusreview.operators import smells
from corpusreview.sources.locations import open_location


def stream_table(
    spark: SparkSession, folder: str, schema: StructType | str, name: str = "*", files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _when(every: str | None) -> dict:
    """Trigger of a stream: at the given interval (``"10 seconds"``) for ever, or once over what is there now."""
    return {"processingTime": every} if every else {"availableNow": True}


def append_stream(stream: DataFrame, target: str, checkpoint: str, wait: bool = True, every: str | None = None):
    """Write a stateless stream as Parquet, exactly once: what is there now, or ``every`` so often until it is stopped."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**_when(every))
        .start(target)
    )
    if wait:
        query.awaitTermination()
    return query


def update_stream(stream: DataFrame, target: str, checkpoint: str, wait: bool = True, every: str | None = None):
    """Write the changed rows of a streaming aggregate, one folder per micro-batch.

    A repeated micro-batch overwrites its own folder, so a restart after a lost executor or driver adds nothing twice.
    With ``every`` the stream keeps running; give the stream a watermark on its event time to let old state go.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**_when(every))
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def compact(spark: SparkSession, source: str, target: str, keys: list[str]) -> None:
    """Write the current rows of an ``update_stream`` table as a table of one version, so that reads stay short."""
    newest = spark.read.option("basePath", source).parquet(source).agg(F.max("batch_id")).first()[0]
    latest(spark, source, keys).write.mode("overwrite").parquet(f"{target}/batch_id={newest}")


def latest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Current rows of a table written by ``update_stream``: the newest version per key."""
    versions = spark.read.option("basePath", target).parquet(target)
    values = [c for c in versions.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return versions.groupBy(*keys).agg(newest).select(*keys, "v.*")


_BUCKET = "_bucket"


def merge_rows(changes: DataFrame, batch_id: int, target: str, keys: list[str], buckets: int) -> None:
    """Put the changed rows of one batch in the place of the current rows with their keys.

    Current rows lie in buckets of their keys.  The buckets that a batch touches are written anew, as version ``batch_id``;
    a manifest names the version of each bucket and is written last, so readers see a whole batch or none.  A batch that is
    repeated starts from the manifest before it and writes the same.  What neither this manifest nor the one before names
    is removed.
    """
    spark = changes.sparkSession
    columns = changes.columns
    bucketed = changes.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    before = _manifest(spark, target, batch_id)
    touched = [r[0] for r in bucketed.select(_BUCKET).distinct().collect()]  # no more than there are buckets
    kept = [f"{target}/v={before[b]}/{_BUCKET}={b}" for b in touched if b in before]
    rows = bucketed.select(_BUCKET, *columns, F.lit(1).alias("_newer"))
    if kept:
        old = spark.read.option("basePath", target).schema(changes.schema).parquet(*kept).select(*columns)
        old = old.withColumn(_BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = rows.unionByName(old.withColumn("_newer", F.lit(0)))
    values = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*values) if values else F.lit(0), "_newer").alias("_v")
    merged = rows.groupBy(_BUCKET, *keys).agg(newest).select(_BUCKET, *keys, *([F.col("_v.*")] if values else [])).select(_BUCKET, *columns)
    merged.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{target}/v={batch_id}")
    after = before | {b: batch_id for b in touched}
    entries = spark.createDataFrame(list(after.items()), f"{_BUCKET} int, version bigint")
    entries.coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={batch_id}")
    _remove_unnamed(target, set(before.values()) | set(after.values()), batch_id)


def _batches(target: str, folder: str, prefix: str) -> list[int]:
    from pyarrow import fs

    files, base = open_location(target)
    found = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
    names = [i.base_name.removeprefix(prefix) for i in found if i.base_name.startswith(prefix)]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """Version of each bucket, as of the newest manifest or of the newest one before a batch."""
    known = [b for b in _batches(target, "manifest", "batch=") if below is None or b < below]
    for batch in reversed(known):
        files, base = open_location(target)
        if files.get_file_info(f"{base}/manifest/batch={batch}/_SUCCESS").is_file:
            return {r[0]: r[1] for r in spark.read.parquet(f"{target}/manifest/batch={batch}").collect()}
    return {}


def _remove_unnamed(target: str, named: set[int], batch_id: int) -> None:
    files, base = open_location(target)
    for version in _batches(target, "", "v="):
        if version not in named and version < batch_id:
            files.delete_dir(f"{base}/v={version}")
    for batch in _batches(target, "manifest", "batch=")[:-2]:
        files.delete_dir(f"{base}/manifest/batch={batch}")


def upsert_stream(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], buckets: int = 16, wait: bool = True, every: str | None = None
):
    """Keep the current rows of a streaming aggregate in a table of buckets; see ``merge_rows`` and ``current``.

    Reads cost the same after one batch and after a million, and a batch costs what its buckets hold.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # its keys and its rows are asked for
        try:
            merge_rows(kept, batch_id, target, keys, buckets)
        finally:
            kept.unpersist()

    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(**_when(every)).start()
    )
    if wait:
        query.awaitTermination()
    return query


def current(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The current rows of a table kept by ``upsert_stream``."""
    paths = [f"{target}/v={version}/{_BUCKET}={bucket}" for bucket, version in _manifest(spark, target).items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def stream_smells(
    files: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d,
    every: str | None = None,
):
    """Smells of files as they arrive; the same stateless operators as on a table.  ``every`` keeps the stream running."""
    return append_stream(smells.all_smells(prepare(files)), target, checkpoint, wait=every is None, every=every)

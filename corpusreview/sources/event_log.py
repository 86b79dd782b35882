"""Event logs: text records split by blank lines, each with ``event:`` and ``data:`` lines."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from corpusreview import constants as K
from corpusreview.functions import text as T
from corpusreview.functions.arrays import computed_once
from corpusreview.sources import locations
from corpusreview.sources.locations import open_location

# executors receive the classes below by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(locations)

SEPARATOR = b"\n\n"
#: Ranges share tasks so that there are no more than twice so many, unless these would read more than so many bytes each.
TASKS = 256
TASK_BYTES = 64 * 1024 * 1024
RECORD = "file string, start bigint, record string"


class EventLogPart(InputPartition):
    """Byte ranges ``(file, begin, end)`` that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class EventLogReader(DataSourceReader):
    """Byte ranges of the log files; a record belongs to the range in which it starts.

    ``start`` - the record's byte offset - is its arrival order inside the file.  A record without a closing blank
    line is incomplete and is not returned.  A range that finds no separator stops at its end; a record of more than
    ``recordbytes`` is not held in memory: it fails the read if it is ever closed.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", 64 * 1024 * 1024))
        self.chunk = int(options.get("chunkbytes", 1024 * 1024))
        self.record_bytes = int(options.get("recordbytes", 64 * 1024 * 1024))

    def found(self):
        """All log files with their sizes."""
        from pyarrow import fs

        files, inner = open_location(self.path)
        info = files.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        prefix = self.path[: len(self.path.rstrip("/")) - len(inner)] if "://" in self.path else ""
        inside = files.get_file_info(fs.FileSelector(inner, recursive=True))
        # names that start with "." or "_" are the writers' own files, as for Spark's file sources
        return [
            (prefix + i.path, i.size)
            for i in inside
            if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))
        ]

    def partitions(self):
        # large files are split; small files and ranges share a task, so the tasks do not grow with the files
        found = sorted(self.found())
        task_bytes = max(self.split_bytes, min(-(-sum(size for _, size in found) // TASKS), TASK_BYTES))
        parts, open_bytes = [], task_bytes
        for file, size in found:
            for begin in range(0, size, self.split_bytes):
                end = min(begin + self.split_bytes, size)
                if open_bytes + end - begin > task_bytes:
                    parts.append([])
                    open_bytes = 0
                parts[-1].append((file, begin, end))
                open_bytes += end - begin
        return [EventLogPart(ranges) for ranges in parts or [[]]]

    def read(self, partition):
        for file, begin, end in partition.ranges:
            yield from self.records(file, begin, end)

    def records(self, file, begin, end):
        """Records that start in ``begin <= offset < end``, read in chunks."""
        files, inner = open_location(file)
        with files.open_input_file(inner) as stream:
            # step back to before the line breaks at the range's begin, so that separators are cut as from the start
            position = begin
            while position > 0:
                stream.seek(position - 1)
                if stream.read(1) != b"\n":
                    break
                position -= 1
            stream.seek(position)
            buffer, at, started, dropped = b"", 0, position == 0, False
            while position < end or not started:
                cut = buffer.find(SEPARATOR, at)
                if cut < 0:
                    # what may be the first half of a separator is searched again
                    seen = len(buffer) - at
                    if not started and position + seen > end:
                        return  # no record starts in this range
                    if not started or seen > self.record_bytes:
                        skip = max(seen - 1, 0)
                        dropped = dropped or started
                        position, at = position + skip, at + skip
                    wanted = self.chunk if started else min(self.chunk, end - position + len(SEPARATOR))
                    more = stream.read(wanted)
                    if not more:
                        return
                    buffer, at = buffer[at:] + more, 0
                    continue
                if dropped:
                    raise ValueError(f"{file}: a record before byte {position} is longer than {self.record_bytes} bytes")
                if started and position >= begin:
                    yield file, position, buffer[at:cut].decode("utf-8", "replace")
                position += cut + len(SEPARATOR) - at
                at, started = cut + len(SEPARATOR), True


class EventLogShard(InputPartition):
    """The files whose names hash to ``shard``, from the positions of one offset to those of the next."""

    def __init__(self, shard: int, start: int, end: int):
        self.shard, self.start, self.end = shard, start, end


class EventLogStreamReader(DataSourceStreamReader):
    """Records of log files that grow, and of files that appear, each exactly once.

    The driver counts offsets and knows no file.  A task owns the files whose names hash to its shard: it lists them, looks
    up how far each has been read, plans up to the last complete record of each, writes the plan below ``positions`` (a
    folder that all executors share) and reads.  A task that runs again finds the plan and reads the same bytes.  An end
    marker ends its file: what is written behind it later is not read.  Files that vanish are forgotten.
    """

    def __init__(self, options):
        self.reader = EventLogReader(options)
        self.positions = options["positions"]
        self.shards = int(options.get("shards", 32))
        self.last = 0

    def initialOffset(self):
        return {"at": 0}

    def latestOffset(self):
        import time

        self.last = max(time.time_ns() // 1_000_000, self.last + 1)
        return {"at": self.last}

    def partitions(self, start, end):
        return [EventLogShard(i, int(start["at"]), int(end["at"])) for i in range(self.shards)]

    def read(self, partition):
        files, base = open_location(self.positions)
        folder = f"{base}/shard={partition.shard}"
        files.create_dir(folder, recursive=True)
        plan = self._stored(files, f"{folder}/{partition.end}.plan")
        if plan is None:
            before = {}
            if partition.start:
                before = self._stored(files, f"{folder}/{partition.start}.done")
                if before is None:
                    raise ValueError(f"{folder} has no positions of offset {partition.start}")
            plan = self._planned(partition.shard, before)
            self._store(files, f"{folder}/{partition.end}.plan", plan)
        done = {}
        for file, (begin, end, ended) in sorted(plan.items()):
            if end > begin and not ended:
                for record in self.reader.records(file, begin, end):
                    yield record
                    ended = self._is_end(record[2])
                    if ended:
                        break
            done[file] = (end, ended)
        self._store(files, f"{folder}/{partition.end}.done", done)
        self._forget(files, folder, partition.start)

    def commit(self, end):
        pass

    def stop(self):
        pass

    def _planned(self, shard, before):
        """For each file of the shard the bytes to read, and whether its log has ended."""
        import zlib

        plan = {}
        for file, size in self.reader.found():
            if zlib.crc32(file.encode()) % self.shards == shard:
                begin, ended = before.get(file, (0, False))
                # a file without new bytes is not opened
                plan[file] = (begin, begin if ended or size <= begin else self._complete(file, begin, size), ended)
        return plan

    def _complete(self, file, begin, size):
        """Where the last separator before ``size`` ends, cut as a reader from the start cuts it; ``begin`` if there is none.

        A run of line breaks gives a separator for each two of them, so the whole run is looked at.
        """
        files, inner = open_location(file)
        with files.open_input_file(inner) as stream:
            tail, at = b"", size
            while at > begin:
                step = min(self.reader.chunk, at - begin)
                stream.seek(at - step)
                tail = stream.read(step) + tail
                at -= step
                cut = tail.rfind(SEPARATOR)
                if cut >= 0 and (at == begin or tail[: cut + 2].strip(b"\n")):
                    first = cut
                    while first and tail[first - 1 : first] == b"\n":
                        first -= 1
                    return at + first + (cut + 2 - first) // 2 * 2
                if cut < 0:
                    tail = tail[:1]  # may be the second half of a separator
        return begin

    @staticmethod
    def _is_end(record):
        """Whether a record has an end marker: a ``data:`` line with nothing else."""
        lines = (line.strip() for line in record.split("\n"))
        return any(x.startswith("data:") and x[5:].strip() == K.END_OF_LOG for x in lines)

    @staticmethod
    def _stored(files, path):
        import json

        try:
            with files.open_input_file(path) as stream:
                return {file: tuple(entry) for file, entry in json.loads(stream.read()).items()}
        except FileNotFoundError:
            return None

    @staticmethod
    def _store(files, path, entries):
        """Write a file under another name and move it, so that it is there whole or not at all."""
        import json
        import uuid

        parts = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(parts) as stream:
            stream.write(json.dumps(entries).encode())
        files.move(parts, path)

    @staticmethod
    def _forget(files, folder, start):
        """Positions older than the offset from which this batch started are never asked for again."""
        from pyarrow import fs

        for info in files.get_file_info(fs.FileSelector(folder)):
            offset = info.base_name.split(".")[0]
            if offset.isdigit() and int(offset) < start:
                files.delete_file(info.path)


class EventLogSource(DataSource):
    @classmethod
    def name(cls):
        return "event_log"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return EventLogReader(self.options)

    def streamReader(self, schema):
        return EventLogStreamReader(self.options)


def parse_records(records: DataFrame, group: str = "file", order: str = "start", record: str = "record") -> DataFrame:
    """``group, order, event, data`` of text records.

    The last ``event:`` and the last well-formed ``data:`` line of a record count; a record without data, or with a
    JSON null, is dropped; an end marker ends its group and so drops the rest of it.
    """
    # end markers are rare: they are found in the text alone, without a look at any JSON
    lines = _lines(record)
    marked = records.filter(F.col(record).contains(K.END_OF_LOG)).select(group, order, lines.alias("_lines"))
    ended = marked.filter(F.array_contains(_after("data:"), K.END_OF_LOG))
    ends = ended.groupBy(group).agg(F.min(order).alias("_end_at"))
    parsed = _fields(records, group, order, record)
    kept = parsed.join(ends, group, "left").filter(F.col("_end_at").isNull() | (F.col(order) < F.col("_end_at")))
    return _with_data(kept).select(group, order, "event", "data")


def parse_open_records(records: DataFrame, group: str = "file", order: str = "start", record: str = "record") -> DataFrame:
    """``parse_records`` of records whose source has left out what follows an end marker; row by row, so for streams too."""
    return _with_data(_fields(records, group, order, record)).select(group, order, "event", "data")


def _lines(record: str):
    return F.transform(F.split(F.col(record), "\n", -1), T.strip)


def _after(mark: str):
    hits = F.filter("_lines", lambda x: x.startswith(mark))
    return F.transform(hits, lambda x: T.strip(F.substring(x, len(mark) + 1, 2147483647)))


def _fields(records: DataFrame, group: str, order: str, record: str) -> DataFrame:
    split = records.select(group, order, _lines(record).alias("_lines"))
    # an "event:" line is tested first, so a line is never both
    fields = split.select(group, order, _after("event:").alias("_events"), _after("data:").alias("_data"))
    json = F.filter("_data", lambda x: (x != K.END_OF_LOG) & _well_formed(x))
    return computed_once(
        fields,
        [group, order],
        event=F.coalesce(F.try_element_at("_events", F.lit(-1)), F.lit(K.DEFAULT_EVENT)),
        data=F.try_element_at(json, F.lit(-1)),
    )


def _with_data(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("data").isNotNull() & (F.col("data") != "null"))


def _well_formed(text):
    from corpusreview.operators.replies import strict_json

    return strict_json(text).isNotNull()


def read_event_log(
    spark: SparkSession, path: str, split_bytes: int | None = None, positions: str | None = None, shards: int = 32
) -> DataFrame:
    """Events of the log files at ``path``: ``file, start, event, data``.

    With ``positions``, a folder that all executors share, the result is a stream that follows the files as they grow; it
    needs its own folder of positions, as it needs its own checkpoint.  ``shards`` tasks list and read the files.
    """
    spark.dataSource.register(EventLogSource)
    if positions:
        stream = spark.readStream.format("event_log").option("positions", positions).option("shards", str(shards))
        return parse_open_records(stream.load(path))
    reader = spark.read.format("event_log")
    if split_bytes:
        reader = reader.option("splitbytes", str(split_bytes))
    return parse_records(reader.load(path))

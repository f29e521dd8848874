"""The result log as a data source of its own, in batches and as a stream.

    results_source(spark, models=["m"], since="2025-03-01").load(path)
    results_source(spark, push=True).load(path).filter("model_dir = 'm' and file_time >= '2025-03-01'")
    results_source(spark, stream=True).option("maxFiles", 1000).load(path)

Files are listed by the driver, as Spark's own sources do, and read whole in tasks of ``taskBytes`` or so. Conditions on ``model_dir`` and ``file_time`` are answered from names, so files that fail them are not opened. What a record has and the schema has no place for is kept in ``unfit``.
"""

from __future__ import annotations

import io
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import unquote
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docjobs.schemas import LOG_RECORD

SCHEMA = f"{LOG_RECORD}, model_dir string, file_time timestamp, file string, unfit string"
#: Bytes of files that a task reads (a larger file is one task's), records of a batch, and seconds that a new file is left alone.
TASK_BYTES, RECORDS, SETTLE = 64 << 20, 1000, 10


@dataclass(frozen=True)
class LogFile:
    path: str
    size: int
    changed: int  # microseconds
    model_dir: str
    file_time: datetime | None


@dataclass
class Files(D.InputPartition):
    files: list[LogFile]


def _file(info: pafs.FileInfo, zone: ZoneInfo) -> LogFile:
    """Model and time by the names of folder and file; no time where the name has none. Folders that Spark named are unescaped."""
    folder, name = ("/" + info.path).split("/")[-2:]
    stamp = re.match(r"(\d{8}_\d{6})_", name)
    try:
        at = stamp and datetime.strptime(stamp.group(1), "%Y%m%d_%H%M%S").replace(tzinfo=zone).astimezone(timezone.utc)
    except ValueError:
        at = None
    return LogFile(info.path, info.size, info.mtime_ns // 1000, unquote(folder.removeprefix("model=")) if folder.startswith("model=") else folder, at or None)


def _listed(uri: str, zone: ZoneInfo) -> list[LogFile]:
    """The log's files; those that Spark leaves out (names that begin with _ or .) are left out here too."""
    fs, root = pafs.FileSystem.from_uri(uri)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = re.compile(r"/[_.]")
    return [_file(i, zone) for i in found if i.type == pafs.FileType.File and not hidden.search(i.path[len(root) :])]


def _dealt(files: list[LogFile], most: int) -> list[Files]:
    """Files for each task."""
    out, size = [], most
    for f in sorted(files, key=lambda f: f.path):
        if size + f.size > most and size:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size + 4096  # opening a file costs something too
    return out or [Files([])]


def fit(value, kind: T.DataType, at: str, unfit: dict):
    """The value as the type takes it; what it doesn't take goes to unfit under its path, and null takes its place."""
    if value is None:
        return None
    if isinstance(kind, T.StructType) and isinstance(value, dict):
        known = {f.name: f.dataType for f in kind.fields}
        unfit.update({f"{at}.{k}": v for k, v in value.items() if k not in known})
        return {k: fit(value.get(k), t, f"{at}.{k}", unfit) for k, t in known.items()}
    if isinstance(kind, T.ArrayType) and isinstance(value, list):
        return [fit(v, kind.elementType, f"{at}[{i}]", unfit) for i, v in enumerate(value)]
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.DoubleType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        try:
            return float(value)
        except OverflowError:
            pass
    unfit[at] = value
    return None


def _values(file: io.BufferedIOBase) -> Iterator:
    """The records of a file: a record, a list of them, or one a line; text that is no JSON comes as it is.

    A file of a record a line is read line by line, so that its size is not held.
    """
    lines = io.TextIOWrapper(file, "utf-8", "replace", newline="\n")
    text = head = lines.readline().removeprefix("\ufeff")
    while head and not head.strip():
        text += (head := lines.readline())
    if head.lstrip().startswith("{") and _is_json(head):
        while line := lines.readline():
            if line.strip():
                break
            text += line
        if line:
            yield json.loads(head)
        while line:
            if line.strip():
                line = line.removesuffix("\n")
                try:
                    yield json.loads(line)
                except ValueError:
                    yield line
            line = lines.readline()
            if not line:
                return
    text += lines.read()
    if not text.strip():
        return
    try:
        whole = json.loads(text)
        yield from whole if isinstance(whole, list) else [whole]
    except ValueError:
        yield text


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _row(value, file: LogFile, kinds: dict) -> dict:
    unfit: dict = {}
    if isinstance(value, dict):
        row = {k: fit(value.get(k), kinds[k], k, unfit) for k in ("metadata", "extraction")}
        unfit.update({k: v for k, v in value.items() if k not in row})
    else:
        row, unfit = {"metadata": None, "extraction": None}, {"": value}
    text = json.dumps(unfit, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace").decode() if unfit else None
    return row | {"model_dir": file.model_dir, "file_time": file.file_time, "file": file.path, "unfit": text}


class _Reading:
    def __init__(self, schema: T.StructType, options: dict):
        self.uri, self.zone, self.kinds = options["path"], ZoneInfo(options.get("timezone", "UTC")), {f.name: f.dataType for f in schema.fields}
        self.models = json.loads(options.get("models", "null"))
        self.since, self.until = (datetime.fromisoformat(options[k]).replace(tzinfo=self.zone) if k in options else None for k in ("since", "until"))
        self.arrow, self.bytes = to_arrow_schema(schema), int(options.get("taskbytes", TASK_BYTES))

    def files(self) -> list[LogFile]:
        """The files that the options ask for."""
        found = [f for f in _listed(self.uri, self.zone) if self.models is None or f.model_dir in self.models]
        if self.since is None and self.until is None:
            return found
        return [f for f in found if f.file_time and (self.since is None or f.file_time >= self.since) and (self.until is None or f.file_time < self.until)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, rows = pafs.FileSystem.from_uri(self.uri)[0], []
        for file in partition.files:
            with fs.open_input_stream(file.path) as f:
                for value in _values(f):
                    rows.append(_row(value, file, self.kinds))
                    if len(rows) == RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, self.arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


#: Conditions that names answer.
ANSWERED = {
    D.EqualTo: lambda x, v: x is not None and x == v,
    D.In: lambda x, v: x is not None and x in v,
    D.GreaterThan: lambda x, v: x is not None and x > v,
    D.GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    D.LessThan: lambda x, v: x is not None and x < v,
    D.LessThanOrEqual: lambda x, v: x is not None and x <= v,
}


class LogReader(_Reading, D.DataSourceReader):
    def partitions(self) -> list[Files]:
        return _dealt(self.files(), self.bytes)


class PushedLogReader(LogReader):
    """Takes conditions from the query's filters too."""

    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.wanted: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if f.attribute in (("model_dir",), ("file_time",)) and (type(f) in ANSWERED or isinstance(f, D.IsNotNull)):
                self.wanted.append(f)
            else:
                yield f

    def files(self) -> list[LogFile]:
        return [f for f in super().files() if all(self._passes(getattr(f, w.attribute[0]), w) for w in self.wanted)]

    @staticmethod
    def _passes(own, wanted) -> bool:
        return own is not None if isinstance(wanted, D.IsNotNull) else ANSWERED[type(wanted)](own, wanted.value)


class LogStream(_Reading, D.DataSourceStreamReader):
    """Files in order of the time they were changed; an offset is such a time, and a batch has all files up to it.

    A file is taken once it has not been changed for ``settleSeconds``, so that all files of one time come together: a file
    must be visible that long after its time at the latest, and a driver's clock must not go back by more between restarts.
    ``maxFiles`` bounds a batch, except that files of one time stay together, and that the first batch after a restart, and
    the only one of an ``availableNow`` trigger, takes all there is.
    """

    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.settle, self.most = float(options.get("settleseconds", SETTLE)), int(options.get("maxfiles", 0))
        self.reached = None

    def initialOffset(self) -> dict:
        self.reached = -1
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = (time.time() - self.settle) * 1e6
        known = -1 if self.reached is None else self.reached
        times = sorted(f.changed for f in self.files() if known < f.changed <= until)
        if self.most and self.reached is not None:
            times = times[: self.most]
        return {"changed": times[-1] if times else known}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.reached = end["changed"]
        return _dealt([f for f in self.files() if start["changed"] < f.changed <= end["changed"]], self.bytes)

    def commit(self, end: dict) -> None:
        self.reached = end["changed"]


class ResultsLog(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "results_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> LogReader:
        options = dict(self.options)
        return (PushedLogReader if options.get("push") == "true" else LogReader)(schema, options)

    def streamReader(self, schema: T.StructType) -> LogStream:
        return LogStream(schema, dict(self.options))


def results_source(spark: SparkSession, stream: bool = False, push: bool = False, models: list[str] | None = None, since: str | None = None, until: str | None = None):
    """A reader (DataFrameReader or DataStreamReader) of the result log; load(path) gives the columns of ``SCHEMA``.

    models, since and until (ISO, from since on and before until) choose files by their names, whose times are in the session's
    time zone; a file without a time is in no span. With push, filters on these columns do so as well: that turns
    ``spark.sql.python.filterPushdown.enabled`` on for the session, and each load is then good for one scan in a query, as
    Spark keeps one set of pushed filters for a loaded table (join or unite two loads, not two filters of one).

    Files of no bytes have no rows; a record that is no object has nulls and ``unfit``.
    """
    spark.dataSource.register(ResultsLog)
    reader = (spark.readStream if stream else spark.read).format("results_log").option("timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        reader = reader.option("push", "true")
    given = {"models": None if models is None else json.dumps(models), "since": since, "until": until}
    return reader.options(**{k: v for k, v in given.items() if v is not None})

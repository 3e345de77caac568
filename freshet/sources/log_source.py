"""Monthly text logs as a Spark data source named ``monthly_log``.

Reading: one partition per file (``filesPerPartition`` takes more of these small files into one). Station, month and
year stand in a file's name, so the options ``firstYear``, ``lastYear``, ``stations`` and ``months`` choose files before
any is opened. They belong to one load. Spark's own filter push-down is left out on purpose: in the version used here,
the filters pushed for one query over a loaded table stay in force for later queries over it that push others or none.
Writing: one file per station and month, each written whole under a staged name and moved to its place when all tasks
are done, so a failed write changes nothing and a repeated one replaces the files it writes again.

Layouts: ``flat`` puts all files into one folder; ``by_year`` puts them into folders ``year=YYYY``, of which the others
are not even listed. Folders are reached through Arrow's file systems (local paths, ``file://``, ``hdfs://``, ``s3://``,
``gs://``); ``text_log.read_text_logs`` reads the same files through Spark's own readers from anywhere.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

from freshet.functions.calendar import MONTH_CODES
from freshet.sources.schemas import LOG_FIELDS, LOG_FOOT_LINES, LOG_HEAD_LINES, LOG_HEAD_LINES_FROM_2018, MEASURES

FORMAT = "monthly_log"
SCHEMA = "station string, year int, month int, day int, " + ", ".join(f"{m} double" for m in MEASURES)
_NAME = re.compile(r"([A-Za-z0-9]+)_(" + "|".join(MONTH_CODES) + r")_(\d{4})\.txt")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_STAGED = "_staged-"


def _head_lines(year: int) -> int:
    return LOG_HEAD_LINES_FROM_2018 if year >= 2018 else LOG_HEAD_LINES


def parsed_lines(text: str, year: int) -> Iterator[tuple]:
    """(day, measures...) of each whole line between head and foot; a line with a field that is no number is left out."""
    lines = text.replace("\r", "").rstrip("\n").split("\n")
    for line in lines[_head_lines(year):max(len(lines) - LOG_FOOT_LINES, 0)]:
        parts = line.split()
        if len(parts) >= len(LOG_FIELDS) and parts[0].isdigit() and all(map(_NUMBER.fullmatch, parts[1:len(LOG_FIELDS)])):
            yield int(parts[0]), *[float(p) for p in parts[1:len(LOG_FIELDS)]]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class LogFiles(InputPartition):
    """Files of one partition, with what their names tell."""

    path: str
    files: list[tuple[str, str, int, int]]  # file, station, year, month

    def __repr__(self) -> str:
        return f"LogFiles({[f for f, *_ in self.files]})"


@dataclass
class LogReader(DataSourceReader):
    path: str
    first_year: int = 0
    last_year: int = 9999
    files_per_partition: int = 1
    stations: frozenset[str] | None = None
    months: frozenset[int] | None = None

    def chosen_files(self) -> list[tuple[str, str, int, int]]:
        """Files of the wanted years, stations and months, from a listing of the wanted folders only."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = []
        folders = [(root, "")]
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            year = re.fullmatch(r"year=(\d{4})", info.base_name)
            if info.type == fs.FileType.Directory and year and self.first_year <= int(year[1]) <= self.last_year:
                folders.append((info.path, f"{info.base_name}/"))
        for folder, prefix in folders:
            for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                name = _NAME.fullmatch(info.base_name)
                if info.type != fs.FileType.File or not name:
                    continue
                station, month, year = name[1], MONTH_CODES.index(name[2]) + 1, int(name[3])
                if (
                    self.first_year <= year <= self.last_year
                    and (self.stations is None or station in self.stations)
                    and (self.months is None or month in self.months)
                ):
                    found.append((prefix + info.base_name, station, year, month))
        return sorted(found)

    def partitions(self) -> list[LogFiles]:
        files, n = self.chosen_files(), self.files_per_partition
        # Spark wants one partition at least
        return [LogFiles(self.path, files[i:i + n]) for i in range(0, len(files), n)] or [LogFiles(self.path, [])]

    def read(self, partition: LogFiles) -> Iterator[tuple]:
        if not partition.files:
            return
        system, root = _file_system(partition.path)
        for name, station, year, month in partition.files:
            with system.open_input_stream(posixpath.join(root, name)) as stream:
                text = stream.read().decode("utf-8", "replace")
            for row in parsed_lines(text, year):
                yield station, year, month, *row


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]


@dataclass
class LogWriter(DataSourceWriter):
    """Rows come sorted by station, year and month, each file's rows in one task (``write_logs`` sees to that)."""

    path: str
    by_year: bool
    columns: list[str]
    replace: bool
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    def write(self, rows: Iterator) -> Staged:
        from itertools import groupby

        system, root = _file_system(self.path)
        done = []
        at = {c: i for i, c in enumerate(self.columns)}
        key = lambda r: (r[at["station"]], r[at["year"]], r[at["month"]])
        for (station, year, month), days in groupby(rows, key):
            folder = f"year={year:04d}/" if self.by_year else ""
            name = f"{folder}{station}_{MONTH_CODES[month - 1]}_{year:04d}.txt"
            number = lambda x: "" if x is None else repr(x)
            lines = ["   ".join(["", *[number(r[at[c]]) for c in ("day", *MEASURES)]]) for r in days]
            text = ["report"] * _head_lines(year) + lines + ["report"] * LOG_FOOT_LINES
            staged = posixpath.join(root, f"{_STAGED}{self.job}", name)
            system.create_dir(posixpath.dirname(staged), recursive=True)
            with system.open_output_stream(staged) as stream:
                stream.write(("\n".join(text) + "\n").encode())
            done.append(name)
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        """Move the staged files to their places; after that, with ``replace``, drop files that were not written again."""
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        former = {f for f, *_ in LogReader(self.path).chosen_files()}
        written = {f for m in messages if m for f in m.files}
        for name in sorted(written):
            target = posixpath.join(root, name)
            system.create_dir(posixpath.dirname(target), recursive=True)
            system.move(posixpath.join(root, f"{_STAGED}{self.job}", name), target)
        for name in sorted(former - written if self.replace else ()):
            system.delete_file(posixpath.join(root, name))
        self._drop_staged()

    def abort(self, messages: list[Staged | None]) -> None:
        self._drop_staged()

    def _drop_staged(self) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        staged = posixpath.join(root, f"{_STAGED}{self.job}")
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class MonthlyLogSource(DataSource):
    """The format; options path, firstYear, lastYear, stations, months (lists parted by commas) and filesPerPartition to
    read, path and layout to write."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        of = self.options.get
        listed = lambda name, kind: frozenset(kind(x) for x in of(name).split(",")) if of(name) is not None else None
        return LogReader(
            of("path"), int(of("firstYear") or 0), int(of("lastYear") or 9999), int(of("filesPerPartition") or 1),
            listed("stations", str), listed("months", int),
        )

    def writer(self, schema, overwrite: bool) -> LogWriter:
        layout = self.options.get("layout") or "flat"
        if layout not in ("flat", "by_year"):
            raise ValueError(f"unknown layout {layout}")
        return LogWriter(self.options.get("path"), layout == "by_year", schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to the session."""
    spark.dataSource.register(MonthlyLogSource)
    return spark


def read_logs(
    spark: SparkSession,
    path: str,
    first_year: int | None = None,
    last_year: int | None = None,
    stations: list[str] | None = None,
    months: list[int] | None = None,
    files_per_partition: int = 1,
) -> DataFrame:
    """Logged days under ``path``, optionally of a span of years, of some stations or months; other files stay closed."""
    joined = lambda values: None if values is None else ",".join(str(v) for v in values)
    options = {
        "firstYear": first_year, "lastYear": last_year, "stations": joined(stations), "months": joined(months),
        "filesPerPartition": files_per_partition,
    }
    reader = register(spark).read.format(FORMAT)
    return reader.options(**{k: v for k, v in options.items() if v is not None}).load(path)


def write_logs(log: DataFrame, path: str, layout: str = "flat", mode: str = "overwrite") -> None:
    """Write daily rows (station, year, month, day, measures) as monthly files; a measure the rows lack stays empty.

    A month's rows meet in one task, which is 31 of them.
    """
    known = [F.col(m).cast("double").alias(m) if m in log.columns else F.lit(None).cast("double").alias(m) for m in MEASURES]
    rows = log.select("station", F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"), *known)
    register(log.sparkSession)
    dealt = rows.repartition("station", "year", "month").sortWithinPartitions("station", "year", "month", "day")
    dealt.write.format(FORMAT).option("layout", layout).mode(mode).save(path)

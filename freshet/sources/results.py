"""Result tables in files that survive a failed or repeated write.

A result is written to a hidden folder beside its path and then committed by a small journal file, made by one atomic
rename. Only after that does the new folder take the path. A write that fails before the journal stands leaves the
former result whole; once it stands, every later read or write through this module finishes the exchange first, however
often it was interrupted. Steps of the exchange may be repeated without harm. Two writers of one path at the same time
are not supported.

Everything goes through Spark's own file systems, so results can be wherever Spark writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StringType, StructType, TimestampNTZType, TimestampType

from freshet.functions.calendar import floor_to_day, parse_time
from freshet.functions.numeric import to_double
from freshet.sources.checks import require_columns


class ResultFolder:
    """A result's path with its staged folders and its journal."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.path = self.path_of(path)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.journal = self._beside("commit")

    def _beside(self, what: str):
        return self.path_of(self.path.getParent(), f".{self.path.getName()}.{what}")

    def staged(self) -> str:
        return self._beside(f"staged-{uuid.uuid4().hex}").toString()

    def discard(self, staged: str) -> None:
        self.fs.delete(self.path_of(staged), True)

    def commit(self, staged: str) -> None:
        """From the rename on, the staged folder is the result."""
        draft = self._beside(f"draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(self.path_of(staged).getName().encode()))
        out.close()
        if not self.fs.rename(draft, self.journal):
            self.fs.delete(draft, False)
            raise OSError(f"the result {self.path} could not be committed")

    def settle(self) -> None:
        """Finish an exchange whose journal stands."""
        if not self.fs.exists(self.journal):
            return
        stream = self.fs.open(self.journal)
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        staged = self.path_of(self.path.getParent(), name)
        if self.fs.exists(staged):  # else it has taken its place already
            self.fs.delete(self.path, True)
            if not self.fs.rename(staged, self.path):
                raise OSError(f"{staged} could not be moved to {self.path}")
        self.fs.delete(self.journal, False)


def write_result(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    order_by: list[str] | None = None,
) -> None:
    """Write a result; parquet by default, CSV with header on request, split into folders or sorted when asked.

    ``df`` may read the former result of the same path.
    """
    folder = ResultFolder(df.sparkSession, path)
    folder.settle()
    if order_by:
        df = df.orderBy(*order_by)
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    staged = folder.staged()
    try:
        writer.save(staged)
    except BaseException:
        folder.discard(staged)
        raise
    folder.commit(staged)
    folder.settle()


def coerced(column: Column, kind) -> Column:
    """Text as a value of ``kind``; what cannot be read becomes null."""
    if isinstance(kind, DateType):
        return floor_to_day(parse_time(column))
    if isinstance(kind, TimestampNTZType):
        return parse_time(column)
    if isinstance(kind, TimestampType):
        return parse_time(column).cast("timestamp")
    if isinstance(kind, (DoubleType, FloatType)):
        return to_double(column).cast(kind)
    return column if isinstance(kind, StringType) else column.try_cast(kind)


def read_result(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    """The columns of ``schema`` from a written result, after any interrupted exchange has been finished.

    A CSV is read as text, its columns are found by their names in the header, and cells that do not read as their type
    become null; a missing column is an error that names it.
    """
    ResultFolder(spark, path).settle()
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    table = require_columns(reader.format(fmt).load(path), schema.fieldNames(), f"result {path}")
    text = lambda f: coerced(F.col(f"`{f.name}`"), f.dataType) if fmt == "csv" else F.col(f"`{f.name}`").cast(f.dataType)
    return table.select(*[text(f).alias(f.name) for f in schema.fields])

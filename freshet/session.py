"""Session set-up and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "freshet") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


@cache
def _package_zip() -> str:
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="freshet-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    return str(target)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the workers of ``spark``, once per application.

    Python functions of the package are pickled by name, so workers must be able to import it; Spark hands the archive
    to every executor, also to those that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_freshet_shipped", None) != context.applicationId:
        context.addPyFile(_package_zip())
        context._freshet_shipped = context.applicationId
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="freshet-")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, or an own one where all tasks run in here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster, which has executors
        return _own_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result is read several times (branches of a plan, model fits) or where its row layout must not
    change between two reads (row numbering). A lost executor then costs a re-read of a small table and not a rescan
    of the raw ones, and the size of the written files lets Spark choose its joins by fact.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/freshet-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

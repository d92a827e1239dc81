"""Where intermediate tables go, and broadcasts whose size is checked."""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that ``spread`` gives to a task; a page of a task's memory, 64 MB, holds them at 256 bytes each.
TASK_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lotwise-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lotwise-{tag}-{uuid.uuid4().hex}"


#: The stored tables of the innermost ``scratch`` block.
_scratch: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the lineage, survives
    lost executors, and lets later joins see a plain scan (so that AQE can split skewed keys)."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if (tables := _scratch.get()) is not None:
        tables.append(out)
    return out


def file_system(spark: SparkSession, folder: str):
    """A path and its file system, of any kind that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that no later plan reads."""
    for df in tables:
        path, system = file_system(df.sparkSession, df.stored_path)
        system.delete(path, True)


@contextlib.contextmanager
def scratch():
    """Deletes the tables stored inside the block when it ends. For work whose result is stored by the
    block around it: ``outlive(table)`` hands a table on to that one."""
    tables: list[DataFrame] = []
    before = _scratch.set(tables)
    try:
        yield
    finally:
        _scratch.reset(before)
        discard(*tables)


def outlive(df: DataFrame) -> DataFrame:
    """Takes a stored table out of the present ``scratch`` block."""
    if (tables := _scratch.get()) is not None:
        tables[:] = [t for t in tables if t is not df]
    return df


def expire(spark: SparkSession, hours: float) -> int:
    """Deletes everything that this library left in the shared folder and did not change for so many
    hours, and returns how much that was. For long sessions: queries are lazy, so the tables that their
    results read can't go by themselves."""
    folder, system = file_system(spark, shared_folder(spark))
    if not system.exists(folder):
        return 0
    before, gone = (time.time() - hours * 3600) * 1000, 0
    for status in system.listStatus(folder):
        if status.getPath().getName().startswith("lotwise-") and status.getModificationTime() <= before:
            gone += bool(system.delete(status.getPath(), True))
    return gone


def spread(df: DataFrame, rows: float, *keys: str) -> DataFrame:
    """Deals ``df`` out by key so that a task gets ``TASK_ROWS`` of the ``rows`` that it grows to: what a task
    sorts or collects then stays the same, and the number of tasks follows the data, whatever the session's
    number of shuffle partitions. No more rows than a task's are left as they are. For a join it's enough to deal out its
    smaller side: the other follows, or stays where it lies if Spark broadcasts the small one."""
    n = math.ceil(rows / TASK_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a stored table only once its counted rows are within ``rows``; else joins stay shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

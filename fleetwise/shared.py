"""Intermediate tables in the folder that all executors share, and how long they live."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only for a single-process master."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="fleetwise-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scope:
    """Knows the folders that were made while it was the innermost one, and deletes them."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def clear(self) -> None:
        while self.paths:
            spark, path = self.paths.pop()
            remove(spark, path)


# The outermost scope ends with the program: tables behind a lazy result live until then. Every thread
# has a stack of its own, so that no thread deletes what another one has stored.
_PROGRAM = Scope()
_stack: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=(_PROGRAM,))


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Tables stored inside the block are deleted at its end.

    Take out of the block only what no longer reads them: values, or a frame written elsewhere
    (``kept``).
    """
    inner = Scope()
    token = _stack.set((*_stack.get(), inner))
    try:
        yield inner
    finally:
        _stack.reset(token)
        inner.clear()


def together(calls: Sequence[Callable[[], object]]) -> list:
    """The results of independent calls that run at the same time, each within the scopes around this one."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        found = [pool.submit(copy_context().run, call) for call in calls]
        return [f.result() for f in found]


@atexit.register
def _end() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        _PROGRAM.clear()


def new_path(spark: SparkSession, label: str, outer: bool = False, lasting: bool = False) -> str:
    """A fresh folder name. ``outer`` books it on the scope around the innermost one, ``lasting`` on
    the outermost, which ends with the program."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    stack = _stack.get()
    at = 0 if lasting else max(0, len(stack) - 2) if outer else -1
    stack[at].paths.append((spark, path))
    return path


def stored(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    The written table fixes what a plan with several branches sees, survives the loss of an
    executor, and keeps column pruning and filter pushdown for its readers. It lives as long as
    the scope it was made in.
    """
    spark = df.sparkSession
    path = new_path(spark, label, outer)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for the result of a scoped block: it outlives the block, not the one around."""
    return stored(df, label, outer=True)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever file system it lies."""
    files, target = _at(spark, path)
    return files.delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system in front, as readers outside Spark need it."""
    files, target = _at(spark, path)
    full = files.makeQualified(target).toString()
    return full if "://" in full else full.replace(":/", ":///", 1)

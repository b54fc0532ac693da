"""Written intermediates in the folder that driver and executors share, and who deletes them.

A table that is read lazily can't be deleted by the function that wrote it. So every written table is on the session's
list: ``owned`` deletes what was written inside a block once its result is no longer read, ``remove_all`` what a session
has left, and the end of the process does so by itself.
"""
from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .errors import ContactError

#: Paths written by this process and not yet deleted, by the session's application.
_held: dict[str, set[str]] = {}
#: What the innermost open block has written; each thread has blocks of its own.
_block: ContextVar[list[str] | None] = ContextVar("block", default=None)
_lock = threading.Lock()
_own_folder: dict[str, str] = {}
_PATH = "_written_at"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder; on a cluster that
    is an error, as executors would write where nobody else reads."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ContactError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="contactforge-")
    return _own_folder[app]


def fresh(spark: SparkSession) -> str:
    """A path for a table or file of the session that doesn't exist yet; it is deleted with the others."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _lock:
        _held.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if (block := _block.get()) is not None:
        block.append(path)
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table that is read again: short lineage, one computation, and no loss with an executor. ``options`` are
    the Parquet writer's."""
    spark = df.sparkSession
    path = fresh(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    with _lock:
        _held.get(spark.sparkContext.applicationId, set()).discard(path)


def removed(df: DataFrame) -> None:
    """Delete a table that ``written`` or ``settled`` has returned and that nothing will read again; anything else
    stays."""
    path = getattr(df, _PATH, None)
    if path in _held.get(df.sparkSession.sparkContext.applicationId, ()):
        _delete(df.sparkSession, path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the tables that its own thread has written inside the block; results must have been read by
    then. A path that is taken off the list stays."""
    mine: list[str] = []
    outer = _block.set(mine)
    try:
        yield mine
    finally:
        _block.reset(outer)
        for path in mine:
            if path in _held.get(spark.sparkContext.applicationId, ()):
                _delete(spark, path)


def settled(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The result of ``make`` as one written table, of the block around; all that was written on the way is deleted."""
    with owned(spark) as mine:
        out = written(make())
        mine.remove(getattr(out, _PATH))
    if (block := _block.get()) is not None:
        block.append(getattr(out, _PATH))
    return out


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a written folder into its place as a whole; False, and the source is deleted, if something is there already.
    Unlike a file system's plain rename this never moves into a folder that is there."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    hadoop = jvm.org.apache.hadoop.fs
    here, there = hadoop.Path(source), hadoop.Path(target)
    fs = here.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(there.getParent())
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(here, there, sc._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError:
        fs.delete(here, True)
        if not fs.exists(there):
            raise
        return False
    return True


def remove_all(spark: SparkSession) -> None:
    """Delete every table that this process has written for the session."""
    for path in sorted(_held.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def unowned(spark: SparkSession, path: str) -> str:
    """Puts a path of no block's on the session's list: it stays until ``remove_all`` or the end of the process."""
    with _lock:
        _held.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


@atexit.register
def _at_exit() -> None:
    spark = SparkSession._instantiatedSession
    if spark is not None and spark.sparkContext._jsc is not None:
        with suppress(Exception):  # the JVM may be gone
            remove_all(spark)

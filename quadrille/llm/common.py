"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[ \t\n\x0b\x0c\r]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows of a side table that may be broadcast; a row is at most a few hundred bytes, so this bounds the bytes too.
MAX_BROADCAST_ROWS = 100_000

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one is made if the
    driver's machine runs everything, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quadrille-shared-")
    return _local[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_Batches = Iterable[pa.RecordBatch]


def lean(run: Callable[[_Batches], Iterator[pa.RecordBatch]], forget: Callable[[], object] = lambda: None) -> Callable[[_Batches], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at a task's end forget() is called and freed memory goes back to the system, since the worker
    lives on beside those of other operators."""

    def task(batches: _Batches) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries
                ctypes.CDLL(None).malloc_trim(0)

    return task


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """materialize() for tables that nothing reads after the block; they are removed at its end."""
    own: list[tuple[SparkSession, str]] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        own.append(_made[-1])
        return out

    try:
        yield put
    finally:
        _remove(own)


def clear(spark: SparkSession) -> None:
    """Remove all tables of this process's operators; results that read them must have been written before."""
    _remove([x for x in _made if x[0].sparkContext is spark.sparkContext])


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove((spark, path))


@atexit.register
def _clean() -> None:
    """Remove this process's tables when it ends; a session that is already gone leaves them to its owner."""
    with contextlib.suppress(Exception):  # the gateway may be down at exit
        _remove(list(_made))
    for path in _local.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def others(df: DataFrame, made: list[str]) -> list[Column]:
    """df's columns but for those whose names (in any case) an operator makes: its own win."""
    taken = {x.lower() for x in made}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]

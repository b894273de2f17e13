"""Shared scratch storage: where lineage is cut and archives are put.

The folder is the one the cluster names in ``spark.checkpoint.dir``, which all
executors and the driver see. Only where that is unset (tests on one machine)
is a local temporary folder made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Tables that the open :func:`temporary` blocks are to delete; each thread has its own.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eventloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here.

    Within :func:`temporary` the table goes at the block's end, unless it is to be kept.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._eventloom_path = path  # type: ignore[attr-defined]
    if (blocks := _OPEN.get()) and not keep:
        blocks[-1].append(back)
    return back


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes what :func:`written` makes within the block: what the block returns must be written and kept."""
    own: list[DataFrame] = []
    before = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(before)
        for df in own:
            dropped(df)


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_eventloom_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or ``want`` with underscores where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want

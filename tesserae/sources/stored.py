"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session on this machine alone (as in tests) gets one temporary
    folder; on a cluster that is an error, since executors could not read a folder of the driver's machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        folder = _local[app]
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs
    only the rereading of its part. ``instead_of`` is a stored table that nothing reads any more: it goes once ``df``
    is written."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    for made in _scopes[-1:]:
        made.append(table)
    if instead_of is not None:
        removed(instead_of)
    return table


def removed(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` returned and that no plan will read again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside goes at the end, but for tables that are passed to the function that this gives: for work whose
    result is written inside. One scope at a time counts, the innermost."""
    made: list[DataFrame] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._stored_at)
        return table

    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.remove(made)
        for table in made:
            if table._stored_at in kept:
                for outer in _scopes[-1:]:
                    outer.append(table)
            else:
                removed(table)

"""Session, table and scratch-space helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()
_own: list[str] = []
_known: set[str] = set()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Where the setting is missing, a local master gets a folder of its own; a cluster gets an error, since its
    machines would each see their own files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="graphloom-"))
        where = _own[0]
    path = f"{where.rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"
    if path not in _known:
        _known.add(path)
        fs, p = _file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


class Scope:
    """The scratch tables written since it was opened; see scratch()."""

    def __init__(self) -> None:
        self.tables: list[str] = []

    def keep(self, *tables: DataFrame) -> DataFrame:
        """Leave these tables to the enclosing scope, or to the application; the first of them is returned."""
        outer = _scopes()[-2:-1]
        for t in tables:
            if t.scratch in self.tables:
                self.tables.remove(t.scratch)
                for s in outer:
                    s.tables.append(t.scratch)
        return tables[0]


def _scopes() -> list[Scope]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scope]:
    """Tables that materialize() writes in this block, in this thread, are deleted at its end, but for those kept.

    What leaves the block and is evaluated later may read kept tables only.
    """
    scope = Scope()
    _scopes().append(scope)
    try:
        yield scope
    finally:
        _scopes().pop()
        for path in scope.tables:
            _delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes()[-1:]:
        scope.tables.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind what materialize returned, once nothing reads it any more."""
    path = getattr(df, "scratch", None)
    for scope in _scopes():
        if path in scope.tables:
            scope.tables.remove(path)
    if path:
        _delete(df.sparkSession, path)


def _file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete(spark: SparkSession, where: str) -> None:
    fs, path = _file_system(spark, where)
    fs.delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete everything that materialize wrote in this application, before it ends."""
    where = shared_dir(spark)
    _delete(spark, where)
    _known.discard(where)

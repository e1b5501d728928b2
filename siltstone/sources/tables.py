"""Reading the given tables and keeping intermediate ones in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master a temporary one if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that they share")
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders of the tables that each thread has written, in order.
_made = threading.local()


def _folders() -> list[str]:
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path for a table in this application's part of the shared folder."""
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders().append(path)
    return path


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """`df` as a table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` returns, as a written table; tables that were written on the way are deleted."""
    before = len(_folders())
    out = written(make(), name)
    keep = _folders().pop()
    for path in _folders()[before:]:
        delete(spark, path)
    del _folders()[before:]
    _folders().append(keep)
    return out


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written on the way to results which are stored by now."""
    delete(spark, own_dir(spark))
    _folders().clear()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing reads any more."""
    root = f"{own_dir(df.sparkSession)}/".removeprefix("file://")
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if root in parent:
            delete(df.sparkSession, parent)

"""Tables in the folder that driver and executors share: a written table cuts the lineage and survives lost executors.

Each application has a folder of its own below ``octetflow``, which goes when the process ends, or with ``clear``; what is written inside a ``scope`` goes with it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, on one machine (tests), a temporary folder of our own; on a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a folder that driver and executors share is needed")
        root = "file://" + tempfile.mkdtemp(prefix="octetflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _application(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/octetflow/{spark.sparkContext.applicationId}"
    _roots.add(root)
    return root


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written. Frames that read it can't be used any more."""
    root = _application(spark)
    _roots.discard(root)
    delete(spark, root)


@atexit.register
def _clear_all() -> None:
    for root in _roots:
        with contextlib.suppress(Exception):  # the session is over, and the JVM may be gone
            jvm = SparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is written inside is removed at the end; results must have been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def folder(spark: SparkSession, name: str) -> str:
    path = f"{_application(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

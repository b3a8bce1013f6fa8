"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()
_mine = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a laptop) a folder of
    ours takes its place; elsewhere executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    root = f"{base.rstrip('/')}/riskweave-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is gone; its cluster's clean-up owns the folder
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    if (open_ := getattr(_mine, "paths", None)) is not None:
        open_.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what this thread has written in it; nothing made there may be read later."""
    before, _mine.paths = getattr(_mine, "paths", None), []
    try:
        yield
    finally:
        paths, _mine.paths = _mine.paths, before
        for path in paths:
            _remove(spark, path)

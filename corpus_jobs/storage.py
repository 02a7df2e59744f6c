"""The folder that driver and executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only on a single machine may it be unset, and is then a temporary folder of our
    own; on a cluster executors would not find each other's files there, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="corpus-jobs-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: What this process has written to the shared folder.
_written: list[str] = []
_here = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    getattr(_here, "paths", _written).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while paths:
        at = path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes one table that nothing reads any more."""
    _delete(spark, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what this thread has written to the shared folder within it; results must be stored elsewhere by then."""
    before, _here.paths = getattr(_here, "paths", None), []
    try:
        yield
    finally:
        mine = _here.paths
        if before is None:
            del _here.paths
        else:
            _here.paths = before
        _delete(spark, mine)


def remove_written(spark: SparkSession) -> None:
    """Deletes the tables that this process has written to the shared folder. Results that still read them, which is what
    most operators return, must be written or collected before."""
    _delete(spark, _written)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs neither repeat its work nor need its executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

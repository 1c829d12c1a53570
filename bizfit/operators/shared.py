"""Lineage cuts: intermediate tables are written to the folder the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_USED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a fresh folder on a single machine; an error on a cluster, whose executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[context.applicationId]


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; release() removes it, at the latest when Python ends."""
    path = f"{shared_dir(spark)}/bizfit-{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED[path] = spark
        atexit.register(release, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(path: str) -> None:
    """Remove an application's folder, if its context is still there. No table that was cut can be read after it."""
    spark = _USED.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone when Python ends
            _delete(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used yet, so that a repeated run never reads another run's files."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files, which outlive executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly to several tasks a core, before work that takes long for few bytes: sizes alone would give it to one task or two."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that cut() gave and that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)

"""Lineage cuts: intermediate tables in the cluster's shared checkpoint folder.

``keep(df)`` writes a table below ``spark.checkpoint.dir`` and reads it back, so that later stages
depend on replicated files rather than on executors that may be lost.  A folder of our own is made only
where that setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one of our own if a local session has none; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_folder(spark)}/graphloom-{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of that table.

    What the plan shuffled is then garbage; the driver is told to collect it, as otherwise the files would lie on the
    executors' disks until it happens to do so.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table kept by this application; call it once their results have been consumed."""
    paths = _KEPT.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)

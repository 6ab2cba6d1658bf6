"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SCAN = "spark.sql.files.maxPartitionBytes"
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, the warehouse, or in local mode (tests) one of our own for the session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes with the application."""
    path = f"{shared_dir(spark)}/gleaner/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def staged(df: DataFrame, label: str, scan_bytes: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here and lost executors cost nothing before it.

    While it is written, batches that go to Python hold at most about BATCH_BYTES (or one row), however long texts are,
    unless the session names a bound of its own. scan_bytes: how much of its input a task reads, if not what the session says.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH, _SCAN)}
    spark.conf.set(_CLEANUP, "true")  # the shuffles of this write serve nothing else
    if scan_bytes:
        spark.conf.set(_SCAN, str(scan_bytes))
    if before[_BATCH] is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)

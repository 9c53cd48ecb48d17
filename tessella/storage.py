"""Tables and folders that all executors share.

Everything an operator writes between its stages goes below ``spark.checkpoint.dir``,
which the cluster names. Where that setting is unset, the warehouse takes its place on a
cluster, and a folder of our own in a local session.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_base: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_base(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        warehouse = (spark.conf.get("spark.sql.warehouse.dir", None) or "spark-warehouse").rstrip("/")
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="tessella-") if local else f"{warehouse}/tessella-{app}"
    return _own_base[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Spark's own setting that removes an execution's shuffle files once it has ended; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    With `release` the shuffle files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_path(path: str) -> str:
    """The path for Python's own file functions; only folders mounted on every machine have one."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not a mounted folder; set spark.checkpoint.dir to one for memory-mapped files")
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_folder(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with the application
            pass

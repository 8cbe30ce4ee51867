"""Intermediate tables in the folder that all executors share.

A plan whose lineage must be cut is written as Parquet below ``spark.checkpoint.dir`` and read
back, so a lost executor costs a re-read and never a recomputation of what lies before. What an
operator doesn't drop as soon as nothing reads it goes with the session.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI. Only on a single machine, where the session names none, is one made."""
    base = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {_SETTING} to a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set(_SETTING, base)
        atexit.register(lambda: __import__("shutil").rmtree(base[7:], ignore_errors=True))
    return base.rstrip("/")


#: Folders that go when the session's JVM ends.
_MARKED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    own = f"{shared_dir(spark)}/loomspan-{_RUN}"
    if own not in _MARKED:
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MARKED.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; lineage ends here."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


_FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _inside = threading.Lock(), {}


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when it ends, not when the driver happens to collect its garbage.

    A plan that is run again makes them again, so this is for tables that are written once.
    """
    with _lock:
        depth, before = _inside.get(spark, (0, None))
        if not depth:
            before = spark.conf.get(_FREEING, None)
            spark.conf.set(_FREEING, "true")
        _inside[spark] = depth + 1, before
    try:
        yield
    finally:
        with _lock:
            depth, before = _inside.pop(spark)
            if depth > 1:
                _inside[spark] = depth - 1, before
            elif before is None:
                spark.conf.unset(_FREEING)
            else:
                spark.conf.set(_FREEING, before)

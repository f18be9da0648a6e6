"""Session helpers: the shared folder, and file systems reachable from driver and executors."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor sees, from ``spark.checkpoint.dir``.

    Only where that setting is absent and all tasks run on this machine (tests)
    a local folder is made and set as the session's checkpoint directory; on a
    cluster without the setting nothing would be shared, so that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        return current.get()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="runefold-")
    if current.isEmpty():
        sc.setCheckpointDir(root)
    return root


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared root, deleted when the session's JVM ends; names are never reused."""
    at = f"{shared_root(spark).rstrip('/')}/runefold/{purpose}-{uuid.uuid4().hex}"
    fs, path = hadoop_fs(spark, at)
    fs.mkdirs(path)  # only what exists can be marked
    fs.deleteOnExit(path)
    return at


def hadoop_fs(spark: SparkSession, uri: str):
    """``(FileSystem, Path)`` of the driver's JVM."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder or file with all it holds; nothing happens where there is none."""
    fs, path = hadoop_fs(spark, uri)
    fs.delete(path, True)


@functools.lru_cache(maxsize=64)
def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def open_fs(uri: str):
    """``(filesystem, path)`` of pyarrow for a URI or plain path; usable in Python workers."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return _file_system("file:///")[0], uri
    scheme, rest = uri.split("://", 1)
    root, _, path = rest.partition("/")
    if scheme in ("hdfs", "viewfs"):
        return _file_system(f"{scheme}://{root}/")[0], "/" + path
    fs, base = _file_system(f"{scheme}://{root}")
    return fs, f"{base.rstrip('/')}/{path}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage durably."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Partitions for explicit exchanges: follows the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

"""Reading of the project's tables and writing of intermediate ones."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; one Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches, from ``spark.checkpoint.dir``.

    Only a local master, which has one machine, gets a temporary folder when
    the setting is missing; on a cluster a missing setting is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shirabe-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint()`` usable without changing a folder that is set."""
    where = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)


class Workspace:
    """Written intermediate tables of one operator call, in the shared folder.

    A written table cuts the lineage and survives the loss of executors. Tables
    that a later one supersedes are removed with ``drop``; what a returned
    DataFrame still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes ``df`` and returns a DataFrame over what was written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shirabe_path = path
        return out

    def put(self, name: str, content: bytes) -> None:
        """Writes a small file to ``files`` of this workspace, on whatever file system that is."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/files/{name}")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def drop(self, df: DataFrame | None) -> None:
        """Removes a table that ``write`` returned."""
        path = getattr(df, "_shirabe_path", None)
        if path:
            self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy for its bytes.

    A table in few small files would otherwise be worked on by as few tasks.
    Large tables have more partitions than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

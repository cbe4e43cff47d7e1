"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster must name one, as a
    machine's temporary folder is not visible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    ``keep`` writes and rereads a frame; ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._count = 0

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        self._count += 1
        if name in self._paths:
            raise ValueError(f"{name} is kept already")
        path = f"{self.root}/{self._count:03d}-{name}"
        frame.write.parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def keep_only(self, *names: str) -> None:
        """Remove all other tables."""
        self.drop(*(n for n in list(self._paths) if n not in names))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self._paths.pop(name))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store Spark's configuration knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

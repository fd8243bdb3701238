"""Tables in the folder that the driver and all executors share, and its file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where there is none and the master is local, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterlark-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that what follows reads it, however often, instead of deriving it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Folder:
    """A folder in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in the folder; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(name))) if self.exists(name) else []

    def newest(self, name: str) -> float:
        """When the youngest file below was last written, in seconds; 0 without files."""
        latest, found = 0, self._files.listFiles(self._at(name), True)
        while found.hasNext():
            latest = max(latest, found.next().getModificationTime())
        return latest / 1000

    def put(self, name: str, text: str) -> None:
        out = self._files.create(self._at(name), True)
        out.write(text.encode())
        out.close()

    def delete(self, name: str) -> None:
        self._files.delete(self._at(name), True)

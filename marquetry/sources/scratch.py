"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a fresh folder, but only for a session in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marquetry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame to the shared folder and reads it back: short lineage that survives lost executors."""

    def save(df: DataFrame) -> DataFrame:
        path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def discard(df: DataFrame) -> None:
    """Delete the files of a saved frame that nothing reads any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = _file_system(df.sparkSession, root)
        fs.delete(p, True)


def published(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files under sources, written once per application and read again until one of them changes.

    It appears whole, by a rename; of two that write it at once one is kept.
    """
    seen = [spark.sparkContext.applicationId, name]
    for source in sources:
        fs, p = _file_system(spark, source)
        files = fs.listFiles(p, True)
        listed = []
        while files.hasNext():
            f = files.next()
            listed.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        seen += sorted(listed)
    path = f"{shared_folder(spark)}/published-{name}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:24]}"
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        staging = f"{path}.{uuid.uuid4().hex}"
        make().write.parquet(staging)
        if fs.exists(target) or not fs.rename(_file_system(spark, staging)[1], target):
            fs.delete(_file_system(spark, staging)[1], True)
    return spark.read.parquet(path)

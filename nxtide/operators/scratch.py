"""Tables for a while, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine without that setting, one of its own for the application."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-nxtide-")
    return _own_folder[app]


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/nxtide-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)  # what is not there can't be marked
    system.deleteOnExit(place)
    return path


def save(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

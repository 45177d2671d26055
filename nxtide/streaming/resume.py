"""Loads that go on where they failed: each batch is written once, and a record says which ones are in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "batch_id long, n long, digest long"


def start_load(stream: DataFrame, path: str, progress: str, checkpoint: str, before_record: Callable[[int], None] | None = None, **trigger):
    """Starts a query that loads a stream into batches under path, each with a row (batch_id, n, digest) under progress.

    A batch is a folder of its own, which a repeated run of it writes anew, and counts only with its record, which is
    written last: whatever fails in between, loaded() shows each batch once or not at all. If the checkpoint is lost and
    an earlier batch comes again, it is left alone if it has the same rows, and is an error if not. before_record is called with the batch's id.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            now = batch.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*batch.columns)), F.lit(0)).alias("digest")).first()
            known = records(spark, progress).filter(F.col("batch_id") == batch_id).first()
            if known is not None:
                if (known["n"], known["digest"]) != (now["n"], now["digest"]):
                    raise ValueError(f"batch {batch_id} is recorded with other rows")
                return
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            if before_record:
                before_record(batch_id)
            record = spark.createDataFrame([(batch_id, now["n"], now["digest"])], RECORD)
            record.coalesce(1).write.mode("overwrite").parquet(f"{progress}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def records(spark: SparkSession, progress: str) -> DataFrame:
    """(batch_id, n, digest) of the batches that are in; none before the first load."""
    if not _there(spark, progress):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("recursiveFileLookup", True).parquet(progress)


def loaded(spark: SparkSession, path: str, progress: str, schema) -> DataFrame:
    """The rows of recorded batches, with batch_id; what an interrupted run left behind is not read."""
    if not _there(spark, path):
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("long"))
    rows = spark.read.schema(spark.createDataFrame([], schema).schema.add("batch_id", "long")).option("basePath", path).parquet(path)
    return rows.join(records(spark, progress).select("batch_id"), "batch_id", "left_semi")


def reset(spark: SparkSession, *paths: str) -> None:
    """Deletes what was loaded, its records and its checkpoint, so that the next load begins at the first batch."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

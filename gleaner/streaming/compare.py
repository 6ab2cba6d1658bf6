"""Duplicate comparison of files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import hamming_pairs


def compare_stream(spark: SparkSession, arriving: str, schema: str, state: str, checkpoint: str, hashes: list[str], cutoff: int, files_each: int = 10) -> int:
    """Compare what has arrived in a folder since the last run; returns the number of batches.

    A bounded run over all new files. Each batch compares its files with those of earlier batches and with each other,
    and writes pairs and files under the batch's number; a batch that is run again overwrites only its own folder, so
    a run that was interrupted can be repeated.
    """

    def one(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["File_ID"])
        # All files as one table, partitioned by batch: the plan doesn't grow with the batches, and those from this one on aren't read.
        stored = spark.read.schema(schema + ", batch int").option("basePath", f"{state}/files").parquet(f"{state}/files") if number else None
        earlier = spark.createDataFrame([], new.schema) if stored is None else stored.where(F.col("batch") < number).drop("batch")
        fresh = new.join(earlier, "File_ID", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{state}/files/batch={number}")
        fresh = spark.read.schema(new.schema).parquet(f"{state}/files/batch={number}")
        hamming_pairs(earlier, fresh, hashes, cutoff).write.mode("overwrite").parquet(f"{state}/pairs/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(arriving)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return len(query.recentProgress)


def pairs(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.parquet(f"{state}/pairs").drop("batch")


def class_stream(spark: SparkSession, arriving: str, schema: str, out: str, checkpoint: str, key: str = "File_Hash", files_each: int = 10) -> int:
    """Exact classes of files that keep arriving: the least id of every hash is kept as keyed state; returns the number of batches.

    A bounded run over what has arrived since the last. A hash that a batch brings is written with its least id so far, under the batch's
    number, so that a batch that is run again overwrites its own rows. State holds one id a hash, partitioned by hash and restored from the checkpoint; no
    earlier file is read again. Nulls in the hash are left out.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(arriving).where(F.col(key).isNotNull())
    changed = stream.groupBy(key).agg(F.min("File_ID").cast("long").alias("class_id"))
    query = (
        changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return len(query.recentProgress)


def classes(spark: SparkSession, out: str, key: str = "File_Hash") -> DataFrame:
    """(hash, class_id) as of the last batch: the least id that was written of each hash."""
    return spark.read.parquet(out).groupBy(key).agg(F.min("class_id").alias("class_id"))

"""Contiguous shards of nearly equal bytes (operator 8), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bucket, shuffle_parts, staged


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in order of id, at equal targets of the global prefix sum of their sizes.

    A document's size is its UTF-8 bytes plus 1. The id range is split into buckets; the buckets' totals, one row
    each, give the offset of every bucket, and a running sum inside a bucket gives the global prefix. A document
    goes to the shard that holds its middle byte, so a shard misses its target by half a document at each end.

    Null text has size 1 and checksum 0; null ids come first; repeated ids are ordered by checksum and size.
    Ids that are no numbers are all of one range, which one task numbers.
    A document larger than a target leaves the shards that it spans empty; an empty table gives no rows. Other
    columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    buckets = shuffle_parts(docs.sparkSession)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    sized = staged(sized, "sized")
    sized = sized.withColumn("bucket", range_bucket(sized, "doc_id", buckets))
    # One row a bucket, and there are at most as many buckets as shuffle partitions: the window and the broadcast are bounded.
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = sized.groupBy("bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("b").over(whole).alias("total"),
    )
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sized.join(F.broadcast(offsets), "bucket").select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.count("*").over(inside)).alias("rank"),
        (2 * (F.col("bytes_before") + F.sum("size").over(inside)) - F.col("size")).alias("middle"),
        "total",
    )
    ranked = ranked.withColumn("shard", F.expr(f"cast((middle * {shards}) div (2 * total) as int)")).drop("middle", "total")
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # at most `shards` rows
    return ranked.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

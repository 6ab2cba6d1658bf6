"""Pairings kept in buckets, edited bucket by bucket, and counts kept up to date with the edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged
from .edits import PAIR

# SQL conditions on pairs that were met (see _met): which of those given change, and which are there afterwards.
CHANGED = {"insert": "not there", "delete": "there", "toggle": "n % 2 = 1"}
AFTER = {"insert": "true", "delete": "there and n = 0", "toggle": "there <> (n % 2 = 1)"}


def _met(pairings: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(Tag_ID, Taggable_ID, n, there): every pair stored or given, how often it is given and whether it is stored; one aggregation tells both what an edit changes and what is there after it."""
    given = pairs.select(*PAIR, F.lit(1).alias("n"), F.lit(False).alias("there"))
    if kind == "delete":
        given = given.dropna(subset=PAIR)  # a null equals nothing that could be deleted
    both = given.unionByName(pairings.select(*PAIR, F.lit(0).alias("n"), F.lit(True).alias("there")))
    return both.groupBy(PAIR).agg(F.sum("n").alias("n"), F.max("there").alias("there"))


def _change(met: DataFrame, kind: str) -> DataFrame:
    return met.where("n > 0").where(CHANGED[kind]).select(*PAIR, F.when(F.col("there"), -1).otherwise(1).alias("change"))


def effect(pairings: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(Tag_ID, Taggable_ID, change): what an edit does to pairings: 1 for pairs that come, -1 for pairs that go.

    Pairs that an insert finds, or a delete doesn't, change nothing; a toggle counts pairs given an odd number of times.
    """
    return _change(_met(pairings, pairs, kind), kind)


class Bucketed:
    """A table of pairings in a folder, partitioned by a hash of Taggable_ID, so that an edit reads and writes the buckets of its taggables only.

    New contents of the buckets are written to the shared folder first and then take the place of those partitions. Inserts and deletes that were
    interrupted can be run again; a toggle can't, since it may have been done in some of its buckets.
    """

    SCHEMA = "Tag_ID long, Taggable_ID long, bucket int"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("Taggable_ID").cast("long")), F.lit(self.buckets)).cast("int")

    def _write(self, pairs: DataFrame, mode: str, of: DataFrame | None = None) -> None:
        """Pairs by bucket; a bucket named in `of` is written even if it has none, by a row of nulls that readers leave out."""
        rows = pairs.select(*(F.col(c).cast("long").alias(c) for c in PAIR)).withColumn("bucket", self._bucket())
        if of is not None:
            rows = rows.unionByName(of.select(*(F.lit(None).cast("long").alias(c) for c in PAIR), "bucket"))
        rows = rows.repartition("bucket").sortWithinPartitions("bucket", *PAIR)
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.folder)

    def create(self, pairings: DataFrame) -> Bucketed:
        """Write all pairings; the folder must not be there yet."""
        every = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        self._write(pairings.distinct(), "error", every)
        return self

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All pairings, or those of some buckets: then only their partitions are listed and read."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("Tag_ID").isNotNull()).select(PAIR)

    def edit(self, pairs: DataFrame, kind: str) -> DataFrame:
        """Insert, delete or toggle pairs; returns the effect (see effect), written down."""
        pairs = staged(pairs.select(*(F.col(c).cast("long").alias(c) for c in PAIR)), "edit")
        touched = pairs.select(self._bucket().alias("bucket")).distinct()
        numbers = sorted(r.bucket for r in touched.collect())  # at most as many as there are buckets
        before = self.read(numbers)
        met = staged(_met(before, pairs, kind), "edited")  # what is read must not be what is being replaced
        if numbers:
            self._write(met.where(AFTER[kind]), "overwrite", touched)
        return _change(met, kind)


def multiplicities(groups: DataFrame, pairings: DataFrame) -> DataFrame:
    """(gid, Taggable_ID, n): how many tags of a group (gid, Tag_ID) a taggable carries; none without."""
    held = pairings.join(groups.select("gid", "Tag_ID").distinct(), "Tag_ID").select("gid", "Tag_ID", "Taggable_ID").distinct()
    return held.groupBy("gid", "Taggable_ID").agg(F.count("*").alias("n"))


def count_changes(held: DataFrame, groups: DataFrame, change: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held after, changes of counts): (gid, Taggable_ID, n) and (gid, change), from the effect of an edit.

    A taggable counts for a group while it carries any of its tags, so a group's count changes by those whose multiplicity leaves or reaches 0.
    Only what the edit names meets `held`; changes of several edits, or of buckets, add up.
    """
    delta = change.join(groups.select("gid", "Tag_ID").distinct(), "Tag_ID").groupBy("gid", "Taggable_ID").agg(F.sum("change").alias("d")).where("d <> 0")
    keys = ["gid", "Taggable_ID"]
    met = staged(delta.join(held, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("before"), (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n")), "multiplicities")
    after = held.join(met.select(keys), keys, "left_anti").unionByName(met.where("n > 0").select(*keys, "n"))
    changes = met.groupBy("gid").agg((F.count_if(F.col("n") > 0) - F.count_if(F.col("before") > 0)).alias("change")).where("change <> 0")
    return after, changes


def add_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """(gid, count) with the changes added; a group whose count comes to 0 goes."""
    both = counts.select("gid", F.col("count").alias("n")).unionByName(changes.select("gid", F.col("change").alias("n")))
    return both.groupBy("gid").agg(F.sum("n").alias("count")).where("count <> 0")

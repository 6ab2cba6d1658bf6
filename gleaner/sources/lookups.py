"""Tables sorted by a name, of which lookups and prefix searches read the files that can hold it only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, name: str, folder: str, files: int = 64) -> None:
    """df in ranges of a string column, sorted, about `files` of them, with a Bloom filter of it and a list of the files' least and greatest names.

    Nulls can't be looked up and are left out.
    """
    rows = df.where(F.col(name).isNotNull()).repartitionByRange(files, name).sortWithinPartitions(name)
    rows.write.option(f"parquet.bloom.filter.enabled#{name}", "true").parquet(f"{folder}/rows")
    held = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    held.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(name).alias("least"), F.max(name).alias("greatest")).coalesce(1).write.parquet(f"{folder}/files")


def after_prefix(prefix: str) -> str | None:
    """The least string that is greater than all that begin with prefix, in order of code points; None if there is none."""
    while prefix:
        last = ord(prefix[-1]) + 1
        if last == 0xD800:  # no text holds half a pair
            last = 0xE000
        if last <= 0x10FFFF:
            return prefix[:-1] + chr(last)
        prefix = prefix[:-1]
    return None


def _read(spark: SparkSession, folder: str, schema: str, may: Column, where: Column) -> DataFrame:
    # A row for each file; those that may hold what is looked for.
    files = [r.file for r in spark.read.parquet(f"{folder}/files").where(may).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(where)


def lookup(spark: SparkSession, folder: str, schema: str, name: str, wanted: list[str]) -> DataFrame:
    """Rows whose name is one of those wanted."""
    may = F.exists(F.array(*map(F.lit, wanted)).cast("array<string>"), lambda w: (F.col("least") <= w) & (w <= F.col("greatest")))
    return _read(spark, folder, schema, may, F.col(name).isin(wanted))


def beginning(spark: SparkSession, folder: str, schema: str, name: str, prefix: str) -> DataFrame:
    """Rows whose name begins with prefix: a range of names, which statistics of row groups prune too."""
    end = after_prefix(prefix)
    may, where = F.col("greatest") >= prefix, F.col(name) >= prefix
    if end is not None:
        may, where = may & (F.col("least") < end), where & (F.col(name) < end)
    return _read(spark, folder, schema, may, where)

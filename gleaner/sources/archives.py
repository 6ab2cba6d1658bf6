"""Sidecar folders and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sidecar kinds, thumbnails, the association of what is imported, the types of backup items, and the delimiter between them.
SIDECARS = ["tags", "notes", "urls", "arctime", "modtime", "imptime", "deltime", "pimtime", "lavtime"]
THUMBNAILS = r"\.(thumb|prethumb)\.jpg$"
DELIMITER = "DELIMITER__fuihi873ohr87hnfuidwnfufh3e2oi8fwefa__"
TAGGABLE_SERVICE, TAG_SERVICE, METRIC_SERVICE, METRIC, FILE = range(5)
DATES = {"imptime": "Taggable_Created_Date", "deltime": "Taggable_Deleted_Date", "modtime": "Taggable_Last_Modified_Date", "lavtime": "Taggable_Last_Viewed_Date"}


class DuplicateName(ValueError):
    """Two media files of one base name."""


def lines(c: Column) -> Column:
    """Trimmed lines of a text."""
    return F.transform(F.split(c, "\n"), lambda line: F.trim(line))


def epoch(c: Column) -> Column:
    """The whole number that a text begins with, as seconds since 1970; null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")


def split_tag(c: Column) -> Column:
    """(namespace, name): the first colon splits, unless it stands first or there is none (namespace null)."""
    at = F.instr(c, ":")
    return F.struct(F.when(at > 1, F.substr(c, F.lit(1), at - 1)).alias("namespace"), F.when(at > 1, F.substr(c, at + 1)).otherwise(c).alias("name"))


_KIND = r"\.(" + "|".join(SIDECARS) + r")\.txt$"


def read_sidecars(spark: SparkSession, folder: str, check: bool = True) -> DataFrame:
    """A row for each media file of an unpacked archive with what its sidecars say (see _sidecars).

    Sidecars are read as text, media files only listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    pattern = "*.{" + ",".join(SIDECARS) + "}.txt"
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return _sidecars(files, texts.select(F.col("_metadata.file_path").alias("path"), "value"), check)


def read_archive(spark: SparkSession, paths: str | list[str], check: bool = True, task_bytes: int = 64 << 20) -> DataFrame:
    """As read_sidecars, of a zip file that is not unpacked, or of one cut into volumes (.zip.001, .zip.002, ...).

    The archive must be on a file system that all machines mount. Its directory tells what each task reads: about task_bytes of
    packed sidecars. Media files are listed from the directory, never unpacked.
    """
    from .zips import ZipSource

    spark.dataSource.register(ZipSource)
    paths = [paths] if isinstance(paths, str) else paths
    entries = spark.read.format("zip").option("paths", "\n".join(paths)).option("unpack", _KIND).option("taskBytes", str(task_bytes)).load()
    return _sidecars(entries.select("path"), entries.where("content is not null").select("path", F.decode("content", "utf-8").alias("value")), check)


def _sidecars(files: DataFrame, texts: DataFrame, check: bool) -> DataFrame:
    """files (path) and the texts (path, value) of sidecars as rows of media files: name, extension, path, tags (array of
    namespace, name), notes, urls, and four dates in epoch seconds.

    Thumbnails are left out, as are sidecars without a media file.
    """
    base = F.element_at(F.split("path", "/"), -1)
    kind = F.regexp_extract("base", _KIND, 1)
    listed = files.select("path", base.alias("base")).where(~F.col("base").rlike(THUMBNAILS)).withColumn("kind", kind)
    media = listed.where("kind = ''")
    if check and not (twice := media.groupBy("base").count().where("count > 1")).isEmpty():
        raise DuplicateName(twice.first().base)
    texts = texts.select(base.alias("base"), "value").withColumn("kind", kind)
    name = F.regexp_replace("base", _KIND, "")
    sides = texts.select(name.alias("name"), "kind", "value").groupBy("name").pivot("kind", SIDECARS).agg(F.first("value"))
    joined = media.select(F.col("base").alias("name"), "path").join(sides, "name", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "name", F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("extension"), "path",
        F.transform(F.coalesce(lines(F.col("tags")), none), split_tag).alias("tags"),
        F.coalesce(lines(F.col("notes")), none).alias("notes"), F.coalesce(lines(F.col("urls")), none).alias("urls"),
        *(epoch(F.col(k)).alias(v) for k, v in DATES.items()),
    )


def import_tables(sidecars: DataFrame, service: int) -> dict[str, DataFrame]:
    """The tables that an import adds, without ids: taggables, tags (namespaces of one tag are put together), pairs, notes, urls."""
    one = sidecars.select("name", F.explode("tags").alias("t")).select("name", "t.namespace", F.col("t.name").alias("tag"))
    spaces = F.filter(F.array_sort(F.collect_set("namespace")), lambda n: n.isNotNull())
    return {
        "taggables": sidecars.select("name", "extension", *DATES.values()),
        "tags": one.groupBy(F.col("tag").alias("Lookup_Name")).agg(spaces.alias("Namespaces")).withColumn("Local_Tag_Service_ID", F.lit(service)),
        "pairs": one.select("name", "tag").distinct(),
        "notes": sidecars.select("name", F.explode("notes").alias("note")),
        "urls": sidecars.select("name", F.explode("urls").alias("url")),
    }


def backup_items(taggable_services: DataFrame, tag_services: DataFrame, metric_services: DataFrame, metrics: DataFrame, files: DataFrame, tags: DataFrame, applied: DataFrame) -> list[DataFrame]:
    """The parts of a backup in order: services of each kind, metrics, then every file with its tags and metrics.

    Each has its Type and the columns of its table. files has File_ID; tags has File_ID, Lookup_Name, Source_Name,
    Namespaces, Local_Tag_Service_ID; applied has File_ID, Local_Metric_ID, User_ID, Applied_Value.
    """
    typed = lambda df, kind: df.select(F.lit(kind).alias("Type"), *df.columns)
    gathered = lambda df, name: df.groupBy("File_ID").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "File_ID")))).alias(name))
    held = files.join(gathered(tags, "Tags"), "File_ID", "left").join(gathered(applied, "Metrics"), "File_ID", "left")
    none = [F.coalesce(c, F.array().cast(held.schema[c].dataType)).alias(c) for c in ("Tags", "Metrics")]
    held = held.select(*files.columns, *none)
    return [typed(taggable_services, TAGGABLE_SERVICE), typed(tag_services, TAG_SERVICE), typed(metric_services, METRIC_SERVICE), typed(metrics, METRIC), typed(held, FILE)]


_BETWEEN = f',"{DELIMITER}",'


def write_export(items: DataFrame, order: list[str], folder: str) -> None:
    """Items as the one array that an export is, with delimiters between them: the files of begin, items and end, in order of their names, one after another.

    `order` tells items apart. Ranges of it are written in parallel, so an export of any size has no task that sees all of it; every item
    but the first brings the delimiter before it.
    """
    spark = items.sparkSession
    least = items.agg(F.min(F.struct(*order)).alias("first")).first()["first"]  # one row
    held = F.to_json(F.struct(*items.columns))
    first = F.lit(True)
    for c in order:
        first = first & F.col(c).eqNullSafe(F.lit(None if least is None else least[c]))
    rows = items.select(*order, F.when(first, held).otherwise(F.concat(F.lit(_BETWEEN), held)).alias("value"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(f"{folder}/items")
    for name, sign in (("begin", "["), ("end", "]")):
        spark.createDataFrame([(sign,)], "value string").coalesce(1).write.text(f"{folder}/{name}")


def read_export(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Items of an export, be it one file or those that write_export leaves: delimiters end records, so one large file is read by many tasks.

    The brackets around all items, white space and what is empty are left out.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", _BETWEEN).text(path)
    item = F.regexp_replace(F.regexp_replace("value", r"^\s*\[?\s*", ""), r"\s*\]?\s*$", "")
    return text.select(item.alias("item")).where("item <> ''").select(F.from_json("item", schema).alias("i")).select("i.*")


def backup_lines(items: DataFrame) -> DataFrame:
    """Rows of any columns as JSON items (value)."""
    return items.select(F.to_json(F.struct(*items.columns)).alias("value"))


def write_backup(parts: list[DataFrame], folder: str) -> None:
    """Typed items, one JSON object a line, a folder for each part in order (services, metrics, files)."""
    for k, items in enumerate(parts):
        backup_lines(items).write.text(f"{folder}/{k:02d}")


def read_backup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a backup as write_backup leaves it, one a line; a line may also be a whole array with delimiters, which one task reads (see read_export for large ones)."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    body = F.trim("value")
    inside = F.split(F.regexp_replace(body, r"^\[|\]$", ""), _BETWEEN)
    items = text.select(F.explode(F.when(body.startswith("["), inside).otherwise(F.array(body))).alias("item")).where("trim(item) <> ''")
    return items.select(F.from_json("item", schema).alias("i")).select("i.*")

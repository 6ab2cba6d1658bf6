"""Import of files with their tags, metrics, addresses, notes and dates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..plans.collection import Collection
from ..sources.staging import staged
from .edits import PAIR, apply_metric, metric_names, upsert

DATES = ["Taggable_Created_Date", "Taggable_Last_Modified_Date", "Taggable_Last_Viewed_Date", "Taggable_Deleted_Date"]
SYSTEM_SERVICE = 0  # of the tags that say what is known of a taggable
TAG_KEY = ["Local_Tag_Service_ID", "Lookup_Name", "Source_Name"]
IMPORTABLE = (
    "File_Hash string, File_Extension string, Taggable_Name string, Service_ID int, "
    "Tags array<struct<Local_Tag_Service_ID:int,Lookup_Name:string,Source_Name:string,Display_Name:string,Namespaces:array<string>>>, "
    "Metrics array<struct<Local_Metric_ID:int,User_ID:bigint,Applied_Value:double>>, URLs array<struct<url:string,association:string>>, "
    "Notes array<struct<association:string,note:string>>, " + ", ".join(f"{d} long" for d in DATES)
)


@dataclass
class Archive:
    """A collection and what it knows of files: files (File_ID, File_Hash, File_Extension), taggable_files (Taggable_ID, File_ID,
    Taggable_Name), notes (Taggable_ID, association, note), dates (Taggable_ID and DATES)."""

    collection: Collection
    files: DataFrame
    taggable_files: DataFrame
    notes: DataFrame
    dates: DataFrame

    @classmethod
    def of(cls, c: Collection) -> Archive:
        """With no file yet."""
        make = lambda rows, schema: c.taggables.sparkSession.createDataFrame(rows, schema).where(F.lit(False))  # known to be empty before anything runs
        return cls(
            c, make([], "File_ID long, File_Hash string, File_Extension string"), make([], "Taggable_ID long, File_ID long, Taggable_Name string"),
            make([], "Taggable_ID long, association string, note string"), make([], "Taggable_ID long, " + ", ".join(f"{d} long" for d in DATES)),
        )


def facts(rows: DataFrame, applied: DataFrame, metrics: DataFrame) -> DataFrame:
    """(Lookup_Name, Taggable_ID) of the system tags that say a file's hash, extension and service, its addresses, alone and with association, and its metrics, as often as they are said.

    rows: Taggable_ID, File_Hash, File_Extension, Service_ID, URLs.
    """
    own = F.array(names.of_hash(F.col("File_Hash")), names.of_extension(F.col("File_Extension")), names.of_service(F.col("Service_ID")))
    # An address with an association is one name; without, it has the name of the address alone.
    of_url = F.flatten(F.transform(F.coalesce("URLs", F.array().cast("array<struct<url:string,association:string>>")), lambda u: F.array(names.of_url(u["url"]), names.of_url_association(u["url"], u["association"]))))
    said = rows.select(F.explode(F.array_compact(F.concat(own, of_url))).alias("Lookup_Name"), "Taggable_ID")
    return said.unionByName(metric_names(applied, metrics))


def key_hash() -> Column:
    """64 bits of TAG_KEY; nulls in different places differ."""
    return F.xxhash64(*(F.col(k).isNull() for k in TAG_KEY), F.col(TAG_KEY[0]).cast("long"), *TAG_KEY[1:])


def with_tag_ids(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """rows (TAG_KEY, h: their key_hash) whose tags are all in tags, with Tag_ID and without the key.

    Where no two tags have the same hash, it tells them apart and names need not be shuffled; else names are compared (null is a name like others).
    """
    hashed = tags.select("Tag_ID", *TAG_KEY, key_hash().alias("h"))
    if hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows.drop(*TAG_KEY).join(hashed.select("Tag_ID", "h"), "h").drop("h")
    named = hashed.select("Tag_ID", *(F.col(k).alias(f"k{i}") for i, k in enumerate(TAG_KEY)))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(TAG_KEY)))
    return rows.join(named, same).drop("h", *TAG_KEY, *named.columns[1:])


def import_files(a: Archive, importables: DataFrame) -> Archive:
    """The archive with importables (IMPORTABLE) in it. Importing the same rows again changes nothing.

    A file is known by its hash, a taggable by its file and service, a tag by its service, lookup name and source, a namespace by its name. Rows
    of one hash and service are one taggable: tags, addresses and notes are put together, of dates and names the largest counts, where null
    is the least; a date that is null leaves the one that is there. Values of a metric take the place of those that
    the same user gave before. Rows without a hash are left out. Null lists are empty.

    Ids are given by upserts; each of the tables that get some is written once.
    """
    c = a.collection
    rows = staged(importables.where(F.col("File_Hash").isNotNull()), "importables")
    key = ["File_Hash", "Service_ID"]

    files = staged(upsert(a.files, rows.select(F.lit(None).cast("long").alias("File_ID"), "File_Hash", "File_Extension"), ["File_Hash"], "File_ID"), "files")
    known = staged(c.taggables.join(a.taggable_files, "Taggable_ID", "left").select("Taggable_ID", "Service_ID", "In_Trash", "File_ID", "Taggable_Name"), "known")
    new = rows.groupBy(key).agg(F.max(F.coalesce("Taggable_Name", "File_Hash")).alias("Taggable_Name")).join(files.select("File_ID", "File_Hash"), "File_Hash")
    new = new.select(F.lit(None).cast("long").alias("Taggable_ID"), "Service_ID", F.lit(False).alias("In_Trash"), "File_ID", "Taggable_Name")
    taggables = staged(upsert(known, new, ["File_ID", "Service_ID"], "Taggable_ID", among="File_ID is not null"), "taggables")
    ids = taggables.where("File_ID is not null").join(files, "File_ID").select("Taggable_ID", "File_ID", *key)
    rows = staged(rows.join(ids, key), "imported")

    applied = rows.select("Taggable_ID", F.explode("Metrics").alias("m")).select("m.Local_Metric_ID", "m.User_ID", "Taggable_ID", "m.Applied_Value")
    applied = staged(applied.groupBy("Local_Metric_ID", "User_ID", "Taggable_ID").agg(F.max("Applied_Value").alias("Applied_Value")), "applied")
    said = facts(rows, applied, c.metrics).withColumn("Local_Tag_Service_ID", F.lit(SYSTEM_SERVICE)).withColumn("Source_Name", F.lit(names.SYSTEM_SOURCE))
    given = rows.select("Taggable_ID", F.explode("Tags").alias("t")).select("t.*", "Taggable_ID")
    both = staged(given.unionByName(said, allowMissingColumns=True).withColumn("h", key_hash()), "given")

    new = both.select(F.lit(None).cast("long").alias("Tag_ID"), "h", *TAG_KEY, "Display_Name")
    known = c.tags.select("Tag_ID", key_hash().alias("h"), *TAG_KEY, "Display_Name")
    tags = staged(upsert(known, new, ["h", *TAG_KEY], "Tag_ID", fill={"Display_Name": "Lookup_Name"}).drop("h"), "tags")  # h: names begin alike, and sort faster behind it
    with_ids = with_tag_ids(both.drop("Display_Name"), tags)
    spaces = staged(with_ids.select("Tag_ID", F.explode("Namespaces").alias("Namespace_Name")).where("Namespace_Name is not null").distinct(), "spaces")
    new = spaces.select(F.lit(None).cast("int").alias("Namespace_ID"), "Namespace_Name")
    namespaces = staged(upsert(c.namespaces.select("Namespace_ID", "Namespace_Name"), new, ["Namespace_Name"], "Namespace_ID").withColumn("Namespace_ID", F.col("Namespace_ID").cast("int")), "namespaces")
    of_tags = spaces.join(namespaces, "Namespace_Name").select("Tag_ID", "Namespace_ID")

    pairs = c.pairing_rows.select(PAIR).unionByName(with_ids.select(PAIR))  # made distinct once, however many imports follow each other

    collection = c.with_(
        taggables=taggables.select("Taggable_ID", "Service_ID", "In_Trash"), tags=tags, namespaces=namespaces, tags_namespaces=c.tags_namespaces.select("Tag_ID", "Namespace_ID").unionByName(of_tags).distinct(),
        pairings=pairs.distinct(), pairing_rows=pairs, applied_metrics=apply_metric(c.applied_metrics, applied),
    )
    notes = rows.select("Taggable_ID", F.explode("Notes").alias("n")).select("Taggable_ID", "n.association", "n.note")
    dates = rows.groupBy("Taggable_ID").agg(*(F.max(d).alias(f"new_{d}") for d in DATES))
    dates = a.dates.join(dates, "Taggable_ID", "full").select("Taggable_ID", *(F.coalesce(f"new_{d}", d).alias(d) for d in DATES))
    return Archive(collection, files, taggables.where("File_ID is not null").select("Taggable_ID", "File_ID", "Taggable_Name"), a.notes.unionByName(notes).distinct(), dates)

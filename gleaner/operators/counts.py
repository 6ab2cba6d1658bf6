"""Counts of tags over search results, tag groups, and the tag filter box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bitmaps import counts_of
from ..plans.collection import Collection


def group_counts(groups: DataFrame, pairings: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(group_id, count): distinct taggables of the search result that carry any tag of the group; 0 for none.

    groups: group_id, Tag_ID. pairings: repeated or not (a collection's pairing_rows save making them distinct). found: Taggable_ID; None counts over all pairings.
    """
    counts = counts_of(groups.select(F.col("group_id").alias("gid"), "Tag_ID"), pairings, found)
    return _with_counts(groups.select("group_id").distinct(), "group_id", counts)


def _with_counts(groups: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """groups with the counts of those that have one, 0 for the others."""
    return groups.join(counts, F.col(key) == F.col("gid"), "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).drop("gid")


def tag_groups(c: Collection, services: list[int] | None = None) -> DataFrame:
    """Tags put together by namespaces and lookup name: Namespaces (sorted), Lookup_Name, Display_Name, tag_ids.

    Display_Name is ns:name, or multi-namespaced:name for several namespaces, or the name alone.
    """
    tags = c.tags if services is None else c.tags.where(F.col("Local_Tag_Service_ID").isin(services))
    spaces = c.tags_namespaces.join(c.namespaces, "Namespace_ID").groupBy("Tag_ID").agg(F.array_sort(F.collect_set("Namespace_Name")).alias("Namespaces"))
    named = tags.join(spaces, "Tag_ID", "left").withColumn("Namespaces", F.coalesce("Namespaces", F.array().cast("array<string>")))
    n = F.size("Namespaces")
    shown = F.when(n == 0, F.col("Lookup_Name")).when(n == 1, F.concat_ws(":", F.get("Namespaces", F.lit(0)), "Lookup_Name")).otherwise(F.concat(F.lit("multi-namespaced:"), "Lookup_Name"))
    return named.groupBy("Namespaces", "Lookup_Name").agg(F.array_sort(F.collect_set("Tag_ID")).alias("tag_ids")).select("Namespaces", "Lookup_Name", shown.alias("Display_Name"), "tag_ids")


def service_counts(c: Collection, services: list[int] | None, found: DataFrame | None = None) -> DataFrame:
    """Tag groups of services with the count of the taggables found that carry them. A group is known by its least tag, as a tag is in one group."""
    groups = tag_groups(c, services).withColumn("least", F.get("tag_ids", F.lit(0)))
    counts = counts_of(groups.select(F.col("least").alias("gid"), F.explode("tag_ids").alias("Tag_ID")), c.pairing_rows, found)
    return _with_counts(groups, "least", counts).drop("least")


def namespace_counts(c: Collection, namespace_id: int, found: DataFrame | None = None) -> DataFrame:
    """As service_counts, of the tags of one namespace."""
    mine = c.tags_namespaces.where(F.col("Namespace_ID") == namespace_id).select("Tag_ID")
    return service_counts(c.with_(tags=c.tags.join(mine, "Tag_ID", "left_semi")), None, found)


def tags_of(ids: DataFrame, pairings: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(Taggable_ID, tag_ids): the tags of each id, sorted, of those in `tags` if that is given; an empty array for none."""
    held = pairings if tags is None else pairings.join(tags.select("Tag_ID").distinct(), "Tag_ID", "left_semi")
    held = ids.select("Taggable_ID").distinct().join(held, "Taggable_ID", "left")
    return held.groupBy("Taggable_ID").agg(F.array_sort(F.collect_set("Tag_ID")).alias("tag_ids"))


def groups_of(ids: DataFrame, c: Collection, services: list[int]) -> DataFrame:
    """(Taggable_ID, groups): display names of the distinct tag groups of each id within services, sorted."""
    groups = tag_groups(c, services).select("Display_Name", F.explode("tag_ids").alias("Tag_ID"))
    held = c.pairings.join(ids.select("Taggable_ID").distinct(), "Taggable_ID").join(groups, "Tag_ID").groupBy("Taggable_ID").agg(F.array_sort(F.collect_set("Display_Name")).alias("groups"))
    return ids.select("Taggable_ID").distinct().join(held, "Taggable_ID", "left").select("Taggable_ID", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"))


def invert(rows: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """From (key, array of items) to (item, sorted array of keys)."""
    return rows.select(key, F.explode(items).alias(item)).groupBy(item).agg(F.array_sort(F.collect_set(key)).alias(f"{key}s"))


def filter_box(groups: DataFrame, typed: str) -> DataFrame:
    """Tag groups that what was typed finds.

    It splits at `:`; some last parts, joined again, must begin the name, and the parts before them each be a namespace
    of the group; or else the last part must begin a namespace and the parts before it each be one.
    """
    parts = typed.split(":")
    hit = F.lit(False)
    for k in range(len(parts)):
        spaces, name = parts[:k], ":".join(parts[k:])
        here = F.col("Lookup_Name").startswith(name)
        for s in spaces:
            here = here & F.array_contains("Namespaces", s)
        hit = hit | here
    begins = F.exists("Namespaces", lambda n: F.startswith(n, F.lit(parts[-1])))
    for s in parts[:-1]:
        begins = begins & F.array_contains("Namespaces", s)
    return groups.where(hit | begins)


def prune(groups: DataFrame, removed: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """Groups with a count, without those removed (Namespaces, Lookup_Name), with pending additions of count 0 put behind."""
    kept = groups.where("count > 0")
    if removed is not None:
        kept = kept.join(removed, ["Namespaces", "Lookup_Name"], "left_anti")
    return kept if pending is None else kept.unionByName(pending, allowMissingColumns=True)


def by_count(groups: DataFrame) -> DataFrame:
    """Largest count first, then by name."""
    return groups.orderBy(F.desc("count"), "Display_Name")

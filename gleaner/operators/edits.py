"""Edits of a collection: each function takes old tables and gives new ones."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.collection import Collection, with_metrics
from ..sources.archives import import_tables
from ..sources.staging import staged

PAIR = ["Tag_ID", "Taggable_ID"]


class MissingParent(ValueError):
    """A pairing names a tag or a taggable that isn't there."""


def insert_ids(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """known with the rows of new whose key isn't there yet (one of each key)."""
    fresh = new.dropDuplicates([key]).join(known, key, "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def delete_ids(c: Collection, tags: DataFrame | None = None, taggables: DataFrame | None = None) -> Collection:
    """Without these tags or taggables and all their pairings."""
    if tags is not None:
        c = c.with_(tags=c.tags.join(tags, "Tag_ID", "left_anti"), tags_namespaces=c.tags_namespaces.join(tags, "Tag_ID", "left_anti"), pairings=c.pairings.join(tags, "Tag_ID", "left_anti"))
    if taggables is not None:
        c = c.with_(taggables=c.taggables.join(taggables, "Taggable_ID", "left_anti"), applied_metrics=c.applied_metrics.join(taggables, "Taggable_ID", "left_anti"), pairings=c.pairings.join(taggables, "Taggable_ID", "left_anti"))
    return c


def missing_ids(known: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those of ids that aren't known: none if all exist."""
    return ids.select(key).distinct().join(known, key, "left_anti")


def services_of(ids: DataFrame, table: DataFrame, key: str, service: str) -> DataFrame:
    """The distinct services of some ids of a table (tags, metrics, taggables)."""
    return table.join(ids.select(key).distinct(), key, "left_semi").select(service).distinct()


def packet_bytes(rows: DataFrame) -> DataFrame:
    """(n, bytes) of rows as JSON lines."""
    return rows.select(F.octet_length(F.to_json(F.struct(*rows.columns))).cast("long").alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))


def with_parents(c: Collection, pairs: DataFrame) -> Collection:
    """The collection with every tag and taggable that the pairs name; those that are new have no service and no name."""
    tags = insert_ids(c.tags, pairs.select("Tag_ID"), "Tag_ID")
    taggables = insert_ids(c.taggables, pairs.select("Taggable_ID"), "Taggable_ID").withColumn("In_Trash", F.coalesce("In_Trash", F.lit(False)))
    return c.with_(tags=tags, taggables=taggables)


def edit_pairs(c: Collection, pairs: DataFrame, edit: Callable[[DataFrame, DataFrame], DataFrame]) -> Collection:
    """An edit of pairings (insert_pairs, delete_pairs, toggle_pairs) before which the ids it names are inserted."""
    return with_parents(c, pairs).with_(pairings=edit(c.pairings, pairs))


def check_parents(c: Collection, pairs: DataFrame) -> None:
    lost = pairs.join(c.tags, "Tag_ID", "left_anti").unionByName(pairs.join(c.taggables, "Taggable_ID", "left_anti"))
    if not lost.isEmpty():
        raise MissingParent(str(lost.first()))


def insert_pairs(pairings: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairings.select(PAIR).unionByName(pairs.select(PAIR)).distinct()


def delete_pairs(pairings: DataFrame, pairs: DataFrame) -> DataFrame:
    """A pair that isn't there is no error."""
    return pairings.select(PAIR).join(pairs, PAIR, "left_anti")


def toggle_pairs(pairings: DataFrame, pairs: DataFrame) -> DataFrame:
    """A pair given an odd number of times goes if it is there and comes if it isn't."""
    both = pairings.select(*PAIR, F.lit(1).alias("n")).unionByName(pairs.select(*PAIR, F.lit(1).alias("n")))
    return both.groupBy(PAIR).agg(F.sum("n").alias("n")).where("n % 2 = 1").select(PAIR)


def upsert(known: DataFrame, new: DataFrame, keys: list[str], id_col: str, order: str | None = None, fill: dict[str, str] | None = None, among: str = "true") -> DataFrame:
    """known with the rows of new whose keys aren't there (null is a key like others); of rows with equal keys the last in order, or
    without an order the largest value of each column; fill: columns whose nulls then take another's value;
    among: which rows of known can have a key of new. Ids go on from the largest.

    One aggregation of stored and given rows tells what is there. What isn't is written, numbered inside its partitions as it lies, and
    shifted by the partitions' totals: no task sees all new rows and none is sorted for its id.
    """
    others = [c for c in new.columns if c not in (*keys, id_col)]
    both = new.select(*keys, *others, F.lit(False).alias("__held")).unionByName(known.where(among).select(*keys, F.lit(True).alias("__held")), allowMissingColumns=True)
    if order is None:
        values = [F.max(c).alias(c) for c in others]
    else:
        values = [F.max_by(F.struct(*others), F.struct(~F.col("__held"), F.col(order))).alias("__r")] if others else []
    fresh = both.groupBy(keys).agg(F.max("__held").alias("__held"), *values).where(~F.col("__held"))
    fresh = fresh.select(*keys, *others) if order is None else fresh.select(*keys, *(F.col("__r")[c].alias(c) for c in others))
    for c, other in (fill or {}).items():
        fresh = fresh.withColumn(c, F.coalesce(c, other))
    fresh = staged(fresh.withColumn("__at", F.monotonically_increasing_id()), "fresh")  # the partition, above 33 bits of the row in it
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = fresh.groupBy(part.alias("__b")).agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))  # a row for each partition
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    numbered = fresh.withColumn("__b", part).join(F.broadcast(shift), "__b").withColumn(id_col, F.lit(top) + F.col("__shift") + row + 1)
    return known.unionByName(numbered.select(*known.columns))


def apply_metric(applied: DataFrame, values: DataFrame) -> DataFrame:
    """values (Local_Metric_ID, User_ID, Taggable_ID, Applied_Value) take the place of the same users' values of the same metrics on the same taggables."""
    old = applied.alias("old")
    keys = values.select(F.col("Local_Metric_ID").alias("m"), F.col("User_ID").alias("u"), F.col("Taggable_ID").alias("t")).distinct()
    same = (F.col("Local_Metric_ID") == F.col("m")) & F.col("User_ID").eqNullSafe(F.col("u")) & (F.col("Taggable_ID") == F.col("t"))
    return old.join(keys, same, "left_anti").unionByName(values)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key before they are made distinct or counted: where nearly every row is a group of its own, a task that did so before the shuffle would hold all it reads."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def metric_names(applied: DataFrame, metrics: DataFrame) -> DataFrame:
    """As metric_facts, each as often as a value says it."""
    known = with_metrics(applied, metrics, "Local_Metric_Service_ID")
    facts = F.array(
        names.of_applied(F.col("Applied_Value"), F.col("Local_Metric_ID"), F.col("User_ID")), names.of_metric(F.col("Local_Metric_ID")), names.of_metric_service(F.col("Local_Metric_Service_ID"))
    )
    return known.select(F.explode(facts).alias("Lookup_Name"), "Taggable_ID")


def metric_facts(applied: DataFrame, metrics: DataFrame) -> DataFrame:
    """(Lookup_Name, Taggable_ID) of the system tags that applied values stand for: the value, that there is one of the metric, and of its service."""
    return metric_names(dealt(applied, "Taggable_ID"), metrics).distinct()


def system_pairs(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs of facts (Lookup_Name, Taggable_ID) with the system tags of those names: joined by name, never by position."""
    mine = tags.where(F.col("Source_Name") == names.SYSTEM_SOURCE).select("Tag_ID", "Lookup_Name")
    return facts.join(mine, "Lookup_Name").select(PAIR).distinct()


def tag_to_metric(c: Collection, tag_id: int, metric_id: int, user: int | None, value: float, delete_tag: bool = False) -> Collection:
    """All taggables of a tag get a value of a metric; the tag may go."""
    held = c.pairings.where(F.col("Tag_ID") == tag_id).select("Taggable_ID")
    values = held.select(F.lit(metric_id).alias("Local_Metric_ID"), F.lit(user).cast("long").alias("User_ID"), "Taggable_ID", F.lit(float(value)).alias("Applied_Value"))
    c = c.with_(applied_metrics=apply_metric(c.applied_metrics, values))
    return delete_ids(c, tags=c.tags.where(F.col("Tag_ID") == tag_id).select("Tag_ID")) if delete_tag else c


def edit_tags(c: Collection, ids: DataFrame, add: list[str], remove: list[str], service: int) -> Collection:
    """Take away by name, then add by name (source "User added"; new tags are made) on all ids."""
    spark = ids.sparkSession
    gone = c.tags.where(F.col("Lookup_Name").isin(remove) & (F.col("Local_Tag_Service_ID") == service)).select("Tag_ID")
    doomed = c.pairings.join(gone, "Tag_ID", "left_semi").join(ids, "Taggable_ID", "left_semi")
    pairings = delete_pairs(c.pairings, doomed)
    if add:
        new = spark.createDataFrame([(service, n, "User added", n, i) for i, n in enumerate(add)], "Local_Tag_Service_ID int, Lookup_Name string, Source_Name string, Display_Name string, at int")
        new = new.withColumn("Tag_ID", F.lit(None).cast("long"))
        tags = upsert(c.tags, new, ["Local_Tag_Service_ID", "Lookup_Name", "Source_Name"], "Tag_ID", "at")
        mine = tags.where(F.col("Lookup_Name").isin(add) & (F.col("Local_Tag_Service_ID") == service) & (F.col("Source_Name") == "User added")).select("Tag_ID", "Lookup_Name")
        wanted = ids.select("Taggable_ID").distinct().select("Taggable_ID", F.explode(F.array(*map(F.lit, add))).alias("Lookup_Name"))
        pairings = insert_pairs(pairings, wanted.join(mine, "Lookup_Name"))
        c = c.with_(tags=tags)
    return c.with_(pairings=pairings)


def trash(taggables: DataFrame, ids: DataFrame) -> DataFrame:
    """The taggables with ids marked as trash."""
    mark = ids.select(F.col("Taggable_ID").alias("__t")).distinct().withColumn("__trash", F.lit(True))
    return taggables.join(mark, F.col("Taggable_ID") == F.col("__t"), "left").withColumn("In_Trash", F.col("In_Trash") | F.coalesce("__trash", F.lit(False))).drop("__t", "__trash")


def add_notes(notes: DataFrame, new: DataFrame, pairings: DataFrame, has_notes_tag: int) -> tuple[DataFrame, DataFrame]:
    """(notes, pairings) with the new notes and the tag that says so on their taggables."""
    return notes.unionByName(new), insert_pairs(pairings, new.select(F.lit(has_notes_tag).cast("long").alias("Tag_ID"), "Taggable_ID"))


def delete_service(c: Collection, tag_service: int) -> Collection:
    """Without a tag service: its tags and their pairings go too."""
    return delete_ids(c, tags=c.tags.where(F.col("Local_Tag_Service_ID") == tag_service).select("Tag_ID"))


def delete_taggable_service(c: Collection, service: int) -> Collection:
    """Without a taggable service: its taggables, their pairings and their applied values go too."""
    return delete_ids(c, taggables=c.taggables.where(F.col("Service_ID") == service).select("Taggable_ID"))


def delete_metric_service(c: Collection, service: int) -> Collection:
    """Without a metric service: its metrics and their applied values go too."""
    return delete_metrics(c, f"Local_Metric_Service_ID = {int(service)}")


def delete_children(parents: DataFrame, children: DataFrame, where: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents (downloader or parser services) without those that meet a condition, and children without theirs."""
    gone = parents.where(where).select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def update_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A table whose rows take the values of changes that aren't null, by key; other columns and rows stay."""
    new = changes.select(*(F.col(k).alias(f"__{k}") for k in changes.columns))
    changed = [F.coalesce(f"__{k}", k).alias(k) if k in changes.columns and k != key else F.col(k) for k in table.columns]
    return table.join(new, F.col(key) == F.col(f"__{key}"), "left").select(*changed)


def import_chunk(c: Collection, sidecars: DataFrame, service: int, taggable_service: int) -> tuple[Collection, dict[str, DataFrame]]:
    """The collection with what sidecars (as read_sidecars gives them) bring, and their notes, urls and dates by taggable.

    Taggables and tags get ids by upserts (tags by service, name and source); namespaces of one tag are put together. A taggable is
    known by its file's name if c.taggables has a column `name`, as it has after an import: the same sidecars again change nothing.
    """
    made = import_tables(sidecars, service)
    known = c.taggables if "name" in c.taggables.columns else c.taggables.withColumn("name", F.lit(None).cast("string"))
    fresh = made["taggables"].select(F.lit(None).cast("long").alias("Taggable_ID"), F.lit(taggable_service).alias("Service_ID"), F.lit(False).alias("In_Trash"), "name")
    taggables = staged(upsert(known.select("Taggable_ID", "Service_ID", "In_Trash", "name"), fresh, ["name"], "Taggable_ID", "name"), "taggables")
    ids = taggables.join(made["taggables"].select("name").distinct(), "name").select("name", "Taggable_ID")
    new = made["tags"].select(F.lit(None).cast("long").alias("Tag_ID"), F.col("Local_Tag_Service_ID"), "Lookup_Name", F.lit("import").alias("Source_Name"), F.col("Lookup_Name").alias("Display_Name"))
    tags = staged(upsert(c.tags, new, ["Local_Tag_Service_ID", "Lookup_Name", "Source_Name"], "Tag_ID", "Lookup_Name"), "tags")
    mine = tags.where((F.col("Local_Tag_Service_ID") == service) & (F.col("Source_Name") == "import")).select("Tag_ID", "Lookup_Name")
    spaces = made["tags"].select("Lookup_Name", F.explode("Namespaces").alias("Namespace_Name")).join(mine, "Lookup_Name")
    unknown = spaces.select("Namespace_Name").distinct().select(F.lit(None).cast("int").alias("Namespace_ID"), "Namespace_Name")
    namespaces = staged(upsert(c.namespaces, unknown, ["Namespace_Name"], "Namespace_ID", "Namespace_Name").withColumn("Namespace_ID", F.col("Namespace_ID").cast("int")), "namespaces")
    spaces = spaces.join(namespaces, "Namespace_Name").select("Tag_ID", "Namespace_ID")
    pairs = made["pairs"].withColumnRenamed("tag", "Lookup_Name").join(mine, "Lookup_Name").join(ids, "name").select(PAIR)
    c = c.with_(taggables=taggables, tags=tags, namespaces=namespaces, tags_namespaces=c.tags_namespaces.unionByName(spaces).distinct(), pairings=insert_pairs(c.pairings, pairs))
    by_id = {k: made[k].join(ids, "name").drop("name") for k in ("notes", "urls")}
    return c, by_id | {"dates": made["taggables"].join(ids, "name").drop("name", "extension")}


def delete_metrics(c: Collection, where: str) -> Collection:
    """Without the metrics that meet a condition, and their applied values."""
    gone = c.metrics.where(where).select("Local_Metric_ID")
    return c.with_(metrics=c.metrics.join(gone, "Local_Metric_ID", "left_anti"), applied_metrics=c.applied_metrics.join(gone, "Local_Metric_ID", "left_anti"))


def key_audit(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, key, n) of every key that should be unique and isn't."""
    out = None
    for name, (df, keys) in tables.items():
        one = dealt(df.select(keys), *keys).groupBy(keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("table"), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)).alias("key"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def commit(tables: dict[str, DataFrame], folder: str) -> str:
    """Write tables as a new version of a folder; returns its name.

    A version is a folder of its own, and nothing that is read is overwritten. When all its tables are complete, a note
    that it is gets written under a new name; readers take the last version that has one, so a commit that fails
    anywhere changes nothing. Tables that aren't given stay those of the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    places = dict(_places(spark, folder))
    for table, df in tables.items():
        places[table] = f"{name}/{table}"
        df.write.parquet(f"{folder}/versions/{places[table]}")
    rows = [(name, t, p) for t, p in sorted(places.items())]
    spark.createDataFrame(rows, "version string, table string, place string").coalesce(1).write.json(f"{folder}/complete/{name}")
    return name


def _places(spark, folder: str) -> list[tuple[str, str]]:
    """(table, place) of the last complete version: one whose writer left its mark of success."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/complete")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    made = [s.getPath() for s in files.listStatus(path)]
    done = sorted(p.getName() for p in made if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    if not done:
        return []
    return [(r.table, r.place) for r in spark.read.schema("version string, table string, place string").json(f"{folder}/complete/{done[-1]}").collect()]


def current(spark, folder: str, table: str) -> DataFrame:
    """A table as of the last commit."""
    return spark.read.parquet(f"{folder}/versions/{dict(_places(spark, folder))[table]}")

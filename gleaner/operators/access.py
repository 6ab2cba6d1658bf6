"""Permissions, cursors and jobs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import query as q
from ..plans.collection import Collection
from ..plans.search import Search

# Names of permissions.
CREATE_TAGS, READ_TAGS, APPLY_TAGS, DELETE_TAGS = "LTS.CT", "LTS.RT", "LTS.AT", "LTS.DT"
CREATE_TAGGABLES, READ_TAGGABLES, UPDATE_TAGGABLES, TRASH_TAGGABLES = "LTgbS.CT", "LTgbS.RT", "LTgbS.UT", "LTgbS.TT"
CREATE_METRIC, READ_METRIC, UPDATE_METRIC, DELETE_METRIC, APPLY_METRIC = "LMS.CM", "LMS.RM", "LMS.UM", "LMS.DM", "LMS.AM"
CREATE_PARSER = "LDS.CUP"
ADMIN = {
    "A.CLTS", "A.ULTS", "A.DLTS",
    "A.CLTgbS", "A.ULTgbS", "A.DLTgbS",
    "A.CLMS", "A.ULMS", "A.DLMS",
    "A.CLDS", "A.ULDS", "A.DLDS",
    "A.Import",
}


# The kind of service whose objects a permission is about; administrative ones are about none.
SCOPES = {"LTS": "tag", "LTgbS": "taggable", "LMS": "metric", "LDS": "downloader"}
CATALOGUE = {p: SCOPES[p.split(".")[0]] for p in (CREATE_TAGS, READ_TAGS, APPLY_TAGS, DELETE_TAGS, CREATE_TAGGABLES, READ_TAGGABLES, UPDATE_TAGGABLES, TRASH_TAGGABLES, CREATE_METRIC, READ_METRIC, UPDATE_METRIC, DELETE_METRIC, APPLY_METRIC, CREATE_PARSER)}
CATALOGUE |= dict.fromkeys(ADMIN)


@dataclass(frozen=True)
class User:
    user_id: int
    permissions: frozenset[str] = frozenset()
    sudo: bool = False

    def needs(self, required: list[str]) -> list[str]:
        """Those of the required permissions that have to come from services."""
        return [] if self.sudo else [p for p in required if p not in self.permissions]


def visible_services(services: DataFrame, granted: DataFrame, user: User, required: list[str]) -> DataFrame:
    """Services on which the user has every required permission, be it for all services or for that one.

    services: Service_ID. granted: Service_ID, User_ID, Permission.
    """
    needs = sorted(set(user.needs(required)))
    if not needs:
        return services
    mine = granted.where((F.col("User_ID") == user.user_id) & F.col("Permission").isin(needs)).select("Service_ID", "Permission").distinct()
    enough = mine.groupBy("Service_ID").agg(F.count("*").alias("n")).where(F.col("n") == len(needs)).select("Service_ID")
    return services.join(enough, "Service_ID", "left_semi")


class Forbidden(PermissionError):
    """A search names what its user may not read."""


def needed(c: Collection, node: q.Node) -> DataFrame:
    """(kind, Service_ID, Permission) of every service whose tags or metrics a query names, conditions included.

    Tags are found by id or, in all services that have the name, by lookup name; a metric comparison needs the metric's
    service as any other metric leaf does.
    """
    rows: list[tuple[str, int | None, str | None]] = []

    def see(n: q.Node) -> None:
        if isinstance(n, q.Tag):
            rows.append(("tag", n.tag_id, None))
        elif isinstance(n, q.Lookup):
            rows.append(("name", None, n.lookup_name))
        elif isinstance(n, q.HasMetric | q.Compare | q.AppliedValue):
            rows.append(("metric", n.metric_id, None))
        elif isinstance(n, q.InMetricService):
            rows.append(("service", n.service_id, None))
        elif isinstance(n, q.ListUnion):
            rows.append(("namespace", n.items.namespace_id, None) if isinstance(n.items, q.NamespaceList) else ("metric", n.items.metric_id, None))

    q.walk(node, see)
    named = F.broadcast(c.tags.sparkSession.createDataFrame(rows, "kind string, id long, name string"))  # as many rows as the query has leaves
    tags = c.tags.select("Tag_ID", "Lookup_Name", F.col("Local_Tag_Service_ID").alias("Service_ID"))
    spaces = tags.join(c.tags_namespaces, "Tag_ID").select(F.lit("namespace").alias("kind"), F.col("Namespace_ID").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), "Service_ID")
    by_id = tags.select(F.lit("tag").alias("kind"), F.col("Tag_ID").alias("id"), F.lit(None).cast("string").alias("name"), "Service_ID")
    by_name = tags.select(F.lit("name").alias("kind"), F.lit(None).cast("long").alias("id"), F.col("Lookup_Name").alias("name"), "Service_ID")
    metrics = c.metrics.select(F.lit("metric").alias("kind"), F.col("Local_Metric_ID").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("Local_Metric_Service_ID").alias("Service_ID"))
    services = named.where("kind = 'service'").select("kind", "id", "name", F.col("id").cast("int").alias("Service_ID"))
    every = by_id.unionByName(by_name).unionByName(spaces).unionByName(metrics).unionByName(services)
    held = every.join(named.select(F.col("kind").alias("k"), F.col("id").alias("i"), F.col("name").alias("n")).distinct(), (F.col("kind") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")) & F.col("name").eqNullSafe(F.col("n")))
    metric = F.col("kind").isin("metric", "service")
    return held.select(F.when(metric, "metric").otherwise("tag").alias("kind"), "Service_ID", F.when(metric, READ_METRIC).otherwise(READ_TAGS).alias("Permission")).distinct()


def lacking(c: Collection, node: q.Node, granted: DataFrame, user: User) -> DataFrame:
    """What of needed() the user doesn't have: not for all services, nor for that one (granted: Service_ID, User_ID, Permission)."""
    rows = needed(c, node)
    own = user.needs([READ_TAGS, READ_METRIC])
    mine = granted.where(F.col("User_ID") == user.user_id).select("Service_ID", "Permission").distinct()
    return rows.where(F.col("Permission").isin(own)).join(mine, ["Service_ID", "Permission"], "left_anti").select("kind", "Service_ID", "Permission")


def checked_search(search: Search, node: q.Node, granted: DataFrame, user: User) -> DataFrame:
    """The search's result, over the taggable services that the user may read; refused if it names what the user may not read."""
    if (lost := lacking(search.collection, node, granted, user).first()) is not None:
        raise Forbidden(f"{lost.Permission} on service {lost.Service_ID}")
    c = search.collection
    seen = visible_services(c.taggables.select("Service_ID").distinct(), granted, user, [READ_TAGGABLES])
    return search.run(node).join(visible_taggables(c.taggables, seen).select("Taggable_ID"), "Taggable_ID", "left_semi")


@dataclass
class Request:
    """What a request is about: the services and objects that it names, each a DataFrame of ids; None names none.

    tag_services, taggable_services, metric_services, downloader_services: Service_ID. tags: Tag_ID. taggables: Taggable_ID. metrics: Local_Metric_ID. files: File_ID.
    """

    tag_services: DataFrame | None = None
    taggable_services: DataFrame | None = None
    metric_services: DataFrame | None = None
    downloader_services: DataFrame | None = None
    tags: DataFrame | None = None
    taggables: DataFrame | None = None
    metrics: DataFrame | None = None
    files: DataFrame | None = None


MISSING, REFUSED, UNCHECKED = "missing", "refused", "unchecked"


def refusals(c: Collection, request: Request, required: list[str], granted: DataFrame, user: User, taggable_files: DataFrame | None = None) -> DataFrame:
    """(scope, kind, id, reason) of everything that speaks against a request; none if it may go on.

    For each scope that the required permissions are about, the services named, and those of the tags, taggables or metrics named, must each
    give the user all permissions of the scope, unless the user has them for all services. Files are readable by one of their taggables: a file
    without any taggable of a service that gives all of them is refused. Objects that aren't there are missing. A scope of which the request
    names nothing is unchecked, which refuses it too. Administrative permissions must be the user's own (kind `admin`).

    granted: Service_ID, User_ID, Permission. taggable_files: File_ID, Taggable_ID.
    """
    spark = granted.sparkSession
    by_scope: dict[str, list[str]] = {}
    out = [spark.createDataFrame([(None, "admin", p, REFUSED) for p in user.needs([p for p in required if CATALOGUE[p] is None])], "scope string, kind string, id string, reason string")]
    for p in required:
        if CATALOGUE[p]:
            by_scope.setdefault(CATALOGUE[p], []).append(p)
    objects = {
        "tag": (request.tag_services, request.tags, "Tag_ID", lambda: c.tags.select("Tag_ID", F.col("Local_Tag_Service_ID").alias("Service_ID"))),
        "taggable": (request.taggable_services, request.taggables, "Taggable_ID", lambda: c.taggables.select("Taggable_ID", "Service_ID")),
        "metric": (request.metric_services, request.metrics, "Local_Metric_ID", lambda: c.metrics.select("Local_Metric_ID", F.col("Local_Metric_Service_ID").alias("Service_ID"))),
        "downloader": (request.downloader_services, None, "", lambda: None),
    }
    told = lambda df, scope, kind, key, reason: df.select(F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.lit(reason).alias("reason"))
    for scope, permissions in by_scope.items():
        services, ids, key, table = objects[scope]
        files = request.files if scope == "taggable" else None
        if services is None and ids is None and files is None:
            out.append(spark.createDataFrame([(scope, "scope", scope, UNCHECKED)], "scope string, kind string, id string, reason string"))
            continue
        named = None if services is None else services.select(F.col("Service_ID").cast("long").alias("Service_ID"))
        if ids is not None:
            held = ids.select(key).distinct().join(table(), key, "left")
            out.append(told(held.where("Service_ID is null"), scope, key, key, MISSING))
            theirs = held.where("Service_ID is not null").select(F.col("Service_ID").cast("long").alias("Service_ID"))
            named = theirs if named is None else named.unionByName(theirs)
        if named is not None:
            named = named.distinct()
            out.append(told(named.join(visible_services(named, granted, user, permissions), "Service_ID", "left_anti"), scope, "service", "Service_ID", REFUSED))
        if files is not None:
            of_files = files.select("File_ID").distinct().join(taggable_files.select("File_ID", "Taggable_ID"), "File_ID", "left").join(c.taggables.select("Taggable_ID", "Service_ID"), "Taggable_ID", "left")
            given = visible_services(c.taggables.select("Service_ID").distinct(), granted, user, permissions).select(F.col("Service_ID").alias("given"))
            judged = of_files.join(given, F.col("Service_ID") == F.col("given"), "left").groupBy("File_ID").agg(F.count("Service_ID").alias("n"), F.count("given").alias("readable"))
            out += [told(judged.where("n = 0"), scope, "File_ID", "File_ID", MISSING), told(judged.where("n > 0 and readable = 0"), scope, "File_ID", "File_ID", REFUSED)]
    return reduce(DataFrame.unionByName, out)


def allow(*args, **options) -> None:
    """Raises Forbidden if refusals() finds anything."""
    if (r := refusals(*args, **options).first()) is not None:
        raise Forbidden(f"{r.reason}: {r.kind} {r.id}")


def visible_taggables(taggables: DataFrame, services: DataFrame) -> DataFrame:
    return taggables.join(services, "Service_ID", "left_semi")


def forbidden_files(taggable_files: DataFrame, files: DataFrame, visible: DataFrame) -> DataFrame:
    """Files of which the user can read no taggable; a request over these files is refused if any is left."""
    readable = taggable_files.join(visible, "Taggable_ID", "left_semi").select("File_ID").distinct()
    return files.select("File_ID").join(readable, "File_ID", "left_anti")


def file_taggables(taggable_files: DataFrame) -> DataFrame:
    """(File_ID, taggable_ids) with sorted arrays."""
    return taggable_files.groupBy("File_ID").agg(F.array_sort(F.collect_set("Taggable_ID")).alias("taggable_ids"))


def outside_ids(ids: DataFrame, cursor: DataFrame, key: str) -> DataFrame:
    """Those of ids that aren't in what a cursor holds."""
    return ids.select(key).distinct().join(cursor, key, "left_anti")


def outside(ids: DataFrame, cursor: DataFrame, key: str) -> bool:
    return not outside_ids(ids, cursor, key).isEmpty()


def wanted(df: DataFrame, fields: str | list[str]) -> DataFrame:
    """The fields asked for: one as a flat column, several as rows."""
    return df.select(fields) if isinstance(fields, str) else df.select(*fields)


@dataclass
class Cursors:
    """Search results kept under a name for a while; reading one renews it."""

    timeout: float = 600.0
    now: Callable[[], float] = time.monotonic
    held: dict[str, tuple[DataFrame, float]] = field(default_factory=dict)

    def add(self, df: DataFrame) -> str:
        self._expire()
        name = uuid.uuid4().hex
        self.held[name] = (df.persist(), self.now() + self.timeout)
        return name

    def get(self, name: str) -> DataFrame:
        self._expire()
        df, _ = self.held[name]
        self.held[name] = (df, self.now() + self.timeout)
        return df

    def cancel(self, name: str) -> None:
        if name in self.held:
            self.held.pop(name)[0].unpersist()

    def reselect(self, name: str, ids: DataFrame, key: str) -> str:
        """A new cursor with those rows of an old one that have the ids."""
        return self.add(self.get(name).join(ids, key, "left_semi"))

    def _expire(self) -> None:
        for name in [k for k, (_, until) in self.held.items() if until < self.now()]:
            self.cancel(name)


@dataclass
class Job:
    """A run in bounded steps, each a Spark action, with progress; it can be cancelled between steps."""

    name: str
    steps: Iterator[str]
    done: int = 0
    cancelled: bool = False
    last: str = ""

    def run(self) -> int:
        for text in self.steps:
            self.done, self.last = self.done + 1, text
            if self.cancelled:
                break
        return self.done

    def cancel(self) -> None:
        self.cancelled = True


def make_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> list[str]:
    """Write an empty table for each schema that isn't there yet; returns the names made."""
    made = []
    for name, schema in schemas.items():
        try:
            spark.read.parquet(f"{folder}/{name}").schema  # noqa: B018
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made

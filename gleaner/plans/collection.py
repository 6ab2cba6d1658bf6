"""The tables of a collection, and one made from the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids of the namespaces and the first tag id of each; ids below 65536 are kept for the system.
NAMESPACES = {"status": 1, "priority": 2, "segment": 3, "flag": 4, "brand": 5, "part": 6}
FIRST_TAG = {"status": 100_000, "priority": 101_000, "segment": 102_000, "flag": 103_000, "brand": 104_000, "part": 1_000_000}
TAG_SERVICE = {"status": 1, "priority": 1, "segment": 1, "flag": 2, "brand": 2, "part": 2}
PRICE, QUANTITY = 1, 2  # metrics
TRASH_EVERY = 97

Table = DataFrame | Callable[[], DataFrame]


class Collection:
    """DataFrames of a collection, or functions that make them when they are first asked for.

    taggables: Taggable_ID, Service_ID, In_Trash. tags: Tag_ID, Local_Tag_Service_ID, Lookup_Name, Source_Name,
    Display_Name. namespaces: Namespace_ID, Namespace_Name. tags_namespaces: Tag_ID, Namespace_ID. pairings: Tag_ID,
    Taggable_ID (a set). pairing_rows: the same, where pairs may stand more than once; for what doesn't mind. metrics: Local_Metric_ID, Local_Metric_Service_ID, Local_Metric_Name. applied_metrics:
    Local_Metric_ID, User_ID (null: the system), Taggable_ID, Applied_Value.
    """

    def __init__(self, taggables: Table, tags: Table, namespaces: Table, tags_namespaces: Table, pairings: Table, metrics: Table, applied_metrics: Table, pairing_rows: Table | None = None):
        self._held = {
            "taggables": taggables, "tags": tags, "namespaces": namespaces, "tags_namespaces": tags_namespaces, "pairings": pairings, "metrics": metrics,
            "applied_metrics": applied_metrics, "pairing_rows": pairings if pairing_rows is None else pairing_rows,
        }

    def __getattr__(self, name: str) -> DataFrame:
        held = self.__dict__.get("_held", {})
        if name not in held:
            raise AttributeError(name)
        if not isinstance(held[name], DataFrame):
            held[name] = held[name]()
        return held[name]

    def with_(self, **tables: Table) -> Collection:
        rows = {"pairing_rows": tables["pairings"]} if "pairings" in tables else {}  # those of other pairings are out of date
        return Collection(**(self._held | rows | tables))


def with_metrics(applied: DataFrame, metrics: DataFrame, *columns: str) -> DataFrame:
    """Applied values with columns of their metrics. Metrics are few and each has many values, so they go to the values: shuffled, all values of a metric would be one task's."""
    return applied.join(F.broadcast(metrics.select("Local_Metric_ID", *columns)), "Local_Metric_ID")


def _tag_ids() -> dict[str, Column]:
    """The tag id of a row's value in each namespace: an offset plus a number that the value holds."""
    first = lambda c: F.ascii(c)
    return {
        "status": FIRST_TAG["status"] + first("o_orderstatus"),
        "priority": FIRST_TAG["priority"] + first("o_orderpriority"),
        "segment": FIRST_TAG["segment"] + first("c_mktsegment"),
        "flag": FIRST_TAG["flag"] + first("l_returnflag"),
        "brand": FIRST_TAG["brand"] + F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("long"),
        "part": FIRST_TAG["part"] + F.col("l_partkey"),
    }


class Star:
    """A collection made of orders (taggables) and what hangs on them; every table is derived when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table of the folder; its schema is looked up once."""
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.read[name]

    def taggables(self) -> DataFrame:
        o = self.table("orders")
        return o.select(F.col("o_orderkey").alias("Taggable_ID"), (F.col("o_orderkey") % 3).cast("int").alias("Service_ID"), (F.col("o_orderkey") % TRASH_EVERY == 0).alias("In_Trash"))

    def _rows(self, namespace: str) -> tuple[DataFrame, str, str]:
        """Source rows of a namespace, the column of the value and that of the order."""
        if namespace in ("status", "priority"):
            return self.table("orders"), f"o_order{namespace}", "o_orderkey"
        if namespace == "segment":
            o, c = self.table("orders").select("o_orderkey", "o_custkey"), self.table("customer").select("c_custkey", "c_mktsegment")
            return o.join(c, F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderkey"
        if namespace == "flag":
            return self.table("lineitem"), "l_returnflag", "l_orderkey"
        if namespace == "part":
            return self.table("lineitem"), "l_partkey", "l_orderkey"
        items, parts = self.table("lineitem").select("l_orderkey", "l_partkey"), self.table("part").select("p_partkey", "p_brand")
        return items.join(parts, F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_orderkey"

    def pairings(self, *namespaces: str, repeated: bool = False) -> DataFrame:
        """Distinct pairs of tag and taggable, or repeated ones; of some namespaces only, if named. Orders hold their own values once, so only the others are made distinct."""
        out = None
        for ns in namespaces or NAMESPACES:
            rows, _, order = self._rows(ns)
            one = rows.select(_tag_ids()[ns].cast("long").alias("Tag_ID"), F.col(order).alias("Taggable_ID"))
            one = one.distinct() if ns in ("flag", "brand", "part") and not repeated else one
            out = one if out is None else out.unionByName(one)
        return out

    def tags(self, *namespaces: str) -> DataFrame:
        out = None
        for ns in namespaces or NAMESPACES:
            rows, value, _ = {"segment": (self.table("customer"), "c_mktsegment", ""), "brand": (self.table("part"), "p_brand", "")}.get(ns) or self._rows(ns)
            one = rows.select(_tag_ids()[ns].cast("long").alias("Tag_ID"), F.col(value).cast("string").alias("Lookup_Name")).distinct()
            one = one.select("Tag_ID", F.lit(TAG_SERVICE[ns]).alias("Local_Tag_Service_ID"), "Lookup_Name", F.lit("star").alias("Source_Name"), F.col("Lookup_Name").alias("Display_Name"), F.lit(NAMESPACES[ns]).alias("Namespace_ID"))
            out = one if out is None else out.unionByName(one)
        return out

    def metrics(self) -> DataFrame:
        return self.spark.createDataFrame([(PRICE, 1, "total price"), (QUANTITY, 2, "largest quantity")], "Local_Metric_ID int, Local_Metric_Service_ID int, Local_Metric_Name string")

    def applied_metrics(self) -> DataFrame:
        o = self.table("orders").select(F.lit(PRICE).alias("Local_Metric_ID"), (F.col("o_custkey") % 3).alias("User_ID"), F.col("o_orderkey").alias("Taggable_ID"), F.col("o_totalprice").alias("Applied_Value"))
        q = self.table("lineitem").groupBy(F.col("l_orderkey").alias("Taggable_ID")).agg(F.max("l_quantity").alias("Applied_Value"))
        return o.unionByName(q.select(F.lit(QUANTITY).alias("Local_Metric_ID"), F.lit(0).cast("long").alias("User_ID"), "Taggable_ID", "Applied_Value"))

    def namespaces(self) -> DataFrame:
        return self.spark.createDataFrame([(i, n) for n, i in NAMESPACES.items()], "Namespace_ID int, Namespace_Name string")

    def collection(self, *namespaces: str) -> Collection:
        return Collection(
            self.taggables, lambda: self.tags(*namespaces).drop("Namespace_ID"), self.namespaces, lambda: self.tags(*namespaces).select("Tag_ID", "Namespace_ID"),
            lambda: self.pairings(*namespaces), self.metrics, self.applied_metrics, lambda: self.pairings(*namespaces, repeated=True),
        )

    def files(self) -> DataFrame:
        """Documents as files: an id, a hash of the content, a size."""
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("File_ID"), F.sha2(F.col("text"), 256).alias("File_Hash"), F.octet_length("text").cast("long").alias("File_Size"))

    def perceptual(self) -> DataFrame:
        """Sign bits of the embeddings as perceptual hashes: two longs of 32 bits."""
        bit = lambda i: F.when(F.get("embedding", F.lit(i)) > 0, F.lit(1 << (i % 32)).cast("long")).otherwise(F.lit(0).cast("long"))
        halves = [sum((bit(i) for i in range(32 * h + 1, 32 * h + 32)), bit(32 * h)) for h in (0, 1)]
        return self.table("embeddings").select(F.col("vec_id").alias("File_ID"), halves[0].alias("Hash_0"), halves[1].alias("Hash_1"))

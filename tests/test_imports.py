"""Imports and what speaks against a request."""

import pytest
from pyspark.sql import functions as F

from gleaner import operator_queries
from gleaner.functions import sets
from gleaner.operators import access, edits, imports
from gleaner.plans.collection import Star
from tests.test_search import PAIRS, collection


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def tag(name, spaces=(), service=2):
    return (service, name, "src", name.upper(), list(spaces))


ROWS = [
    ("aa", ".png", "one", 1, [tag("x", ["series"]), tag("y")], [(1, 4, 2.5)], [("http://a", None), ("http://b", "post")], [("n", "hello")], 10, None, None, None),
    ("aa", ".png", "uno", 1, [tag("x", ["new"])], [(1, 4, 3.5), (2, None, 1.0)], [], [("n", "hello")], 5, 7, None, None),
    ("aa", ".png", None, 3, [tag("x", service=4)], None, None, None, None, None, None, None),
    ("bb", None, None, 1, None, None, None, None, None, None, None, 9),
    (None, ".gif", "lost", 1, [tag("lost")], None, None, None, 1, 1, 1, 1),
]


def test_import_and_import_again(spark):
    c = collection(spark, PAIRS, applied=[(1, 4, 0, 9.0)])
    a = imports.import_files(imports.Archive.of(c), spark.createDataFrame(ROWS, imports.IMPORTABLE))
    assert [r.File_Hash for r in a.files.orderBy("File_Hash").collect()] == ["aa", "bb"]
    held = a.taggable_files.join(a.files, "File_ID").join(a.collection.taggables, "Taggable_ID")
    ids = {(r.File_Hash, r.Service_ID): r.Taggable_ID for r in held.collect()}
    assert set(ids) == {("aa", 1), ("aa", 3), ("bb", 1)} and min(ids.values()) == 12
    assert {r.Taggable_ID: r.Taggable_Name for r in a.taggable_files.collect()} == {ids["aa", 1]: "uno", ids["aa", 3]: "aa", ids["bb", 1]: "bb"}
    named = a.collection.pairings.join(a.collection.tags, "Tag_ID")
    said = lambda i: {(r.Local_Tag_Service_ID, r.Lookup_Name) for r in named.where(F.col("Taggable_ID") == i).collect()}
    facts = {"system:has file hash:aa", "system:has file extension:.png"}
    metrics = {"system:applied metric:3.5:1:4", "system:applied metric:1.0:2:"} | {f"system:has local metric:{k}" for k in (1, 2)} | {f"system:has metric from local metric service:{k}" for k in (1, 2)}
    got = said(ids["aa", 1])
    assert {x for x in got if x[0] == 2} == {(2, "x"), (2, "y")}
    system = {x[1] for x in got if x[0] == imports.SYSTEM_SERVICE}
    assert facts | {"system:in local taggable service:1", "system:has url:http://a", "system:has url:http://b", "system:has url with association:http://b with\x01 post"} <= system
    assert len(system) == 6 + len(metrics)
    assert said(ids["bb", 1]) == {(0, "system:has file hash:bb"), (0, "system:in local taggable service:1")}
    assert (4, "x") in said(ids["aa", 3])
    spaces = a.collection.tags_namespaces.join(a.collection.namespaces, "Namespace_ID").join(a.collection.tags, "Tag_ID")
    assert {(r.Lookup_Name, r.Namespace_Name) for r in spaces.collect()} == {("x", "series"), ("x", "new")}
    assert rows(a.collection.applied_metrics) == sorted([(1, 4, 0, 9.0), (1, 4, ids["aa", 1], 3.5), (2, None, ids["aa", 1], 1.0)], key=repr)
    assert rows(a.notes) == [(ids["aa", 1], "n", "hello")]
    assert rows(a.dates) == sorted([(ids["aa", 1], 10, 7, None, None), (ids["aa", 3], None, None, None, None), (ids["bb", 1], None, None, None, 9)], key=repr)
    assert not [r for r in a.collection.tags.collect() if r.Lookup_Name == "lost"]

    again = imports.import_files(a, spark.createDataFrame([*ROWS, *ROWS[:2]], imports.IMPORTABLE))
    for name in ("taggables", "tags", "namespaces", "tags_namespaces", "pairings", "applied_metrics"):
        assert rows(getattr(again.collection, name)) == rows(getattr(a.collection, name)), name
    for name in ("files", "taggable_files", "notes", "dates"):
        assert rows(getattr(again, name)) == rows(getattr(a, name)), name
    none = imports.import_files(a, spark.createDataFrame([], imports.IMPORTABLE))
    assert rows(none.collection.pairings) == rows(a.collection.pairings)


def test_tag_ids_shuffle_no_names(spark, monkeypatch):
    """Tags that differ by where a null stands are told apart, by hashes and, where hashes are equal, by names."""
    tags = [(1, 2, None, "a"), (2, 2, "a", None), (3, None, "a", "a"), (4, 2, "a", "a")]
    tags = spark.createDataFrame(tags, "Tag_ID long, Local_Tag_Service_ID int, Lookup_Name string, Source_Name string")
    said = tags.select(*imports.TAG_KEY, (F.col("Tag_ID") + 10).alias("Taggable_ID"))
    by_hash = imports.with_tag_ids(said.withColumn("h", imports.key_hash()), tags)
    shuffled = [line for line in by_hash._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert shuffled and not any("Lookup_Name" in line for line in shuffled)
    monkeypatch.setattr(imports, "key_hash", lambda: F.lit(7).cast("long"))
    by_name = imports.with_tag_ids(said.withColumn("h", imports.key_hash()), tags)
    pairs = [(k, k + 10) for k in range(1, 5)]
    assert rows(by_hash.select("Tag_ID", "Taggable_ID")) == rows(by_name.select("Tag_ID", "Taggable_ID")) == pairs


def test_upsert_of_null_names(spark):
    known = spark.createDataFrame([(5, 1, "a", "A")], "id long, service int, name string, shown string")
    new = spark.createDataFrame([(None, 1, "a", "B"), (None, 2, None, "C"), (None, 1, None, "D"), (None, 1, None, "E")], known.schema)
    for order in ("name", "shown", None):
        out = rows(edits.upsert(known, new, ["service", "name"], "id", order).select("service", "name", "shown"))
        assert len(out) == 3 and {x[:2] for x in out} == {(1, "a"), (2, None), (1, None)} and (2, None, "C") in out and (1, "a", "A") in out, order
    ids = [r.id for r in edits.upsert(known, new, ["service", "name"], "id").collect()]
    assert sorted(ids) == [5, 6, 7]
    filled = edits.upsert(known, spark.createDataFrame([(None, 3, "z", None), (None, 3, "y", "Y")], known.schema), ["service", "name"], "id", fill={"shown": "name"})
    assert {r.shown for r in filled.collect()} == {"A", "z", "Y"}


def test_importables_are_dealt(spark, sf_dir):
    """Parts are a small file and grow when they are made importable: more tasks than the file has parts."""
    assert operator_queries._importables(Star(spark, sf_dir)).rdd.getNumPartitions() > Star(spark, sf_dir).table("part").rdd.getNumPartitions()


def test_sidecars_twice(spark):
    schema = "name string, extension string, path string, tags array<struct<namespace:string,name:string>>, notes array<string>, urls array<string>, Taggable_Created_Date long, Taggable_Deleted_Date long, Taggable_Last_Modified_Date long, Taggable_Last_Viewed_Date long"
    side = spark.createDataFrame([("a.png", ".png", "", [("s", "x"), (None, "y")], ["n"], [], 1, None, None, None), ("b.png", ".png", "", [], [], ["u"], None, None, None, None)], schema)
    once, _ = edits.import_chunk(collection(spark, PAIRS), side, 9, 5)
    twice, more = edits.import_chunk(once, side, 9, 5)
    for name in ("taggables", "tags", "namespaces", "tags_namespaces", "pairings"):
        assert rows(getattr(twice, name)) == rows(getattr(once, name)), name
    assert once.taggables.where("Service_ID = 5").count() == 2 and more["notes"].count() == 1


def test_merged_maps_with_nulls(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2, 'd', CAST(NULL AS INT)) AS x, map('a', CAST(NULL AS INT), 'c', 3) AS y")
    assert df.select(sets.merged([F.col("x"), F.col("y")]).alias("m")).collect()[0].m == {"a": None, "b": 2, "c": 3, "d": None}


def test_refusals(spark):
    c = collection(spark, PAIRS, services={0: 1, 1: 1, 2: 2})  # others are in service 0
    make = spark.createDataFrame
    granted = make([(1, 7, access.READ_TAGGABLES), (1, 7, access.TRASH_TAGGABLES), (2, 7, access.READ_TAGGABLES), (1, 7, access.READ_TAGS), (2, 8, access.TRASH_TAGGABLES)], "Service_ID int, User_ID long, Permission string")
    ids = lambda *x: make([(i,) for i in x], "Taggable_ID long")
    both = [access.READ_TAGGABLES, access.TRASH_TAGGABLES]
    ask = lambda need, user=access.User(7), files=None, **objects: [tuple(r) for r in access.refusals(c, access.Request(**objects), need, granted, user, files).collect()]
    assert ask(both, taggables=ids(0, 1)) == []
    assert ask(both, taggables=ids(0, 2)) == [("taggable", "service", "2", "refused")]
    assert ask(both[:1], taggables=ids(0, 2, 77)) == [("taggable", "Taggable_ID", "77", "missing")]
    assert ask(both, access.User(7, frozenset(both)), taggables=ids(0, 2, 5)) == []
    assert ask(both, access.User(9, sudo=True), taggables=ids(0, 2, 5)) == []
    assert ask(both, tags=make([(1,)], "Tag_ID long")) == [("taggable", "scope", "taggable", "unchecked")]
    assert ask([access.READ_TAGS], tags=make([(1,), (5,)], "Tag_ID long"), tag_services=make([(3,)], "Service_ID int")) == [("tag", "service", "3", "refused")]
    assert ask(["A.Import"]) == [(None, "admin", "A.Import", "refused")] and ask(["A.Import"], access.User(7, frozenset({"A.Import"}))) == []
    files = make([(1, 0), (1, 5), (2, 5), (3, 99)], "File_ID long, Taggable_ID long")
    asked = make([(1,), (2,), (3,), (4,)], "File_ID long")
    got = access.refusals(c, access.Request(files=asked), both, granted, access.User(7), files).collect()
    assert sorted((r.id, r.reason) for r in got) == [("2", "refused"), ("3", "missing"), ("4", "missing")]
    with pytest.raises(access.Forbidden):
        access.allow(c, access.Request(files=asked), both, granted, access.User(7), files)
    access.allow(c, access.Request(taggables=ids(1)), both, granted, access.User(7))

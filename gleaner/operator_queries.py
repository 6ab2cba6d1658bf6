"""Registered queries of operators that no search or count needs, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import names, programs, sets
from .operators import access, duplicates, edits, imports, stored
from .plans import query as q
from .plans.bitmaps import BitmapSearch, counts_of
from .plans.collection import NAMESPACES, PRICE, QUANTITY, TRASH_EVERY, Star
from .plans.search import Search
from .queries import _APPLIED, _AS, _FOUND, _SP, F_, FLAGSHIP, RETURNED, SEARCHES, SQL, URGENT, N, T, U, _flagship, _has, _pairs, _star, _with, search
from .queries import I as AND
from .sources import archives, lookups
from .sources.staging import new_path, staged
from .streaming import compare

# Searches built from what was typed, selected and enumerated.


def _typed(text: str) -> q.Node:
    t = q.typed_entry(text)
    found = q.Lookup(t.name)
    return N(found) if t.exclude else found


search("p12_typed_search", AND(_typed("status:F"), _typed("-flag:R")), ("status", "flag"), "id IN (SELECT id FROM p WHERE lookup = 'F') AND id NOT IN (SELECT id FROM p WHERE lookup = 'R')")
search("p14_toggled_selection", AND(*q.toggle(q.toggle([T(F_)], T(URGENT)), N(T(F_)))), _SP, f"{_has(URGENT)} AND NOT {_has(F_)}")
search("p16_ratings_not_in", q.ListUnion(q.MetricList(QUANTITY), (q.Condition("not-in", dropped=tuple(q.AppliedValue(QUANTITY, v) for v in q.rating_steps(10, 40, 0))),)), ("status",), f"id IN (SELECT id FROM m WHERE metric = {QUANTITY} AND u = 0 AND v NOT IN (SELECT unnest(range(10, 41))))", user=0, more={"m": _APPLIED})
_star("o8_cardinality", lambda s: Search(s.collection(*_SP)).run(N(U(T(F_), T(URGENT)))).agg(F.count("*").alias("n")), _with(*_SP) + f"SELECT count(*) AS n FROM w WHERE NOT ({_has(F_)} OR {_has(URGENT)})")
_star("s7_all_tags", lambda s: s.pairings().select("Tag_ID").distinct(), _with("status", "priority", "segment", "flag", "brand", "part") + 'SELECT DISTINCT tag AS "Tag_ID" FROM p')
_star("s8_point_list", lambda s: s.tags("status", "brand").where(F.col("Tag_ID").isin(F_, 104001, 104025, 5)).select("Tag_ID", "Lookup_Name"), _with("status", "brand") + f'SELECT DISTINCT tag AS "Tag_ID", lookup AS "Lookup_Name" FROM p WHERE tag IN ({F_}, 104001, 104025, 5)')
_star("s9_services", lambda s: s.collection("status", "brand").tags.select("Local_Tag_Service_ID").distinct(), _with("status", "brand") + 'SELECT DISTINCT CAST(CASE WHEN tag < 103000 THEN 1 ELSE 2 END AS INTEGER) AS "Local_Tag_Service_ID" FROM p')
_star("p9_wanted_fields", lambda s: access.wanted(s.taggables(), ["Taggable_ID", "Service_ID"]), 'SELECT o_orderkey AS "Taggable_ID", CAST(o_orderkey % 3 AS INTEGER) AS "Service_ID" FROM orders')

# The same searches, and counts, from posting lists of bits.


def _bitmap(name: str) -> None:
    node, spaces, options = SEARCHES[name]
    _star(f"{name}_bitmap", lambda s: BitmapSearch(s.collection(*spaces), **options).run(node), SQL[name])


for _name in "o1_union o2_intersect o3_complement o4_difference o5_xor o7_nested o8_constants s1_universe s2_empty s3_tag_scan s4_literal_list p2_lookup_in_service p5_metric_gt p6_with_trash p7_service_scope c_combined c_complement".split():
    _bitmap(_name)
_star("o8_cardinality_bitmap", lambda s: BitmapSearch(s.collection(*_SP)).count(N(U(T(F_), T(URGENT)))), SQL["o8_cardinality"])

# Lookups in a sorted table of tags: the files that can hold what is asked for are read.
_TAG = "Tag_ID long, Lookup_Name string"


def _sorted_tags(s: Star) -> str:
    folder = new_path(s.spark, "tags")
    lookups.write_sorted(s.tags("part", "brand").select("Tag_ID", "Lookup_Name"), "Lookup_Name", folder)
    return folder


_star("p2_pruned_lookup", lambda s: lookups.lookup(s.spark, _sorted_tags(s), _TAG, "Lookup_Name", ["17", "Brand#12", "no such tag"]), _with("part", "brand") + """SELECT DISTINCT tag AS "Tag_ID", lookup AS "Lookup_Name" FROM p WHERE lookup IN ('17', 'Brand#12')""")
_star("p10_pruned_prefix", lambda s: lookups.beginning(s.spark, _sorted_tags(s), _TAG, "Lookup_Name", "12"), _with("part", "brand") + """SELECT DISTINCT tag AS "Tag_ID", lookup AS "Lookup_Name" FROM p WHERE starts_with(lookup, '12')""")

# Facts and edits.
_FACTS = f"SELECT DISTINCT x AS \"Lookup_Name\", id AS \"Taggable_ID\" FROM (SELECT 'system:has local metric:' || metric AS x, id FROM ({_APPLIED}) UNION ALL SELECT 'system:has metric from local metric service:' || metric, id FROM ({_APPLIED}))"


def _has_facts(s: Star) -> DataFrame:
    return edits.metric_facts(s.applied_metrics(), s.metrics()).where(F.col("Lookup_Name").startswith("system:has"))


def _system_counts(s: Star) -> DataFrame:
    """Facts joined by name with system tags whose ids are hashes of their names."""
    facts = _has_facts(s)
    tags = facts.select("Lookup_Name").distinct().select(F.xxhash64("Lookup_Name").alias("Tag_ID"), "Lookup_Name", F.lit(names.SYSTEM_SOURCE).alias("Source_Name"))
    return edits.system_pairs(facts, tags).join(tags, "Tag_ID").groupBy("Lookup_Name").agg(F.count("*").alias("n"))


_star("m8_metric_facts", _has_facts, _FACTS)
_star("j8_system_tags", _system_counts, f'SELECT "Lookup_Name", count(*) AS n FROM ({_FACTS}) GROUP BY 1')


def _new_ids(s: Star) -> DataFrame:
    """Tag 7 on an id of its own for every order of status F."""
    return s.pairings("status").where(F.col("Tag_ID") == F_).select(F.lit(7).cast("long").alias("Tag_ID"), (F.col("Taggable_ID") + 10_000_000).alias("Taggable_ID"))


_star("m6_insert_parents", lambda s: edits.edit_pairs(s.collection("status"), _new_ids(s), edits.insert_pairs).taggables.select("Taggable_ID", "In_Trash"), _with("status") + f'SELECT id AS "Taggable_ID", id % {TRASH_EVERY} = 0 AS "In_Trash" FROM u UNION ALL SELECT id + 10000000, false FROM p WHERE tag = {F_}')
_star("m6_delete_inserts_parents", lambda s: edits.edit_pairs(s.collection("status"), _new_ids(s), edits.delete_pairs).tags.select("Tag_ID"), _with("status") + 'SELECT DISTINCT tag AS "Tag_ID" FROM p UNION ALL SELECT 7')
_star("m6_toggle_with_parents", lambda s: _pairs(edits.edit_pairs(s.collection("status"), _new_ids(s).unionByName(s.pairings("status")), edits.toggle_pairs).pairings), _with("status") + f'SELECT 7 AS "Tag_ID", id + 10000000 AS "Taggable_ID" FROM p WHERE tag = {F_}')


def _m7_nulls(s: Star) -> DataFrame:
    """The system's values stored twice, with one more for each."""
    rows = s.table("orders").select(F.col("o_orderkey").alias("id"), F.lit(PRICE).alias("metric"), F.lit(None).cast("long").alias("user"), F.col("o_orderkey").alias("taggable"))
    more = rows.withColumn("id", F.lit(None).cast("long")).unionByName(rows.withColumn("id", F.lit(None).cast("long")).withColumn("taggable", -1 - F.col("taggable")))
    return edits.upsert(rows, more, ["metric", "user", "taggable"], "id", "taggable").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("taggable") < 0).alias("new"))


_star("m7_upsert_nulls", _m7_nulls, "SELECT 2 * count(*) AS n, 2 * count(*) AS ids, count(*) AS new FROM orders")


def _sidecars(s: Star) -> DataFrame:
    """Parts as media files: their brand as a tag with a namespace, their type as one without, a note, and a date."""
    tag = lambda ns, c: F.struct(ns.cast("string").alias("namespace"), F.col(c).alias("name"))
    dates = [F.col("p_size").cast("long").alias(v) for v in archives.DATES.values()]
    return s.table("part").select(
        F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), F.lit(".png").alias("extension"), F.lit("").alias("path"),
        F.array(tag(F.lit("brand"), "p_brand"), tag(F.lit(None), "p_type")).alias("tags"), F.array("p_name").alias("notes"), F.array().cast("array<string>").alias("urls"), *dates,
    )


def _m12(s: Star) -> DataFrame:
    c, _ = edits.import_chunk(s.collection("status"), _sidecars(s), 9, 5)
    spaces = c.tags_namespaces.join(c.namespaces, "Namespace_ID").select("Tag_ID", "Namespace_Name")
    mine = c.tags.where("Local_Tag_Service_ID = 9").select("Tag_ID", "Lookup_Name").join(spaces, "Tag_ID", "left")
    held = c.pairings.join(c.taggables.where("Service_ID = 5").select("Taggable_ID"), "Taggable_ID", "left_semi")
    return held.join(mine, "Tag_ID").groupBy("Lookup_Name", F.coalesce("Namespace_Name", F.lit("")).alias("namespace")).agg(F.count("*").alias("n"))


_star("m12_import", _m12, "SELECT p_brand AS \"Lookup_Name\", 'brand' AS namespace, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_type, '', count(*) FROM part GROUP BY 1")
_star("m12_import_dates", lambda s: edits.import_chunk(s.collection("status"), _sidecars(s), 9, 5)[1]["dates"].agg(F.count("*").alias("n"), F.count_distinct("Taggable_ID").alias("ids"), F.min("Taggable_ID").alias("low"), F.sum("Taggable_Created_Date").alias("total")), "SELECT count(*) AS n, count(*) AS ids, (SELECT max(o_orderkey) + 1 FROM orders) AS low, sum(p_size) AS total FROM part")


def _importables(s: Star) -> DataFrame:
    """Parts as files of two services: a hash, an extension, a tag with a namespace, a metric, an address, a note and dates; every tenth row twice. They are many times as large as the parts, whose file may be one task's."""
    p = s.table("part").repartition(4 * s.spark.sparkContext.defaultParallelism, "p_partkey").withColumn("twice", F.explode(F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    tag = lambda c, space: F.struct(F.lit(9).alias("Local_Tag_Service_ID"), F.col(c).alias("Lookup_Name"), F.lit("parts").alias("Source_Name"), F.col(c).alias("Display_Name"), F.array(*map(F.lit, space)).cast("array<string>").alias("Namespaces"))
    return p.select(
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("File_Hash"), F.lit(".JPEG").alias("File_Extension"), F.col("p_name").alias("Taggable_Name"), (5 + F.col("p_partkey") % 2).cast("int").alias("Service_ID"),
        F.array(tag("p_brand", ["brand"]), tag("p_type", [])).alias("Tags"),
        F.array(F.struct(F.lit(PRICE).alias("Local_Metric_ID"), F.lit(1).cast("long").alias("User_ID"), F.col("p_retailprice").cast("double").alias("Applied_Value"))).alias("Metrics"),
        F.array(F.struct(F.concat(F.lit("http://parts/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 2 == 0, "page").alias("association"))).alias("URLs"),
        F.array(F.struct(F.lit("made").alias("association"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("note"))).alias("Notes"), *(F.col("p_size").cast("long").alias(d) for d in imports.DATES),
    )


def _imported(s: Star) -> imports.Archive:
    """Imported twice: the second time changes nothing."""
    once = imports.import_files(imports.Archive.of(s.collection("status")), _importables(s))
    return imports.import_files(once, _importables(s))


def _import_sizes(s: Star) -> DataFrame:
    a = _imported(s)
    held = {"files": a.files, "taggable_files": a.taggable_files, "notes": a.notes, "dates": a.dates, "taggables": a.collection.taggables.where("Service_ID >= 5"), "brands": a.collection.tags.where("Local_Tag_Service_ID = 9"), "applied": a.collection.applied_metrics.join(a.taggable_files, "Taggable_ID", "left_semi")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, df in held.items()]
    return reduce(DataFrame.unionByName, parts)


def _import_facts(s: Star) -> DataFrame:
    """Names of system tags, up to what tells files apart, with how many imported taggables have them."""
    a = _imported(s)
    mine = a.collection.tags.where(F.col("Source_Name") == names.SYSTEM_SOURCE).select("Tag_ID", F.regexp_replace("Lookup_Name", "(hash:|parts/)[0-9a-f]+|(value:|metric:).*", "$1$2").alias("fact"))
    return a.collection.pairings.join(a.taggable_files, "Taggable_ID", "left_semi").join(mine, "Tag_ID").groupBy("fact").agg(F.count("*").alias("n"))


_star("m12_import_twice", _import_sizes, """SELECT unnest(['files', 'taggable_files', 'notes', 'dates', 'taggables', 'applied']) AS what, (SELECT count(*) FROM part) AS n UNION ALL SELECT 'brands', (SELECT count(DISTINCT p_brand) + count(DISTINCT p_type) FROM part)""")
_star("m12_import_facts", _import_facts, """WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 2 = 0) AS even FROM part)
SELECT 'system:has file hash:' AS fact, n FROM n UNION ALL SELECT 'system:has file extension:.jpg', n FROM n UNION ALL SELECT 'system:has url:http://parts/', n FROM n UNION ALL SELECT 'system:has url with association:http://parts/ with' || chr(1) || ' page', even FROM n
UNION ALL SELECT 'system:in local taggable service:5', even FROM n WHERE even > 0 UNION ALL SELECT 'system:in local taggable service:6', n - even FROM n WHERE n > even
UNION ALL SELECT 'system:has local metric:', n FROM n UNION ALL SELECT 'system:applied metric:', n FROM n UNION ALL SELECT 'system:has metric from local metric service:1', n FROM n""")


def _shapes() -> Column:
    return F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(":"), "p_name")).otherwise(F.concat_ws(":", "p_type", "p_name", F.lit("x")))




def _m13(s: Star) -> DataFrame:
    return s.table("part").select("p_partkey", archives.split_tag(_shapes()).alias("t")).select("p_partkey", "t.namespace", F.col("t.name").alias("tag"))


_star("m13_split_tags", _m13, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_type END AS namespace, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN ':' || p_name ELSE p_name || ':x' END AS tag FROM part")
def _notes(s: Star) -> DataFrame:
    """Parts with a note get a second one, and the tag that says that they have notes."""
    old = s.table("part").select(F.col("p_partkey").alias("Taggable_ID"), F.col("p_name").alias("note"))
    new = s.table("part").where("p_size > 25").select(F.col("p_partkey").alias("Taggable_ID"), F.col("p_type").alias("note"))
    notes, pairings = edits.add_notes(old, new, s.pairings("status").limit(0), 8)
    return notes.groupBy("Taggable_ID").agg(F.array_join(F.array_sort(F.collect_list("note")), "|").alias("notes")).join(pairings, "Taggable_ID", "left").select("Taggable_ID", "notes", F.col("Tag_ID").isNotNull().alias("tagged"))


_star("m14_more_notes", _notes, """SELECT p_partkey AS "Taggable_ID", CASE WHEN p_size > 25 THEN array_to_string(list_sort([p_name, p_type]), '|') ELSE p_name END AS notes, p_size > 25 AS tagged FROM part""")
_star("m15_delete_taggable_service", lambda s: _pairs(edits.delete_taggable_service(s.collection("status", "flag"), 1).pairings), _with("status", "flag") + f"SELECT {_AS} FROM p WHERE id % 3 <> 1")
_star("m15_delete_metric_service", lambda s: edits.delete_metric_service(s.collection("status"), 2).applied_metrics.select("Local_Metric_ID", "Taggable_ID"), f'SELECT {PRICE} AS "Local_Metric_ID", o_orderkey AS "Taggable_ID" FROM orders')
_star("m15_delete_children", lambda s: edits.delete_children(s.table("nation").withColumnRenamed("n_nationkey", "k"), s.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("k")), "n_regionkey = 1", "k")[1].select("s_suppkey"), "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_star("m15_update", lambda s: edits.update_rows((t := s.tags("status", "segment")).drop("Namespace_ID"), t.where("Namespace_ID = 3").select("Tag_ID", F.concat(F.lit("x "), "Lookup_Name").alias("Display_Name")), "Tag_ID").select("Tag_ID", "Lookup_Name", "Display_Name"), _with("status", "segment") + "SELECT DISTINCT tag AS \"Tag_ID\", lookup AS \"Lookup_Name\", CASE WHEN tag >= 102000 THEN 'x ' ELSE '' END || lookup AS \"Display_Name\" FROM p")
_star("a9_missing_ids", lambda s: edits.missing_ids(s.table("customer").select(F.col("c_custkey").alias("k")), s.table("supplier").select((F.col("s_suppkey") * 20).alias("k")), "k"), "SELECT DISTINCT s_suppkey * 20 AS k FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)")
_star("a10_services_of", lambda s: edits.services_of((c := s.collection("status", "flag")).pairings.join(c.taggables.where("In_Trash").select("Taggable_ID"), "Taggable_ID", "left_semi"), c.tags, "Tag_ID", "Local_Tag_Service_ID"), _with("status", "flag") + f'SELECT DISTINCT CAST(CASE WHEN tag < 103000 THEN 1 ELSE 2 END AS INTEGER) AS "Local_Tag_Service_ID" FROM p WHERE id % {TRASH_EVERY} = 0')
_star("a14_packet_bytes", lambda s: edits.packet_bytes(s.table("orders").select("o_orderkey", "o_orderstatus")), """SELECT count(*) AS n, CAST(sum(length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}')) AS BIGINT) AS bytes FROM orders""")

# Backups: written to the shared folder and read again.
_BACKUP = "Type int, File_ID long, Tags array<struct<Lookup_Name:string,Namespaces:array<string>>>, Metrics array<struct<Local_Metric_ID:int,Applied_Value:double>>, Local_Metric_Name string"


def _backup(s: Star) -> DataFrame:
    c = s.collection(*_SP)
    spaces = c.tags_namespaces.join(c.namespaces, "Namespace_ID").groupBy("Tag_ID").agg(F.array_sort(F.collect_set("Namespace_Name")).alias("Namespaces"))
    tags = c.pairings.join(c.tags, "Tag_ID").join(spaces, "Tag_ID").select(F.col("Taggable_ID").alias("File_ID"), "Lookup_Name", "Source_Name", "Namespaces", "Local_Tag_Service_ID")
    service = lambda df, col: df.select(F.col(col).alias("Service_ID")).distinct()
    parts = archives.backup_items(
        service(c.taggables, "Service_ID"), service(c.tags, "Local_Tag_Service_ID"), service(c.metrics, "Local_Metric_Service_ID"), c.metrics,
        c.taggables.select(F.col("Taggable_ID").alias("File_ID")), tags, c.applied_metrics.withColumnRenamed("Taggable_ID", "File_ID"),
    )
    folder = new_path(s.spark, "backup")
    archives.write_backup(parts, folder)
    return archives.read_backup(s.spark, folder, _BACKUP)


def _backup_counts(s: Star) -> DataFrame:
    return _backup(s).groupBy("Type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("Tags")), F.lit(0)).alias("tags"), F.coalesce(F.sum(F.size("Metrics")), F.lit(0)).alias("metrics"))


_star("s12_backup_layout", _backup_counts, f"""SELECT 0 AS "Type", 3 AS n, 0 AS tags, 0 AS metrics UNION ALL SELECT 1, 1, 0, 0 UNION ALL SELECT 2, 2, 0, 0 UNION ALL SELECT 3, 2, 0, 0
UNION ALL SELECT 4, count(*), 2 * count(*), (SELECT count(*) FROM ({_APPLIED})) FROM orders""")
_star("s11_backup_files", lambda s: _backup(s).where(F.col("Type") == archives.FILE).select("File_ID", F.array_join(F.transform("Tags", lambda t: F.concat_ws(":", F.get(t["Namespaces"], F.lit(0)), t["Lookup_Name"])), ",").alias("tags")), "SELECT o_orderkey AS \"File_ID\", 'priority:' || o_orderpriority || ',status:' || o_orderstatus AS tags FROM orders")



def _export(s: Star) -> DataFrame:
    """Line items as one array with delimiters, written in ranges and read by its delimiters."""
    folder = new_path(s.spark, "export")
    archives.write_export(s.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity")), ["l_orderkey", "l_linenumber"], folder)
    return archives.read_export(s.spark, folder, "l_orderkey long, l_linenumber int, l_quantity double")


_star("s12_export", _export, "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem")

# Files and sets.
_star("g1_pixel_hash", lambda s: s.table("documents").select("doc_id", duplicates.pixel_hash(F.col("text").cast("binary"), 1 + F.col("doc_id") % 2).alias("pixels")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS pixels FROM documents")


def _arriving(s: Star) -> DataFrame:
    """Documents that arrive as files of a folder: the least id of every hash, kept as state of a stream."""
    arriving, out, check = (new_path(s.spark, n) for n in ("arriving", "classes", "progress"))
    files = s.files().select("File_ID", "File_Hash")
    files.repartition(3).write.parquet(arriving)
    compare.class_stream(s.spark, arriving, "File_ID long, File_Hash string", out, check, files_each=2)
    return compare.classes(s.spark, out)


_star("g1_arriving_classes", _arriving, 'SELECT sha256(text) AS "File_Hash", min(doc_id) AS class_id FROM documents WHERE text IS NOT NULL GROUP BY 1')


def _exact_verdicts(s: Star) -> DataFrame:
    """Exact pairs; documents of one quality label count as one group."""
    groups = s.table("labels").select(F.col("doc_id").alias("File_ID"), F.col("quality").cast("long").alias("group_id"))
    pairs = duplicates.exact_pairs(s.files())
    none = pairs.select("File_ID_1", "File_ID_2").where("false")
    return duplicates.exact_verdicts(duplicates.checked(pairs, groups, none))


_star("g13_exact_verdicts", _exact_verdicts, """SELECT 'duplicates-with-same-quality-trash-larger' AS type, a.doc_id AS "File_ID_1", b.doc_id AS "File_ID_2" FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id
LEFT JOIN labels x ON x.doc_id = a.doc_id LEFT JOIN labels y ON y.doc_id = b.doc_id WHERE NOT coalesce(x.quality = y.quality, false)""")


def _shares(s: Star) -> DataFrame:
    """Labels as images, their embeddings as descriptors."""
    d = s.table("embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("at"), F.col("embedding").alias("vector"))
    labels = s.table("embeddings").select("label").distinct()
    pairs = labels.select(F.col("label").alias("a"), F.explode(F.sequence(F.col("label") + 1, F.col("label") + 3)).alias("b"))
    return duplicates.descriptor_shares(d, pairs, block=32, ratio=0.95).select("a", "b", F.round("share", 9).alias("share"))


_star("g4_descriptor_shares", _shares, """WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT x.label AS a, y.label AS b, x.vec_id AS k, list_distance(x.v, y.v) AS d FROM e x JOIN e y ON y.label BETWEEN x.label + 1 AND x.label + 3),
t AS (SELECT a, b, k, min(d) AS d1, list_sort(list(d))[2] AS d2 FROM d GROUP BY a, b, k) SELECT a, b, round(avg(CASE WHEN d1 > 0.95 * d2 THEN 1.0 ELSE 0.0 END), 9) AS share FROM t WHERE d2 IS NOT NULL GROUP BY a, b""")


def _o9(s: Star) -> DataFrame:
    words, more = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    merged = sets.merged([F.create_map(F.lit("a"), F.col("p_size").cast("long"), F.lit("b"), F.lit(1).cast("long")), F.create_map(F.lit("b"), F.col("p_partkey"))])
    return s.table("part").select(
        "p_partkey", F.size(sets.intersect_all([more, words, more])).cast("long").alias("common"), F.element_at(merged, "a").alias("a"), F.element_at(merged, "b").alias("b"),
        F.array_join(sets.toggled(words, F.lit("red")), " ").alias("toggled"), sets.equal_sets(words, F.reverse(words)).alias("same"), sets.equal_sets(words, more).alias("like_more"),
    )


_star("o9_sets", _o9, """SELECT p_partkey, CAST(len(list_distinct(string_split(p_name, ' '))) AS BIGINT) AS common, CAST(p_size AS BIGINT) AS a, p_partkey AS b,
array_to_string(CASE WHEN list_contains(w, 'red') THEN list_filter(w, lambda x: x <> 'red') ELSE list_append(w, 'red') END, ' ') AS toggled, true AS same, list_has_all(w, string_split(p_type, ' ')) AS like_more
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")

# Content programs over markup and JSON made of the tables' columns.
P = programs


def _over(column: Callable[[], Column], program: dict, table: str, key: str):
    return lambda s: s.table(table).select(key, P.extract(program, column()).alias("r")).select(key, F.array_join("r.importFileNames", " ").alias("files"), F.array_join(F.col("r.additionalUrls.url"), " ").alias("urls"))


def _images() -> Column:
    return F.concat(F.lit("<div><a href='"), "url", F.lit("'><p><b><img src='"), F.col("page_id").cast("string"), F.lit(".png'></b></p></a><a href='far'><i><b><u><img src='far.png'></u></b></i></a></div>"), "html")


_star("x24_images", _over(_images, P.default_html(), "pages", "page_id"), "SELECT page_id, page_id || '.png far.png' AS files, url AS urls FROM pages")
_FAR = {"type": P.GROUP, "groupType": " and ", "expressions": [{"type": P.VALUE, "attributeName": "href", "operator": "contains", "value": "o"}, {"type": P.NOT, "expression": {"type": P.ELEMENT, "operator": "!=", "value": "a"}}]}
_TRAITS = {"type": P.HTML, "then": [{"type": P.ROOT, "then": [{"type": P.DESCENDANTS, "then": [{"type": P.TRAITS, "traits": _FAR, "then": [{"type": P.GET_ATTRIBUTE, "attributeName": "href", "then": [P.emit()]}]}]}]}]}
_star("x7_traits", _over(lambda: F.col("html"), _TRAITS, "pages", "page_id"), """SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: contains(x, 'o')), ' ') AS files, '' AS urls FROM pages""")
def _numbers() -> Column:
    return F.concat(F.lit("<i n='"), F.col("p_size").cast("string"), F.lit("' id='x'></i>"))


_OVER_20 = {"type": P.HTML, "then": [{"type": P.ROOT, "then": [{"type": P.DESCENDANTS, "then": [{"type": P.TRAITS, "traits": {"type": P.VALUE, "attributeName": "n", "operator": ">", "value": "20"}, "then": [{"type": P.GET_ATTRIBUTE, "attributeName": "n", "then": [P.emit()]}]}]}]}]}
_star("x7_numbers", _over(_numbers, _OVER_20, "part", "p_partkey"), "SELECT p_partkey, CASE WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) ELSE '' END AS files, '' AS urls FROM part")
def _event() -> Column:
    return F.to_json(F.struct(F.col("event_type").alias("a"), F.array(F.col("event_type"), F.lit("x")).alias("b"), F.struct(F.col("event_id").alias("n")).alias("c")))


_star("x11_json_strings", _over(_event, {"type": P.JSON, "then": [{"type": P.STRINGS, "then": [P.emit()]}]}, "events", "event_id"), "SELECT event_id, event_type || ' ' || event_type || ' x' AS files, '' AS urls FROM events")
_star("x12_json_nth", _over(_event, {"type": P.JSON, "then": [{"type": P.NTH, "n": 1, "then": [{"type": P.TO_ARRAY, "then": [P.emit(depth=1)]}]}]}, "events", "event_id"), "SELECT event_id, '' AS files, event_type || ' x' AS urls FROM events")
_CHOOSE = {"type": P.IF, "ifCheck": {"type": P.STARTS, "prefixes": ["brand#1"], "caseSensitive": False}, "trueCase": {"type": P.LOWER}, "elseCase": {"type": P.SAME}, "then": [{"type": P.EMIT_FILE}]}
_star("x21_conditional", _over(lambda: F.col("p_brand"), _CHOOSE, "part", "p_partkey"), "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN lower(p_brand) ELSE p_brand END AS files, '' AS urls FROM part")
def _media() -> Column:
    return F.to_json(F.struct(F.array(F.concat(F.upper("url"), F.lit("/A.JPG")), F.col("url"), F.concat("url", F.lit("/a.jpg"))).alias("u")))


_star("x25_default_json", _over(_media, P.default_json(), "pages", "page_id"), "SELECT page_id, array_to_string(list_distinct([lower(url) || '/a.jpg']), ' ') AS files, '' AS urls FROM pages")

# Names, numbers and lines.
_star("f2_builders", lambda s: s.table("part").select("p_partkey", *(f(F.col("p_partkey")).alias(n) for n, f in (("in_service", names.of_service), ("metric", names.of_metric), ("metric_service", names.of_metric_service), ("parser", names.of_parser))), names.of_url(F.col("p_name")).alias("url"), names.of_url_association(F.col("p_name"), F.col("p_type")).alias("association"), names.of_hash(F.upper("p_name")).alias("hash")), """SELECT p_partkey, 'system:in local taggable service:' || p_partkey AS in_service, 'system:has local metric:' || p_partkey AS metric, 'system:has metric from local metric service:' || p_partkey AS metric_service,
'system:is from local url parser:' || p_partkey AS parser, 'system:has url:' || p_name AS url, 'system:has url with association:' || p_name || ' with' || chr(1) || ' ' || p_type AS association, 'system:has file hash:' || lower(p_name) AS hash FROM part""")
_star("f2_read_back", lambda s: s.applied_metrics().select(names.of_applied(F.col("Applied_Value"), F.col("Local_Metric_ID"), F.when(F.col("User_ID") > 0, F.col("User_ID"))).alias("n"), "Taggable_ID").select("Taggable_ID", *(c.alias(n) for n, c in zip(("value", "metric", "user"), names.applied(F.col("n")), strict=True))), f'SELECT id AS "Taggable_ID", v AS value, CAST(metric AS BIGINT) AS metric, nullif(u, 0) AS user FROM ({_APPLIED})')
_star("f5_clamp", lambda s: s.table("part").select("p_partkey", names.clamp(F.col("p_size"), F.lit(10), F.lit(40)).alias("size")), "SELECT p_partkey, least(greatest(p_size, 10), 40) AS size FROM part")
_star("f6_now", lambda s: s.table("region").select("r_regionkey", (F.abs(names.now() - F.unix_timestamp(F.current_timestamp())) <= 1).alias("is_now")), "SELECT r_regionkey, true AS is_now FROM region")
_star("f7_lines", lambda s: s.table("documents").select("doc_id", F.array_join(archives.lines(F.col("text")), "|").alias("x")).select("doc_id", F.md5("x").alias("lines")), "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), '|')) AS lines FROM documents")
_star("f8_dates", lambda s: s.table("part").select("p_partkey", archives.epoch(F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit(" -")).otherwise(F.lit("at ")), F.col("p_size").cast("string"), F.lit("\n"))).alias("date")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(-p_size AS BIGINT) END AS date FROM part")

# Pairings in buckets, and counts that follow edits.


def _some(s: Star) -> DataFrame:
    """Pairs to edit with: those of status F whose order's number is odd, and as many that no one has."""
    odd = s.pairings("status").where((F.col("Tag_ID") == F_) & (F.col("Taggable_ID") % 2 == 1))
    return odd.unionByName(odd.withColumn("Tag_ID", F.lit(7).cast("long")))


_KINDS = {
    "insert": 'SELECT tag AS "Tag_ID", id AS "Taggable_ID" FROM p UNION SELECT * FROM e',
    "delete": 'SELECT tag AS "Tag_ID", id AS "Taggable_ID" FROM p EXCEPT SELECT * FROM e',
    "toggle": '(SELECT tag AS "Tag_ID", id AS "Taggable_ID" FROM p EXCEPT SELECT * FROM e) UNION ALL (SELECT * FROM e EXCEPT SELECT tag, id FROM p)',
}
_EDIT = {"e": f"SELECT tag, id FROM p WHERE tag = {F_} AND id % 2 = 1 UNION ALL SELECT 7, id FROM p WHERE tag = {F_} AND id % 2 = 1"}


def _bucketed(kind: str) -> Callable[[Star], DataFrame]:
    def run(s: Star) -> DataFrame:
        table = stored.Bucketed(s.spark, new_path(s.spark, "pairings"), 32).create(s.pairings("status", "priority"))
        table.edit(_some(s), kind)
        return table.read()

    return run


for _kind, _sql in _KINDS.items():
    _star(f"m_{_kind}_in_buckets", _bucketed(_kind), _with(*_SP, **_EDIT) + _sql)


def _kept_counts(s: Star) -> DataFrame:
    """Counts of two groups after an insert, a delete and a toggle, none of which counts anew."""
    groups = s.spark.createDataFrame([("done", F_), ("done", 7), ("urgent", URGENT)], "gid string, Tag_ID long")
    table = stored.Bucketed(s.spark, new_path(s.spark, "pairings"), 32).create(s.pairings("status", "priority"))
    held, counts = stored.multiplicities(groups, table.read()), counts_of(groups, table.read())
    held, counts = staged(held, "held"), staged(counts, "counts")
    for kind, pairs in (("insert", _some(s)), ("delete", s.pairings("status").where("Taggable_ID % 3 = 0")), ("toggle", s.pairings("priority").where("Taggable_ID % 5 = 0"))):
        held, changes = stored.count_changes(held, groups, table.edit(pairs, kind))
        held, counts = staged(held, "held"), stored.add_counts(counts, changes)
    return counts.select(F.col("gid").alias("group_id"), "count")


_star("a_kept_counts", _kept_counts, _with(*_SP, **_EDIT) + f"""SELECT 'done' AS group_id, count(DISTINCT id) AS count FROM (SELECT tag, id FROM p WHERE tag = {F_} AND id % 3 <> 0 UNION SELECT 7, id FROM e)
UNION ALL SELECT 'urgent', count(*) FROM p WHERE tag = {URGENT} AND id % 5 <> 0""")

# Permissions and cursors.
_NAMED = AND(T(F_), T(RETURNED), q.Compare(">", QUANTITY, 10.0), q.HasMetric(PRICE))


def _grants(s: Star) -> DataFrame:
    kinds = F.array(*map(F.lit, (access.READ_TAGS, access.READ_METRIC, access.READ_TAGGABLES)))
    return s.table("supplier").select((F.col("s_suppkey") % 2 + 1).cast("int").alias("Service_ID"), F.col("s_nationkey").cast("long").alias("User_ID"), F.get(kinds, (F.col("s_suppkey") % 3).cast("int")).alias("Permission"))


_star("u1_lacking", lambda s: access.lacking(s.collection("status", "flag"), _NAMED, _grants(s), access.User(7)), """WITH n AS (SELECT * FROM (VALUES ('tag', 1, 'LTS.RT'), ('tag', 2, 'LTS.RT'), ('metric', 1, 'LMS.RM'), ('metric', 2, 'LMS.RM')) AS t(k, s, p)),
g AS (SELECT s_suppkey % 2 + 1 AS s, CASE s_suppkey % 3 WHEN 0 THEN 'LTS.RT' WHEN 1 THEN 'LMS.RM' ELSE 'LTgbS.RT' END AS p FROM supplier WHERE s_nationkey = 7)
SELECT k AS kind, CAST(s AS INTEGER) AS "Service_ID", p AS "Permission" FROM n ANTI JOIN g USING (s, p)""")


def _checked(s: Star) -> DataFrame:
    """The flagship for user 0, who may read all tags, and taggables of the services that regions of even keys stand for."""
    granted = s.table("region").select(F.col("r_regionkey").alias("Service_ID"), (F.col("r_regionkey") % 2).cast("long").alias("User_ID"), F.lit(access.READ_TAGGABLES).alias("Permission"))
    return access.checked_search(Search(s.collection(*_SP)), FLAGSHIP, granted, access.User(0, frozenset({access.READ_TAGS})))


_star("u1_checked_search", _checked, _with(*_SP, found=_FOUND) + 'SELECT id AS "Taggable_ID" FROM found WHERE id % 3 IN (0, 2)')
def _refusals(s: Star) -> DataFrame:
    """May nation 3's user read the tags and taggables of some orders, write metrics, and import?"""
    c = s.collection("status", "flag")
    request = access.Request(tags=c.tags.select("Tag_ID").unionByName(s.spark.createDataFrame([(5,)], "Tag_ID long")), taggables=c.taggables.where("Taggable_ID % 10 = 1").select("Taggable_ID"), files=s.table("part").select(F.col("p_partkey").alias("File_ID")))
    granted = s.table("region").select((F.col("r_regionkey") % 3).cast("int").alias("Service_ID"), F.lit(3).cast("long").alias("User_ID"), F.when(F.col("r_regionkey") < 2, access.READ_TAGS).otherwise(access.READ_TAGGABLES).alias("Permission"))
    of_parts = s.table("lineitem").where("l_partkey % 7 <> 0").select(F.col("l_partkey").alias("File_ID"), F.col("l_orderkey").alias("Taggable_ID"))
    return access.refusals(c, request, [access.READ_TAGS, access.READ_TAGGABLES, access.APPLY_METRIC, "A.Import"], granted, access.User(3), of_parts)


# Tags may be read in services 0 and 1, taggables in 2, 0 and 1 (regions 2, 3 and 4).
_star("u1_refusals", _refusals, _with("status", "flag", more="SELECT p_partkey AS f, count(o_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_partkey % 7 <> 0 LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1") + """SELECT CAST(NULL AS VARCHAR) AS scope, 'admin' AS kind, 'A.Import' AS id, 'refused' AS reason
UNION ALL SELECT 'tag', 'Tag_ID', '5', 'missing' UNION ALL SELECT 'tag', 'service', '2', 'refused' UNION ALL SELECT 'metric', 'scope', 'metric', 'unchecked' UNION ALL SELECT 'taggable', 'File_ID', CAST(f AS VARCHAR), 'missing' FROM more WHERE n = 0""")
_star("u4_sudo", lambda s: access.visible_services(s.table("nation").select(F.col("n_nationkey").alias("Service_ID")), _grants(s), access.User(7, sudo=True), [access.READ_TAGS]), 'SELECT n_nationkey AS "Service_ID" FROM nation')
_star("u6_reselect", lambda s: (c := access.Cursors()).get(c.reselect(c.add(_flagship(s, *_SP)[1]), s.taggables().where("Service_ID = 1"), "Taggable_ID")), _with(*_SP, found=_FOUND) + 'SELECT id AS "Taggable_ID" FROM found WHERE id % 3 = 1')
_star("j12_outside", lambda s: access.outside_ids(s.taggables().where("Service_ID = 1"), _flagship(s, *_SP)[1], "Taggable_ID"), _with(*_SP, found=_FOUND) + 'SELECT id AS "Taggable_ID" FROM u WHERE id % 3 = 1 AND id NOT IN (SELECT id FROM found)')

assert NAMESPACES["brand"] == 5 and "m12_import" in SQL  # the import's namespace is one that is known

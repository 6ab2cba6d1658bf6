"""The registered queries of the search engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, programs
from .operators import access, counts, duplicates, edits
from .plans import query as q
from .plans.collection import FIRST_TAG, NAMESPACES, PRICE, QUANTITY, TRASH_EVERY, Star, with_metrics
from .plans.search import Search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEARCHES: dict[str, tuple] = {}  # (query, namespaces, options) of those registered as searches
SQL: dict[str, str] = {}

F_, O_ = FIRST_TAG["status"] + ord("F"), FIRST_TAG["status"] + ord("O")
URGENT, HIGH = FIRST_TAG["priority"] + ord("1"), FIRST_TAG["priority"] + ord("2")
BUILDING, RETURNED = FIRST_TAG["segment"] + ord("B"), FIRST_TAG["flag"] + ord("R")

_PAIRS = {
    "status": "SELECT 100000 + ascii(o_orderstatus) AS tag, o_orderkey AS id, o_orderstatus AS lookup FROM orders",
    "priority": "SELECT 101000 + ascii(o_orderpriority), o_orderkey, o_orderpriority FROM orders",
    "segment": "SELECT 102000 + ascii(c_mktsegment), o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "flag": "SELECT DISTINCT 103000 + ascii(l_returnflag), l_orderkey, l_returnflag FROM lineitem",
    "brand": "SELECT DISTINCT 104000 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey",
    "part": "SELECT DISTINCT 1000000 + l_partkey, l_orderkey, CAST(l_partkey AS VARCHAR) FROM lineitem",
}
_APPLIED = (
    f"SELECT {PRICE} AS metric, o_custkey % 3 AS u, o_orderkey AS id, o_totalprice AS v FROM orders "
    f"UNION ALL SELECT {QUANTITY}, 0, l_orderkey, max(l_quantity) FROM lineitem GROUP BY l_orderkey"
)


def _with(*spaces: str, **more: str) -> str:
    """WITH the pairings p(tag, id, lookup), the universe u and the untrashed universe w, and more."""
    first = spaces[0] if spaces else "status"
    rest = [s for s in spaces if s != first]
    body = _PAIRS[first] if first == "status" else "SELECT * FROM (" + _PAIRS[first] + ") AS t(tag, id, lookup)"
    pairs = " UNION ALL ".join([body, *(_PAIRS[s] for s in rest)])
    parts = {"p": pairs, "u": "SELECT o_orderkey AS id FROM orders", "w": f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey % {TRASH_EVERY} <> 0"} | more
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " "


def _has(tag: int) -> str:
    return f"id IN (SELECT id FROM p WHERE tag = {tag})"


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def search(name: str, node: q.Node, spaces: tuple[str, ...], where: str, universe: str = "w", user: int | None = None, more: dict[str, str] | None = None, **options) -> None:
    """Register a search and the SQL of its condition."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Search(Star(spark, sf_dir).collection(*spaces), user=user, **options).run(node)

    SEARCHES[name] = (node, spaces, {"user": user} | options)
    register(name, run, _with(*spaces, **(more or {})) + f"SELECT id AS \"Taggable_ID\" FROM {universe} WHERE {where}")


T, U, I, N = q.Tag, lambda *p: q.Union(p), lambda *p: q.Intersect(p), q.Complement  # noqa: E741
FLAGSHIP = I(T(F_), U(T(URGENT), T(HIGH)))

search("o7_nested", FLAGSHIP, ("status", "priority"), f"{_has(F_)} AND ({_has(URGENT)} OR {_has(HIGH)})")
search("s1_universe", q.Universe(), ("status",), "true")
search("s2_empty", q.Empty(), ("status",), "false")
search("s3_tag_scan", T(BUILDING), ("segment",), _has(BUILDING))
search("s4_literal_list", q.Literal((1, 2, 3, 3, 97, 194, 10**9)), ("status",), "id IN (1, 2, 3, 97, 194, 1000000000)")
search("o1_union", U(T(F_), T(RETURNED)), ("status", "flag"), f"{_has(F_)} OR {_has(RETURNED)}")
search("o2_intersect", I(T(F_), T(BUILDING), T(RETURNED)), ("status", "segment", "flag"), f"{_has(F_)} AND {_has(BUILDING)} AND {_has(RETURNED)}")
search("o3_complement", N(U(T(F_), T(URGENT))), ("status", "priority"), f"NOT ({_has(F_)} OR {_has(URGENT)})")
search("o4_difference", q.Difference(T(F_), T(RETURNED)), ("status", "flag"), f"{_has(F_)} AND NOT {_has(RETURNED)}")
search("o5_xor", q.SymmetricDifference(T(F_), T(RETURNED)), ("status", "flag"), f"({_has(F_)}) <> ({_has(RETURNED)})")
search("o8_constants", U(q.Empty(), I(q.Universe(), N(N(T(O_))))), ("status",), _has(O_))
search("p2_lookup_union", U(q.Lookup("BUILDING"), q.Lookup("F"), q.Lookup("no such tag")), ("status", "segment"), "id IN (SELECT id FROM p WHERE lookup IN ('BUILDING', 'F'))")
search("p2_lookup_in_service", U(q.Lookup("R"), q.Lookup("F")), ("status", "flag"), "id IN (SELECT id FROM p WHERE lookup = 'R')", tag_services=(2,))
search("p3_has_metric", q.HasMetric(QUANTITY), ("status",), f"id IN (SELECT id FROM m WHERE metric = {QUANTITY})", more={"m": _APPLIED})
search("p4_metric_in_service", I(q.InMetricService(1), T(F_)), ("status",), f"id IN (SELECT id FROM m WHERE metric = {PRICE}) AND {_has(F_)}", more={"m": _APPLIED})
for _name, _op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">="), ("eq", "="), ("ne", "<>")):
    search(f"p5_metric_{_name}", q.Compare(_op, QUANTITY, 40.0), ("status",), f"id IN (SELECT id FROM m WHERE metric = {QUANTITY} AND u = 0 AND v {_op} 40)", user=0, more={"m": _APPLIED})
search("p5_other_user", q.Compare(">", PRICE, 100_000.0), ("status",), f"id IN (SELECT id FROM m WHERE metric = {PRICE} AND u = 1 AND v > 100000)", user=1, more={"m": _APPLIED})
search("p6_with_trash", T(F_), ("status",), _has(F_), universe="u", with_trash=True)
search("p6_not_trash", T(F_), ("status",), _has(F_))
search("p7_service_scope", U(T(F_), T(URGENT)), ("status", "priority"), f"id % 3 IN (0, 2) AND ({_has(F_)} OR {_has(URGENT)})", taggable_services=(0, 2))

_FINISHED = T(F_)
_BRANDS = q.NamespaceList(NAMESPACES["brand"])


def _listed(having: str) -> dict[str, str]:
    """f: the orders of the brands that meet a condition on b, the brands' orders; s marks those of status F, r those of priority 1."""
    return {
        "s": f"SELECT DISTINCT id FROM p WHERE tag = {F_}",
        "r": f"SELECT DISTINCT id FROM p WHERE tag = {URGENT}",
        "b": "SELECT p.tag, p.id, s.id IS NOT NULL AS s, r.id IS NOT NULL AS r FROM p LEFT JOIN s ON s.id = p.id LEFT JOIN r ON r.id = p.id WHERE p.tag >= 104000",
        "l": f"SELECT tag FROM b GROUP BY tag HAVING {having}",
        "f": "SELECT DISTINCT b.id FROM b JOIN l ON l.tag = b.tag",
    }


def conditional(name: str, conditions: tuple[q.Condition, ...], having: str) -> None:
    search(name, q.ListUnion(_BRANDS, conditions), ("status", "priority", "brand"), "true", universe="w JOIN f USING (id)", more=_listed(having))


_N = "count(*) FILTER (WHERE s)"
conditional("c1_namespace_union", (), "true")
conditional("c3_count", (q.Condition("count", ">=", 50, _FINISHED),), f"{_N} >= 50")
conditional("c4_percent", (q.Condition("percent", ">", 0.33, _FINISHED),), f"CAST(CAST({_N} AS DOUBLE) / count(*) AS REAL) > CAST(0.33 AS REAL)")
conditional("c5_filtered_percent", (q.Condition("filtered", "<", 0.2, T(URGENT), _FINISHED),), f"CAST(CAST(count(*) FILTER (WHERE s AND r) AS DOUBLE) / nullif({_N}, 0) AS REAL) < CAST(0.2 AS REAL)")
conditional("c6_not_in_list", (q.Condition("not-in", dropped=(T(FIRST_TAG["brand"] + 1), q.Lookup("Brand#12"), q.Lookup("Brand#7"))), q.Condition("count", ">", 10, _FINISHED)), f"tag NOT IN (104001, 104012, 104007) AND {_N} > 10")
conditional("c_combined", (q.Condition("count", ">=", 50, _FINISHED), q.Condition("percent", ">", 0.33, _FINISHED), q.Condition("filtered", "<=", 0.25, T(URGENT), _FINISHED)), f"{_N} >= 50 AND CAST(CAST({_N} AS DOUBLE) / count(*) AS REAL) > CAST(0.33 AS REAL) AND CAST(CAST(count(*) FILTER (WHERE s AND r) AS DOUBLE) / nullif({_N}, 0) AS REAL) <= CAST(0.25 AS REAL)")
search("c_complement", N(q.ListUnion(_BRANDS, (q.Condition("count", ">=", 50, _FINISHED),))), ("status", "priority", "brand"), "true", universe="w ANTI JOIN f USING (id)", more=_listed(f"{_N} >= 50"))
conditional("p8_count_equal", (q.Condition("count", "=", 0, I(_FINISHED, T(O_))),), "count(*) FILTER (WHERE s AND false) = 0")
conditional("p8_count_unequal", (q.Condition("count", "<>", 0, I(_FINISHED, T(URGENT))),), "count(*) FILTER (WHERE s AND r) <> 0")
search("c2_metric_list", q.ListUnion(q.MetricList(QUANTITY), (q.Condition("percent", ">=", 0.34, _FINISHED),)), ("status",), f"id IN (SELECT id FROM m WHERE metric = {QUANTITY} AND v IN (SELECT v FROM m WHERE metric = {QUANTITY} AND u = 0 GROUP BY v HAVING CAST(CAST(count(*) FILTER (WHERE id IN (SELECT id FROM p WHERE tag = {F_})) AS DOUBLE) / count(*) AS REAL) >= CAST(0.34 AS REAL)))", user=0, more={"m": _APPLIED})


def _star(name: str, run: Callable[[Star], DataFrame], sql: str | None) -> None:
    register(name, lambda spark, sf_dir: run(Star(spark, sf_dir)), sql)


def _flagship(s: Star, *spaces: str) -> tuple:
    c = s.collection(*spaces)
    return c, Search(c).run(FLAGSHIP)


_FOUND = f"SELECT id FROM w WHERE {_has(F_)} AND ({_has(URGENT)} OR {_has(HIGH)})"
_SP = ("status", "priority")


def _a1(s: Star) -> DataFrame:
    c, found = _flagship(s, *_SP, "segment", "flag", "brand")
    groups = c.tags_namespaces.select(F.col("Namespace_ID").cast("string").alias("group_id"), "Tag_ID")
    one = c.tags.select(F.concat(F.lit("tag "), F.col("Tag_ID").cast("string")).alias("group_id"), "Tag_ID").where("Tag_ID >= 104000")
    return counts.group_counts(groups.unionByName(one), c.pairing_rows, found)


_star("a1_group_counts", _a1, _with(*_SP, "segment", "flag", "brand", found=_FOUND) + """
SELECT g AS group_id, count(DISTINCT CASE WHEN id IN (SELECT id FROM found) THEN id END) AS count
FROM (SELECT CASE WHEN tag < 101000 THEN '1' WHEN tag < 102000 THEN '2' WHEN tag < 103000 THEN '3' WHEN tag < 104000 THEN '4' ELSE '5' END AS g, id FROM p
UNION ALL SELECT 'tag ' || CAST(tag AS VARCHAR), id FROM p WHERE tag >= 104000) GROUP BY g""")
_star("a1_all_counts", lambda s: counts.group_counts((c := s.collection("brand", "segment")).tags.select(F.col("Tag_ID").alias("group_id"), "Tag_ID"), c.pairing_rows), _with("segment", "brand") + "SELECT tag AS group_id, count(DISTINCT id) AS count FROM p GROUP BY tag")
_star("a2_tag_groups", lambda s: counts.tag_groups(s.collection()).select(F.array_join("Namespaces", ",").alias("namespaces"), "Lookup_Name", "Display_Name", F.array_join("tag_ids", ",").alias("tag_ids")), """
SELECT ns AS namespaces, lookup AS "Lookup_Name", ns || ':' || lookup AS "Display_Name", CAST(tag AS VARCHAR) AS tag_ids FROM (
SELECT DISTINCT 'status' AS ns, o_orderstatus AS lookup, 100000 + ascii(o_orderstatus) AS tag FROM orders
UNION ALL SELECT DISTINCT 'priority', o_orderpriority, 101000 + ascii(o_orderpriority) FROM orders
UNION ALL SELECT DISTINCT 'segment', c_mktsegment, 102000 + ascii(c_mktsegment) FROM customer
UNION ALL SELECT DISTINCT 'flag', l_returnflag, 103000 + ascii(l_returnflag) FROM lineitem
UNION ALL SELECT DISTINCT 'brand', p_brand, 104000 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) FROM part
UNION ALL SELECT DISTINCT 'part', CAST(l_partkey AS VARCHAR), 1000000 + l_partkey FROM lineitem)""")


def _a3(s: Star) -> DataFrame:
    c, found = _flagship(s, *_SP, "segment", "flag")
    return counts.service_counts(c, [1], found).select("Display_Name", "count")


_A3 = _with(*_SP, "segment", "flag", found=_FOUND) + """
SELECT CASE WHEN tag < 101000 THEN 'status:' WHEN tag < 102000 THEN 'priority:' ELSE 'segment:' END || lookup AS "Display_Name",
count(DISTINCT CASE WHEN id IN (SELECT id FROM found) THEN id END) AS count FROM p WHERE tag < 103000 GROUP BY 1"""
_star("a3_service_counts", _a3, _A3)
_star("t1_top_tags", lambda s: counts.by_count(_a3(s).where("count > 0")).limit(5), _A3 + ' HAVING count > 0 ORDER BY count DESC, "Display_Name" LIMIT 5')
_star("a4_namespace_counts", lambda s: counts.namespace_counts((x := _flagship(s, *_SP, "brand"))[0], NAMESPACES["brand"], x[1]).select("Display_Name", "count"), _with(*_SP, "brand", found=_FOUND) + "SELECT 'brand:' || lookup AS \"Display_Name\", count(DISTINCT CASE WHEN id IN (SELECT id FROM found) THEN id END) AS count FROM p WHERE tag >= 104000 GROUP BY lookup")
_star("a5_groups_per_taggable", lambda s: counts.groups_of((x := _flagship(s, *_SP, "segment", "flag"))[1], x[0], [1]).select("Taggable_ID", F.array_join("groups", ",").alias("groups")), _with(*_SP, "segment", found=_FOUND) + """
SELECT id AS "Taggable_ID", string_agg(CASE WHEN tag < 101000 THEN 'status:' WHEN tag < 102000 THEN 'priority:' ELSE 'segment:' END || lookup, ',' ORDER BY CASE WHEN tag < 101000 THEN 'status:' WHEN tag < 102000 THEN 'priority:' ELSE 'segment:' END || lookup) AS groups
FROM p WHERE id IN (SELECT id FROM found) GROUP BY id""")
_star("s5_tags_of_taggable", lambda s: counts.tags_of((c := s.collection("status", "flag")).taggables, c.pairings).select("Taggable_ID", F.array_join("tag_ids", ",").alias("tag_ids")), _with("status", "flag") + "SELECT u.id AS \"Taggable_ID\", coalesce(string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag), '') AS tag_ids FROM u LEFT JOIN p ON p.id = u.id GROUP BY u.id")
_star("s6_restricted_tags", lambda s: counts.tags_of((c := s.collection("status", "flag")).taggables, c.pairings, c.tags.where(F.col("Lookup_Name").isin("R", "P"))).select("Taggable_ID", F.array_join("tag_ids", ",").alias("tag_ids")), _with("status", "flag") + "SELECT u.id AS \"Taggable_ID\", coalesce(string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag), '') AS tag_ids FROM u LEFT JOIN (SELECT * FROM p WHERE lookup IN ('R', 'P')) p ON p.id = u.id GROUP BY u.id")
_star("a13_invert", lambda s: counts.invert(counts.tags_of((c := s.collection("status")).taggables, c.pairings), "Taggable_ID", "tag_ids", "Tag_ID").select("Tag_ID", F.size("Taggable_IDs").cast("long").alias("n"), F.element_at("Taggable_IDs", -1).alias("last")), _with("status") + 'SELECT tag AS "Tag_ID", count(DISTINCT id) AS n, max(id) AS last FROM p GROUP BY tag')
_star("p10_tag_filter", lambda s: counts.filter_box(counts.tag_groups(s.collection("brand", "segment", "priority")), "brand:Brand#1").select("Display_Name"), "SELECT DISTINCT 'brand:' || p_brand AS \"Display_Name\" FROM part WHERE p_brand LIKE 'Brand#1%'")
_star("p11_prune", lambda s: counts.prune(counts.service_counts((x := _flagship(s, "status", "priority"))[0], [1], x[1])).select("Display_Name", "count"), "SELECT * FROM (" + _with(*_SP, found=_FOUND) + """SELECT CASE WHEN tag < 101000 THEN 'status:' ELSE 'priority:' END || lookup AS "Display_Name", count(DISTINCT CASE WHEN id IN (SELECT id FROM found) THEN id END) AS count FROM p GROUP BY 1) WHERE count > 0""")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("Tag_ID", "Taggable_ID")


def _new_pairs(s: Star) -> DataFrame:
    """Every order whose key ends in 5 gets tag 7, and those of status F tag F once more."""
    five = s.taggables().where("Taggable_ID % 10 = 5")
    return five.select(F.lit(7).cast("long").alias("Tag_ID"), "Taggable_ID").unionByName(_pairs(s.pairings("status")).where(F.col("Tag_ID") == F_))


_NEW = f"SELECT 7 AS tag, id FROM u WHERE id % 10 = 5 UNION ALL SELECT tag, id FROM p WHERE tag = {F_}"
_AS = 'tag AS "Tag_ID", id AS "Taggable_ID"'
_star("m3_insert", lambda s: edits.insert_pairs(s.pairings("status"), _new_pairs(s)), _with("status", n=_NEW) + f"SELECT {_AS} FROM (SELECT tag, id FROM p UNION SELECT tag, id FROM n)")
_star("m4_delete", lambda s: edits.delete_pairs(s.pairings("status"), _new_pairs(s)), _with("status", n=_NEW) + f"SELECT {_AS} FROM (SELECT tag, id FROM p EXCEPT SELECT tag, id FROM n)")
_star("m5_toggle", lambda s: edits.toggle_pairs(s.pairings("status"), _new_pairs(s)), _with("status", n=_NEW) + f"SELECT {_AS} FROM (SELECT tag, id FROM p UNION ALL SELECT tag, id FROM n) GROUP BY tag, id HAVING count(*) % 2 = 1")
_star("m1_insert_ids", lambda s: edits.insert_ids(s.taggables().where("Taggable_ID % 2 = 0"), s.taggables().where("Taggable_ID % 3 = 0"), "Taggable_ID").select("Taggable_ID"), 'SELECT o_orderkey AS "Taggable_ID" FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0')
_star("m2_delete_taggables", lambda s: _pairs(edits.delete_ids((c := s.collection("status", "priority")), taggables=c.taggables.where("In_Trash").select("Taggable_ID")).pairings), _with(*_SP) + f"SELECT {_AS} FROM p WHERE id IN (SELECT id FROM w)")
_star("m2_delete_tags", lambda s: _pairs(edits.delete_ids((c := s.collection("status", "priority")), tags=c.tags.where("Local_Tag_Service_ID = 1 and Lookup_Name = 'F'").select("Tag_ID")).pairings), _with(*_SP) + f"SELECT {_AS} FROM p WHERE tag <> {F_}")


def _m8(s: Star) -> DataFrame:
    values = s.taggables().where("Taggable_ID % 4 = 0").select(F.lit(QUANTITY).alias("Local_Metric_ID"), F.lit(0).cast("long").alias("User_ID"), "Taggable_ID", F.lit(1.5).alias("Applied_Value"))
    return edits.apply_metric(s.applied_metrics(), values).select("Local_Metric_ID", "User_ID", "Taggable_ID", "Applied_Value")


_star("m8_apply_metric", _m8, f"""WITH m AS ({_APPLIED}) SELECT metric AS "Local_Metric_ID", CAST(u AS BIGINT) AS "User_ID", id AS "Taggable_ID", v AS "Applied_Value" FROM m WHERE NOT (metric = {QUANTITY} AND u = 0 AND id IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0))
UNION ALL SELECT {QUANTITY}, 0, o_orderkey, 1.5 FROM orders WHERE o_orderkey % 4 = 0""")
_star("m9_tag_to_metric", lambda s: edits.tag_to_metric(s.collection("status"), F_, 9, 2, 4.0, True).applied_metrics.where("Local_Metric_ID = 9").select("User_ID", "Taggable_ID", "Applied_Value"), _with("status") + f'SELECT CAST(2 AS BIGINT) AS "User_ID", id AS "Taggable_ID", CAST(4.0 AS DOUBLE) AS "Applied_Value" FROM p WHERE tag = {F_}')


def _m7(s: Star) -> DataFrame:
    known = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).where("id % 2 = 0")
    new = s.table("customer").select(F.lit(None).cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    out = edits.upsert(known, new, ["name"], "id", "at")
    return out.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("name").alias("names"), F.max("id").alias("top"))


_star("m7_upsert", _m7, "SELECT count(*) AS n, count(*) AS ids, count(DISTINCT c_name) AS names, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + count(*) FILTER (WHERE c_custkey % 2 <> 0) AS top FROM customer")


def _m10(s: Star) -> DataFrame:
    c = s.collection("status", "priority")
    out = edits.edit_tags(c, c.taggables.where("In_Trash").select("Taggable_ID"), ["F", "fresh"], ["F"], 1)
    return out.pairings.join(out.tags.select("Tag_ID", "Lookup_Name", "Source_Name"), "Tag_ID").where("Lookup_Name in ('F', 'fresh')").groupBy("Lookup_Name", "Source_Name").agg(F.count("*").alias("n"))


_star("m10_edit_tags", _m10, _with("status") + f"""SELECT 'F' AS "Lookup_Name", 'star' AS "Source_Name", count(*) AS n FROM p WHERE tag = {F_} AND id IN (SELECT id FROM w)
UNION ALL SELECT x, 'User added', (SELECT count(*) FROM u WHERE id % {TRASH_EVERY} = 0) FROM (VALUES ('F'), ('fresh')) AS t(x)""")
_star("m11_trash", lambda s: edits.trash(s.taggables(), s.taggables().where("Taggable_ID % 5 = 0")).where("In_Trash").select("Taggable_ID"), f'SELECT o_orderkey AS "Taggable_ID" FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % {TRASH_EVERY} = 0')
_star("m14_notes", lambda s: _pairs(edits.add_notes(s.taggables().select("Taggable_ID", F.lit("old").alias("Note")).limit(0), s.taggables().where("Taggable_ID % 7 = 0").select("Taggable_ID", F.lit("new").alias("Note")), s.pairings("status"), 8)[1]), _with("status") + f"SELECT {_AS} FROM (SELECT tag, id FROM p UNION SELECT 8, id FROM u WHERE id % 7 = 0)")
_star("m15_delete_service", lambda s: _pairs(edits.delete_service(s.collection("status", "flag"), 2).pairings), _with("status") + f"SELECT {_AS} FROM p")
_star("a12_key_audit", lambda s: edits.key_audit({"lineitem": (s.table("lineitem"), ["l_orderkey", "l_partkey"]), "orders": (s.table("orders"), ["o_orderkey"])}), "SELECT 'lineitem' AS \"table\", CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR) AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1")

_EXACT = "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id"
_star("g_exact_pairs", lambda s: duplicates.exact_pairs(s.files()), f'SELECT a AS "File_ID_1", b AS "File_ID_2", -1 AS distance FROM ({_EXACT})')
_star("g1_exact_classes", lambda s: duplicates.equal_classes(s.files()), 'SELECT doc_id AS "File_ID", least_id AS class_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1')
_HASHES = ["Hash_0", "Hash_1"]
CUTOFF = 20


def _bits(h: int) -> str:
    return " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN CAST({1 << (i % 32)} AS BIGINT) ELSE 0 END" for i in range(32 * h, 32 * h + 32))


_E = f"SELECT vec_id AS id, {_bits(0)} AS h0, {_bits(1)} AS h1 FROM embeddings"
_D = "bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1))"
_HAMMING = f"SELECT a.id AS a, b.id AS b, CAST({_D} AS INTEGER) AS d FROM e a JOIN e b ON a.id < b.id WHERE {_D} <= {CUTOFF}"
_PAIR = 'a AS "File_ID_1", b AS "File_ID_2", d AS distance'


def _hamming(s: Star) -> DataFrame:
    e = s.perceptual()
    return duplicates.hamming_pairs(e.limit(0), e, _HASHES, CUTOFF)


_star("g3_hamming_pairs", _hamming, f"WITH e AS ({_E}) SELECT {_PAIR} FROM ({_HAMMING})")
_COPIES = "SELECT id + 1000000 AS id, xor(h0, CAST(power(2, id % 32) AS BIGINT)) AS h0, xor(h1, CAST(power(2, id % 31) AS BIGINT)) AS h1 FROM e"


def _close(s: Star) -> DataFrame:
    """The embeddings' hashes and copies of them with a bit changed in each half."""
    e = s.perceptual()
    flipped = [F.col(h).bitwiseXOR(F.pow(F.lit(2), F.col("File_ID") % m).cast("long")).alias(h) for h, m in zip(_HASHES, (32, 31), strict=True)]
    return duplicates.hamming_pairs(e, e.select((F.col("File_ID") + 1_000_000).alias("File_ID"), *flipped), _HASHES, 7)


_star("g3_close_hamming_pairs", _close, f"WITH e AS ({_E}), n AS ({_COPIES}), x AS (SELECT * FROM e UNION ALL SELECT * FROM n) SELECT {_PAIR} FROM (SELECT a.id AS a, b.id AS b, CAST({_D} AS INTEGER) AS d FROM x a JOIN n b ON a.id < b.id WHERE {_D} <= 7)")
_star("g5_incremental_pairs", lambda s: duplicates.hamming_pairs((e := s.perceptual()).where("File_ID % 5 <> 0"), e.where("File_ID % 5 = 0"), _HASHES, CUTOFF), f"WITH e AS ({_E}) SELECT {_PAIR} FROM ({_HAMMING}) WHERE a % 5 = 0 OR b % 5 = 0")


def _groups(s: Star) -> DataFrame:
    return s.table("embeddings").select(F.col("vec_id").alias("File_ID"), F.col("label").cast("long").alias("group_id"))


def _falses(s: Star) -> DataFrame:
    """Each embedding or document and the one before it."""
    ids = s.table("embeddings").select(F.col("vec_id").alias("id")).unionByName(s.table("documents").select(F.col("doc_id").alias("id"))).distinct()
    return ids.select(F.col("id").alias("File_ID_2"), (F.col("id") - 1).alias("File_ID_1"))


_CHECKED = "(SELECT label FROM embeddings WHERE vec_id = a) = (SELECT label FROM embeddings WHERE vec_id = b) OR b = a + 1"
_star("g7_select_comparisons", lambda s: duplicates.select_comparisons(_hamming(s), _groups(s).where("File_ID % 3 <> 0"), 20, _groups(s), _falses(s)), f"WITH e AS ({_E}) SELECT {_PAIR}, ({_CHECKED}) AS checked FROM ({_HAMMING}) WHERE a % 3 <> 0 AND b % 3 <> 0 AND d < 20")
_BOTH = f"SELECT a, b, -1 AS d FROM ({_EXACT}) UNION ALL SELECT x.* FROM ({_HAMMING}) x ANTI JOIN ({_EXACT}) USING (a, b)"


def _compared(s: Star) -> DataFrame:
    """Exact pairs of the documents and near pairs of the embeddings, as if of one set of files."""
    return duplicates.compare(duplicates.exact_pairs(s.files()), _hamming(s))


_star("g6_compare", _compared, f"WITH e AS ({_E}) SELECT {_PAIR} FROM ({_BOTH})")
_star("a11_dup_counters", lambda s: duplicates.counters(duplicates.checked(_compared(s), _groups(s), _falses(s))), f"WITH e AS ({_E}), c AS (SELECT d, coalesce({_CHECKED}, false) AS c FROM ({_BOTH})) SELECT count(*) FILTER (WHERE d = -1) AS exact_pairs, count(*) FILTER (WHERE d >= 0) AS potential_pairs, count(*) FILTER (WHERE d = -1 AND c) AS exact_checked, count(*) FILTER (WHERE d >= 0 AND c) AS potential_checked FROM c")
_star("t2_nearest", lambda s: duplicates.by_distance(_hamming(s)).limit(10), f"WITH e AS ({_E}) SELECT {_PAIR} FROM ({_HAMMING}) ORDER BY d, a, b LIMIT 10")


def _hamming_classes(s: Star) -> DataFrame:
    """Near classes of equal hashes: what hamming_pairs spells out."""
    e = s.perceptual()
    return duplicates.hamming_classes(e.limit(0), e, _HASHES, CUTOFF)[1]


_star("g3_hamming_classes", _hamming_classes, f"WITH e AS (SELECT min(id) AS id, h0, h1 FROM ({_E}) GROUP BY h0, h1) SELECT a AS c1, b AS c2, d AS distance FROM ({_HAMMING})")
_star("g9_components", lambda s: duplicates.closure(_hamming(s)), f"""WITH RECURSIVE e AS ({_E}), x AS ({_HAMMING}), y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
r(id, g) AS (SELECT a, a FROM y UNION SELECT a, b FROM y UNION SELECT r.id, y.b FROM r JOIN y ON r.g = y.a)
SELECT id AS "File_ID", min(g) AS group_id FROM r GROUP BY id""")
_star("g10_implied", lambda s: duplicates.implied(_hamming(s), _groups(s)), f"WITH e AS ({_E}) SELECT {_PAIR} FROM ({_HAMMING}) WHERE (SELECT label FROM embeddings WHERE vec_id = a) = (SELECT label FROM embeddings WHERE vec_id = b)")


def _stored(s: Star) -> DataFrame:
    """The vectors of even labels as stored groups, one for each label."""
    return s.table("embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("File_ID"), (F.col("label") + 1_000_000).cast("long").alias("group_id"))


# Components of pairs and stored groups; each takes the group with most stored members, of equals the largest, or its least file's id, negated.
_star("g11_merge_groups", lambda s: duplicates.merge_groups(_stored(s), _hamming(s)), f"""WITH RECURSIVE e AS ({_E}), x AS ({_HAMMING}),
st AS (SELECT vec_id AS id, label + 1000000 AS g FROM embeddings WHERE label % 2 = 0),
k AS (SELECT a, b FROM x UNION SELECT min(id) OVER (PARTITION BY g), id FROM st),
y AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r(id, c) AS (SELECT a, a FROM y UNION SELECT r.id, y.b FROM r JOIN y ON r.c = y.a),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT g, count(*) AS n FROM st GROUP BY g),
t AS (SELECT DISTINCT c.c, n.g, n.n FROM c JOIN st ON st.id = c.id JOIN n ON n.g = st.g),
m AS (SELECT c, arg_max(g, n * 10000000 + g) AS g FROM t GROUP BY c)
SELECT c.id AS "File_ID", CAST(coalesce(m.g, -c.c) AS BIGINT) AS group_id FROM c LEFT JOIN m ON m.c = c.c""")
_star("p15_trash_larger", lambda s: duplicates.trash_larger(s.files().where("File_ID % 2 = 0").select(F.col("File_ID").alias("File_ID_1"), (F.col("File_ID") + 1).alias("File_ID_2")), s.files()), """SELECT CASE WHEN octet_length(encode(x.text)) > octet_length(encode(y.text)) THEN x.doc_id ELSE y.doc_id END AS "File_ID"
FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0""")


def _verdicts(s: Star) -> DataFrame:
    kinds = ["duplicates-with-better", "duplicates-with-better-trash-worse", "duplicates-with-same-quality", "duplicates-with-same-quality-trash-larger", "alternates", "false-positives", "implied"]
    return s.files().select(F.get(F.array(*map(F.lit, kinds)), (F.col("File_ID") % 7).cast("int")).alias("type"), (F.col("File_ID") + 1).alias("File_ID_1"), F.col("File_ID").alias("File_ID_2"))


def _m16(s: Star) -> DataFrame:
    out = duplicates.commit_relations(_verdicts(s), s.files())
    rows = out["better"].select(F.lit("better").alias("what"), F.col("Better_File_ID").alias("x"), F.col("Worse_File_ID").alias("y"), F.lit(1).alias("relation"))
    for k in ("transitive", "nontransitive"):
        rows = rows.unionByName(out[k].select(F.lit(k).alias("what"), F.col("File_ID_1").alias("x"), F.col("File_ID_2").alias("y"), "relation"))
    return rows.unionByName(out["trash"].select(F.lit("trash").alias("what"), F.col("File_ID").alias("x"), F.col("File_ID").alias("y"), F.lit(0).alias("relation")))


_star("m16_commit_relations", _m16, """WITH v AS (SELECT doc_id % 7 AS k, doc_id AS d, octet_length(encode(text)) AS size FROM documents),
t AS (SELECT d FROM v WHERE k = 1 UNION SELECT CASE WHEN n.size > v.size THEN n.d ELSE v.d END FROM v JOIN v n ON n.d = v.d + 1 WHERE v.k = 3)
SELECT 'better' AS what, d + 1 AS x, d AS y, 1 AS relation FROM v WHERE k < 2
UNION ALL SELECT 'transitive', d, d + 1, CASE WHEN k < 4 THEN 1 ELSE 2 END FROM v WHERE k < 5
UNION ALL SELECT 'nontransitive', d, d + 1, CASE WHEN k = 4 THEN 2 ELSE 3 END FROM v WHERE k IN (4, 5)
UNION ALL SELECT 'trash', d, d, 0 FROM t""")


def _u3(s: Star) -> DataFrame:
    services = s.table("nation").select(F.col("n_nationkey").alias("Service_ID"))
    granted = s.table("customer").select(F.col("c_nationkey").alias("Service_ID"), (F.col("c_custkey") % 40).alias("User_ID"), F.when(F.col("c_acctbal") > 4000, access.READ_TAGS).otherwise(access.APPLY_TAGS).alias("Permission"))
    return access.visible_services(services, granted, access.User(7), [access.READ_TAGS, access.APPLY_TAGS])


_star("u3_visible_services", _u3, 'SELECT c_nationkey AS "Service_ID" FROM customer WHERE c_custkey % 40 = 7 GROUP BY c_nationkey HAVING count(DISTINCT c_acctbal > 4000) = 2')


def _orders_as_files(s: Star) -> DataFrame:
    return s.table("orders").select(F.col("o_custkey").alias("File_ID"), F.col("o_orderkey").alias("Taggable_ID"))


_star("a6_file_taggables", lambda s: access.file_taggables(_orders_as_files(s)).select("File_ID", F.array_join("taggable_ids", ",").alias("taggable_ids")), "SELECT o_custkey AS \"File_ID\", string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS taggable_ids FROM orders GROUP BY o_custkey")
_star("u2_forbidden_files", lambda s: access.forbidden_files(_orders_as_files(s), s.table("customer").select(F.col("c_custkey").alias("File_ID")), s.taggables().where("Service_ID = 1").select("Taggable_ID")), 'SELECT c_custkey AS "File_ID" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)')

_LINKS = programs.attribute_program("a", "href", depth=0)
_star("x8_href_links", lambda s: s.table("pages").select("page_id", programs.extract(_LINKS, F.col("html")).alias("r")).select("page_id", F.size("r.additionalUrls").cast("long").alias("n_links"), F.array_join(F.col("r.additionalUrls.url"), " ").alias("links")), """SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""")
_star("x24_default_html", lambda s: s.table("pages").select("page_id", programs.extract(programs.default_html(), F.col("html")).alias("r")).select("page_id", F.size("r.importFileNames").cast("long").alias("n_files")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<img[^>]* src=', 0)) AS BIGINT) AS n_files FROM pages")
_K = {"type": programs.JSON, "then": [{"type": programs.WITH_PROPERTY, "propertyName": "k", "then": [{"type": programs.EACH, "then": [{"type": programs.TO_ARRAY, "then": [programs.emit()]}]}]}]}
_star("x10_json_property", lambda s: s.table("events").select("event_id", F.element_at(programs.extract(_K, F.col("props")).importFileNames, 1).alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_star("x9_json_variant", lambda s: s.table("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _words():
    return F.split(F.col("text"), " ")


_S1 = [{"type": programs.FILTER, "conditions": [{"type": programs.STARTS, "prefixes": ["TH", "er"], "caseSensitive": False}, {"type": programs.ENDS, "suffixes": ["e", "n"]}]}]
_star("x15_filter", lambda s: s.table("documents").select("doc_id", F.size(programs.array_steps(_S1, _words())).cast("long").alias("n")), "SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda x: (starts_with(lower(x), 'th') OR starts_with(lower(x), 'er')) AND (ends_with(x, 'e') OR ends_with(x, 'n')))) AS BIGINT) AS n FROM documents")
_star("x17_distinct", lambda s: s.table("documents").select("doc_id", F.size(programs.array_steps([{"type": programs.MAP, "mapFn": {"type": programs.LOWER}}, {"type": programs.DISTINCT}], _words())).cast("long").alias("n")), "SELECT doc_id, CAST(len(list_distinct(string_split(lower(text), ' '))) AS BIGINT) AS n FROM documents")
_star("x19_prefix_suffix", lambda s: s.table("part").where(names.has_prefix(F.col("p_name"), ["RED", "blue"], case=False) & names.has_suffix(F.col("p_name"), ["ring", "et"])).select("p_partkey"), "SELECT p_partkey FROM part WHERE (p_name LIKE 'red%' OR p_name LIKE 'blue%') AND (p_name LIKE '%ring' OR p_name LIKE '%et')")
_star("x26_url_classifier", lambda s: s.table("pages").select("page_id", programs.best_parser(F.col("url"), [(r"^https://", 1, "secure"), (r"^https?://m\.", 5, "mobile"), (r"\.org/", 3, "org")]).alias("parser")), r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile' WHEN regexp_matches(url, '\.org/') THEN 'org' WHEN regexp_matches(url, '^https://') THEN 'secure' END AS parser FROM pages")
_star("f1_extension", lambda s: s.table("part").select("p_partkey", names.of_extension(F.concat(F.lit("."), F.get(F.split(F.lit("JPEG,tiff,Png,jpg,TIF"), ","), (F.col("p_partkey") % 5).cast("int")))).alias("name")), "SELECT p_partkey, 'system:has file extension:' || list_extract(['.jpg', '.tif', '.png', '.jpg', '.tif'], CAST(p_partkey % 5 + 1 AS INTEGER)) AS name FROM part")
_star("f2_names", lambda s: s.applied_metrics().where("Local_Metric_ID = 2").select("Taggable_ID", names.of_applied(F.col("Applied_Value"), F.col("Local_Metric_ID"), F.col("User_ID")).alias("name")), f"WITH m AS ({_APPLIED}) SELECT id AS \"Taggable_ID\", 'system:applied metric:' || CAST(CAST(v AS BIGINT) AS VARCHAR) || ' on 2 with user 0' AS name FROM m WHERE metric = 2")
_star("f4_hash_path", lambda s: s.files().select("File_ID", names.storage_path(F.col("File_Hash"), F.concat("File_Hash", F.lit(".txt"))).alias("path")), "SELECT doc_id AS \"File_ID\", substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) || '.txt' AS path FROM documents")
_star("f9_metric_validity", lambda s: s.applied_metrics().select("Local_Metric_ID", names.valid_metric(F.lit(0.0), F.lit(45.0), F.lit(2), F.col("Applied_Value")).alias("ok")).groupBy("Local_Metric_ID", "ok").agg(F.count("*").alias("n")), f'WITH m AS ({_APPLIED}) SELECT metric AS "Local_Metric_ID", v >= 0 AND v <= 45 AS ok, count(*) AS n FROM m GROUP BY 1, 2')
_star("j1_service_join", lambda s: with_metrics(s.applied_metrics(), s.metrics(), "Local_Metric_Service_ID", "Local_Metric_Name").groupBy("Local_Metric_Service_ID", "Local_Metric_Name").agg(F.count("*").alias("n")), f"""WITH m AS ({_APPLIED}) SELECT metric AS "Local_Metric_Service_ID", CASE metric WHEN 1 THEN 'total price' ELSE 'largest quantity' END AS "Local_Metric_Name", count(*) AS n FROM m GROUP BY 1, 2""")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["o7_nested"](spark, sf_dir)


from . import operator_queries  # noqa: E402, F401  the rest of the queries

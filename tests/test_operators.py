"""Counts, edits, duplicates, programs, archives, access and the stream."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import names, programs
from gleaner import queries
from gleaner.operators import access, counts, duplicates, edits, hamming
from gleaner.sources import archives
from gleaner.streaming import compare
from tests.test_search import PAIRS, TAGS, collection


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counts(spark):
    c = collection(spark, PAIRS, tags=TAGS, spaces=[(1, 1), (2, 1), (2, 2), (4, 2)])
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 77)], "group_id string, Tag_ID long")
    assert rows(counts.group_counts(groups, c.pairings)) == [("a", 4), ("b", 1), ("c", 0)]
    some = spark.createDataFrame([(2,), (3,)], "Taggable_ID long")
    assert rows(counts.group_counts(groups, c.pairings, some)) == [("a", 2), ("b", 0), ("c", 0)]
    shown = {r.Display_Name: r["count"] for r in counts.service_counts(c, [1], some).collect()}
    assert shown == {"series:solo": 1, "multi-namespaced:long hair": 2, "meta:highres": 2, "other": 1}
    assert {r.Display_Name for r in counts.filter_box(counts.tag_groups(c, [1]), "meta:long").collect()} == {"multi-namespaced:long hair"}
    assert {r.Display_Name for r in counts.filter_box(counts.tag_groups(c, [1]), "ser").collect()} == {"series:solo", "multi-namespaced:long hair"}
    assert dict(rows(counts.tags_of(spark.createDataFrame([(2,), (11,)], "Taggable_ID long"), c.pairings))) == {2: [1, 2, 4], 11: []}


def test_edits(spark):
    c = collection(spark, PAIRS, tags=TAGS)
    pairs = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (9, 9), (9, 9), (9, 9)], "Tag_ID long, Taggable_ID long")
    old = set(PAIRS)
    assert set(rows(edits.insert_pairs(c.pairings, pairs))) == old | {(1, 5), (9, 9)}
    assert set(rows(edits.delete_pairs(c.pairings, pairs))) == old - {(1, 0)}
    assert set(rows(edits.toggle_pairs(c.pairings, pairs))) == (old - {(1, 0)}) | {(9, 9)}
    with pytest.raises(edits.MissingParent):
        edits.check_parents(c, pairs)
    edits.check_parents(c, c.pairings)
    gone = edits.delete_ids(c, taggables=spark.createDataFrame([(1,)], "Taggable_ID long"))
    assert rows(counts.group_counts(spark.createDataFrame([(1, 1)], "group_id int, Tag_ID long"), gone.pairings)) == [(1, 2)]
    new = spark.createDataFrame([(None, "solo", 1), (None, "x", 1), (None, "x", 2), (None, "y", 3)], "id long, name string, at int")
    known = spark.createDataFrame([(10, "solo"), (12, "z")], "id long, name string")
    out = dict((n, i) for i, n in rows(edits.upsert(known, new, ["name"], "id", "at")))
    assert out["solo"] == 10 and out["z"] == 12 and {out["x"], out["y"]} == {13, 14}
    values = spark.createDataFrame([(2, 7, 0, 9.0), (2, None, 4, 1.0)], "Local_Metric_ID int, User_ID long, Taggable_ID long, Applied_Value double")
    before = spark.createDataFrame([(2, 7, 0, 4.0), (2, 8, 0, 5.0), (2, None, 4, 4.0)], values.schema)
    assert rows(edits.apply_metric(before, values)) == sorted([(2, 7, 0, 9.0), (2, 8, 0, 5.0), (2, None, 4, 1.0)], key=repr)
    e = edits.edit_tags(c, spark.createDataFrame([(2,), (9,)], "Taggable_ID long"), ["new"], ["solo"], 1)
    by_name = rows(e.pairings.join(e.tags, "Tag_ID").select("Lookup_Name", "Taggable_ID").where("Taggable_ID in (2, 9)"))
    assert by_name == [("highres", 2), ("long hair", 2), ("new", 2), ("new", 9), ("solo", 9)]


def test_commit(spark, tmp_path):
    folder = str(tmp_path)
    edits.commit({"a": spark.range(3)}, folder)
    edits.commit({"a": edits.current(spark, folder, "a").where("id > 0")}, folder)
    assert rows(edits.current(spark, folder, "a")) == [(1,), (2,)]
    assert access.make_tables(spark, folder + "/t", {"x": "a int"}) == ["x"] and access.make_tables(spark, folder + "/t", {"x": "a int"}) == []


def test_relations(spark):
    pair = "File_ID_1 long, File_ID_2 long"
    three = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (2, 3, 5)], pair + ", distance int")
    none = spark.createDataFrame([], pair)

    def pending(kind, *verdicts):
        made = duplicates.commit_relations(spark.createDataFrame([(kind, a, b) for a, b in verdicts], "type string, " + pair), spark.createDataFrame([(i, i) for i in (1, 2, 3)], "File_ID long, File_Size long"))
        groups = duplicates.closure(made["transitive"].where(F.col("relation") == duplicates.DUPLICATES))
        return duplicates.checked(three, groups, made["nontransitive"]).where("not checked").count()

    assert pending("duplicates-with-same-quality", (1, 2), (2, 3)) == 0  # transitive
    assert pending("alternates", (1, 2), (2, 3)) == 1  # not transitive
    assert pending("false-positives", (2, 1)) == 2 and pending("implied", (1, 2)) == 3
    assert rows(duplicates.select_comparisons(three, spark.createDataFrame([(1,), (2,)], "File_ID long"), 5, none.select(F.col("File_ID_1").alias("File_ID"), F.col("File_ID_2").alias("group_id")), none)) == []
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "File_ID long, File_Size long")
    assert rows(duplicates.trash_larger(spark.createDataFrame([(1, 2), (3, 1)], pair), sizes)) == [(2,), (3,)]


def test_groups(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9], "File_ID_1 long, File_ID_2 long")
    assert {(r.File_ID, r.group_id) for r in duplicates.closure(pairs).collect()} == {(i, i - i % 10) for i in range(40)} | {(40, 40)} - {(40, 40)}
    stored = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 200), (5, 200)], "File_ID long, group_id long")
    new = spark.createDataFrame([(3, 4), (8, 9)], "File_ID_1 long, File_ID_2 long")
    assert rows(duplicates.merge_groups(stored, new)) == sorted([(i, 100) for i in range(1, 6)] + [(8, -8), (9, -8)], key=repr)


def near(hashes, cutoff, old=0):
    d = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x[1:], y[1:], strict=True))
    return sorted((*sorted((x[0], y[0])), d(x, y)) for i, x in enumerate(hashes) for y in hashes[:i] if d(x, y) <= cutoff and (x[0] >= old or y[0] >= old))


def test_hamming_by_pieces(spark):
    """All numbers of pieces, with values of pieces that many share, against all pairs."""
    import random

    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {r.getrandbits(64) for _ in range(60)} | {b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(12))) for b in base for _ in range(6)}
    values |= {(v & 0xFFFFFFFF) | (7 << 40) for v in list(values)[:40]}  # one value in the upper half
    values = sorted(v & ((1 << 64) - 1) for v in values)
    rows = [(i, v >> 32, v & 0xFFFFFFFF) for i, v in enumerate(values)]
    classes = spark.createDataFrame([(*x, x[0] % 3 > 0) for x in rows], "class_id long, Hash_0 long, Hash_1 long, is_new boolean").cache()
    for cutoff, pieces, hot in ((0, 1, 3), (3, 2, 3), (6, 5, 2), (9, 4, 3), (9, 4, 1000), (4, 5, 1)):
        want = [x for x in near(rows, cutoff) if x[0] % 3 or x[1] % 3]
        got = hamming.by_pieces(classes, ["Hash_0", "Hash_1"], cutoff, pieces, hot)
        assert rows_of(got) == want, (cutoff, pieces, hot)
        assert rows_of(hamming.by_blocks(classes, ["Hash_0", "Hash_1"], cutoff, 16)) == want


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_pieces_cost_less_than_pairs():
    """At 100,000 even hashes and 9 of 64 bits far below 1 % of all pairs; what a hash costs hardly grows with the hashes."""
    m, per_hash = hamming.pieces_for(100_000, 64, 9)
    assert per_hash < 0.02 * 50_000
    assert hamming.pieces_for(1_000_000, 64, 9)[1] < 4 * per_hash < 0.001 * 500_000 * 4 * 4
    widths = [w for _, w in hamming.cuts(64, m)]
    assert sum(widths) == 64 and hamming.radii(4, 9) == [2, 2, 1, 1] and hamming.radii(5, 3) == [0, 0, 0, 0, -1]


def test_hamming_without_hashes(spark):
    df = spark.createDataFrame([(1, 5, 7), (2, None, 7), (3, 5, None), (4, 5, 6), (5, None, None), (6, 5, 7)], "File_ID long, Hash_0 long, Hash_1 long")
    for cutoff in (1, 9, 20):
        assert rows_of(duplicates.hamming_pairs(df.limit(0), df, ["Hash_0", "Hash_1"], cutoff)) == [(1, 4, 1), (1, 6, 0), (4, 6, 1)]
        assert rows_of(duplicates.hamming_pairs(df.where("File_ID < 4"), df.where("File_ID >= 4"), ["Hash_0", "Hash_1"], cutoff)) == [(1, 4, 1), (1, 6, 0), (4, 6, 1)]
    assert duplicates.hamming_pairs(df.limit(0), df.where("Hash_0 is null"), ["Hash_0", "Hash_1"], 20).collect() == []


def test_hamming_pairs(spark):
    import random

    r = random.Random(2)
    hashes = [(i, r.getrandbits(32), r.getrandbits(32)) for i in range(60)]
    hashes += [(100 + i, a ^ (1 << r.randrange(32)), b ^ (1 << r.randrange(32))) for i, a, b in hashes[:30]]
    df = spark.createDataFrame(hashes, "File_ID long, Hash_0 long, Hash_1 long")
    distance = lambda x, y: (x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count()
    for cutoff in (2, 7, 24):
        for old in (0, 40):
            want = sorted((*sorted((x[0], y[0])), distance(x, y)) for i, x in enumerate(hashes) for y in hashes[:i] if distance(x, y) <= cutoff and (x[0] >= old or y[0] >= old))
            got = duplicates.hamming_pairs(df.where(F.col("File_ID") < old), df.where(F.col("File_ID") >= old), ["Hash_0", "Hash_1"], cutoff, block=20)
            assert sorted(map(tuple, got.collect())) == want


PAGE = '<div><a href="/one"><span><img src="a.png"></span></a><img alt="x"><p><a href="/far"><i><b><u><img src="b.jpg"></u></b></i></a><br></div><a href="/none">'


def test_image_hashes(spark):
    import random

    r = random.Random(1)
    grey = [float(r.randrange(256)) for _ in range(64)]
    (row,) = spark.createDataFrame([(grey,)], "p array<double>").select(duplicates.average_hash(F.col("p")).alias("h")).collect()
    bits = [g > sum(grey) / 64 for g in grey]
    assert tuple(row.h) == tuple(sum(b << i for i, b in enumerate(bits[32 * k : 32 * k + 32])) for k in (0, 1))
    pairs = spark.createDataFrame([([[0.0, 0.0], [9.0, 9.0]], [[0.0, 1.0], [0.0, 2.0], [50.0, 50.0]]), ([[0.0, 0.0]], [[0.0, 9.0], [9.0, 0.0]]), (None, [[0.0]]), ([[1.0]], [[1.0]])], "a array<array<double>>, b array<array<double>>")
    got = [r.d for r in pairs.select(duplicates.descriptor_distance("a", "b").alias("d")).collect()]
    assert got[0] == 0.5 and got[1] == 1.0 and got[2] is None and got[3] is None


def test_programs(spark):
    assert programs.run(programs.default_html(), PAGE) == (["a.png", "b.jpg"], [("/one", 0)])
    text = '{"a": ["HTTPS://X.org/Y.JPG", "http://z.org/q.txt"], "b": {"c": "https://x.org/y.jpg", "d": null}}'
    assert programs.run(programs.default_json(), text) == (["https://x.org/y.jpg"], [])
    assert programs.run(programs.default_json(), "{no json") == ([], []) == programs.run(programs.default_html(), None)
    P = programs
    steps = {"type": P.JSON, "then": [{"type": P.NTH, "n": 1, "then": [{"type": P.EACH, "then": [{"type": P.TO_ARRAY, "then": [P.emit(depth=2)]}]}]}]}
    assert programs.run(steps, '{"x": 1, "y": {"k": 5, "l": "m"}}')[1] == [("k", 2), ("5", 2), ("l", 2), ("m", 2)]
    choose = {"type": P.IF, "ifCheck": {"type": P.STARTS, "prefixes": ["A"], "caseSensitive": False}, "trueCase": {"type": P.LOWER}, "elseCase": {"type": P.SAME}, "then": [{"type": P.EMIT_FILE}]}
    assert [programs.run(choose, t)[0] for t in ("ABC", "XYZ")] == [["abc"], ["XYZ"]]
    traits = {"type": P.GROUP, "groupType": " or ", "expressions": [{"type": P.VALUE, "attributeName": "href", "operator": "contains", "value": "far"}, {"type": P.NOT, "expression": {"type": P.ELEMENT, "operator": "!=", "value": "img"}}]}
    pick = {"type": P.HTML, "then": [{"type": P.ROOT, "then": [{"type": P.DESCENDANTS, "then": [{"type": P.TRAITS, "traits": traits, "then": [{"type": P.GET_ATTRIBUTE, "attributeName": "src", "then": [P.emit()]}, {"type": P.GET_ATTRIBUTE, "attributeName": "href", "then": [P.emit()]}]}]}]}]}
    assert programs.run(pick, PAGE)[0] == ["a.png", "b.jpg", "/far"]
    (row,) = spark.createDataFrame([(PAGE,)], "h string").select(programs.extract(programs.default_html(), F.col("h")).alias("r")).collect()
    assert row.r.importFileNames == ["a.png", "b.jpg"] and row.r.additionalUrls[0].url == "/one"


def test_names(spark):
    df = spark.createDataFrame([(".JPEG", 4.0, 2, None, "http://u", "from with x"), (".TIFF", 4.5, 2, 7, "u", "")], "e string, v double, m int, u long, url string, a string")
    got = df.select(
        names.of_extension(F.col("e")).alias("e"), names.of_applied(F.col("v"), F.col("m"), F.col("u")).alias("n"), names.of_url_association(F.col("url"), F.col("a")).alias("a"),
        F.struct(*names.applied(names.of_applied(F.col("v"), F.col("m"), F.col("u")))).alias("back"), F.struct(*names.url_association(names.of_url_association(F.col("url"), F.col("a")))).alias("ua"),
        names.service(names.of_service(F.lit(12))).alias("s"),
    ).collect()
    assert [r.e for r in got] == ["system:has file extension:.jpg", "system:has file extension:.tif"]
    assert [r.n for r in got] == ["system:applied metric:4 on 2 with user SYS", "system:applied metric:4.5 on 2 with user 7"]
    assert [tuple(r.back) for r in got] == [(4.0, 2, None), (4.5, 2, 7)] and [tuple(r.ua) for r in got] == [("http://u", "from with x"), ("u", "")] and got[0].s == 12


def test_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.png": "x", "a.png.tags.txt": "series:some: thing\nplain\n:odd", "a.png.notes.txt": " one \ntwo", "a.png.modtime.txt": "123\n", "lost.png.tags.txt": "x", "a.thumb.jpg": "t", "b.gif": "y"}.items():
        (tmp_path / "in" / name).write_text(text)
    got = {r.name: r for r in archives.read_sidecars(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.png", "b.gif"} and got["b.gif"].tags == [] and got["a.png"].notes == ["one", "two"]
    assert [tuple(t) for t in got["a.png"].tags] == [("series", "some: thing"), (None, "plain"), (None, ":odd")]
    assert got["a.png"].Taggable_Last_Modified_Date == 123 and got["a.png"].extension == ".png"
    made = archives.import_tables(archives.read_sidecars(spark, str(tmp_path / "in")), 4)
    assert ("some: thing", ["series"], 4) in rows(made["tags"])
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "b.gif").write_text("again")
    with pytest.raises(archives.DuplicateName):
        archives.read_sidecars(spark, str(tmp_path / "in"))
    items = spark.createDataFrame([(1, "tags", None), (4, None, "ab")], "Type int, Service_Name string, File_Hash string")
    archives.write_backup([items.where("Type = 1"), items.where("Type = 4")], str(tmp_path / "out"))
    schema = "Type int, Service_Name string, File_Hash string"
    assert rows(archives.read_backup(spark, str(tmp_path / "out"), schema)) == rows(items)
    (tmp_path / "array.json").write_text('[{"Type":1,"Service_Name":"tags"},"' + archives.DELIMITER + '",{"Type":4,"File_Hash":"ab"}]')
    assert rows(archives.read_backup(spark, str(tmp_path / "array.json"), schema)) == rows(items)


def test_access(spark):
    services = spark.createDataFrame([(1,), (2,), (3,)], "Service_ID int")
    granted = spark.createDataFrame([(1, 7, "LTS.RT"), (2, 7, "LTS.RT"), (2, 7, "LTS.AT"), (2, 7, "LTS.AT"), (3, 8, "LTS.RT")], "Service_ID int, User_ID long, Permission string")
    see = lambda user, need: [r.Service_ID for r in access.visible_services(services, granted, user, need).orderBy("Service_ID").collect()]
    assert see(access.User(7), [access.READ_TAGS]) == [1, 2]  # a grant on one service doesn't reach the others
    assert see(access.User(7), [access.READ_TAGS, access.APPLY_TAGS]) == [2]
    assert see(access.User(7, frozenset({"LTS.AT"})), [access.READ_TAGS, access.APPLY_TAGS]) == [1, 2]
    assert see(access.User(9, sudo=True), [access.READ_TAGS]) == [1, 2, 3]
    now = [0.0]
    cursors = access.Cursors(timeout=10, now=lambda: now[0])
    name = cursors.add(spark.range(5))
    now[0] = 9
    assert cursors.get(name).count() == 5
    now[0] = 18
    some = cursors.reselect(name, spark.createDataFrame([(2,)], "id long"), "id")
    assert rows(cursors.get(some)) == [(2,)] and not access.outside(spark.createDataFrame([(2,)], "id long"), cursors.get(some), "id")
    now[0] = 40
    with pytest.raises(KeyError):
        cursors.get(name)
    job = access.Job("j", iter(["a", "b", "c"]))
    assert job.run() == 3 and job.last == "c"


def test_stream(spark, tmp_path):
    import random

    r = random.Random(3)
    hashes = [(i, r.getrandbits(32), r.getrandbits(32)) for i in range(20)]
    hashes += [(50 + i, a ^ 3, b) for i, a, b in hashes]
    schema = "File_ID long, Hash_0 long, Hash_1 long"
    df = spark.createDataFrame(hashes, schema)
    folder, state, mark = (str(tmp_path / x) for x in ("in", "state", "mark"))
    df.where("File_ID % 3 = 0").coalesce(1).write.parquet(folder)
    compare.compare_stream(spark, folder, schema, state, mark, ["Hash_0", "Hash_1"], 4, files_each=1)
    df.where("File_ID % 3 <> 0").repartition(2).write.mode("append").parquet(folder)
    compare.compare_stream(spark, folder, schema, state, mark, ["Hash_0", "Hash_1"], 4, files_each=1)
    whole = duplicates.hamming_pairs(df.limit(0), df, ["Hash_0", "Hash_1"], 4)
    assert rows(compare.pairs(spark, state)) == rows(whole) and whole.count() >= 20


def test_upsert_of_null_keys(spark):
    known = spark.createDataFrame([(1, 2, None, 4.0)], "id long, metric int, user long, value double")
    new = spark.createDataFrame([(None, 2, None, 5.0), (None, 2, 7, 6.0)], known.schema)
    once = edits.upsert(known, new, ["metric", "user"], "id", "value")
    assert rows(once) == sorted([(1, 2, None, 4.0), (2, 2, 7, 6.0)], key=repr)
    assert rows(edits.upsert(once, new, ["metric", "user"], "id", "value")) == rows(once)


def test_edits_insert_parents(spark):
    c = collection(spark, PAIRS, tags=TAGS)
    pairs = spark.createDataFrame([(9, 50), (1, 0)], "Tag_ID long, Taggable_ID long")
    for edit, there in ((edits.insert_pairs, True), (edits.toggle_pairs, True), (edits.delete_pairs, False)):
        out = edits.edit_pairs(c, pairs, edit)
        assert (50, None, False) in rows(out.taggables) and 9 in {r.Tag_ID for r in out.tags.collect()}
        assert ((9, 50) in rows(out.pairings)) == there
    assert rows(edits.missing_ids(c.tags, pairs, "Tag_ID")) == [(9,)]
    assert rows(edits.services_of(c.tags.where("Tag_ID in (1, 3)"), c.tags, "Tag_ID", "Local_Tag_Service_ID")) == [(1,), (2,)]


def test_half_a_commit_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    edits.commit({"a": spark.range(3), "b": spark.range(1)}, folder)
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):  # noqa: B017
        edits.commit({"a": spark.range(9), "b": bad}, folder)
    (tmp_path / "complete" / "99999999999999999999-x").mkdir()  # a writer that was lost before its mark
    assert edits.current(spark, folder, "a").count() == 3
    edits.commit({"b": spark.range(5)}, folder)
    assert (edits.current(spark, folder, "a").count(), edits.current(spark, folder, "b").count()) == (3, 5)


def test_permissions_of_a_search(spark):
    from gleaner.plans import query as q
    from gleaner.plans.search import Search

    c = collection(spark, PAIRS, tags=TAGS, spaces=[(1, 1), (3, 1)], services={2: 5}, applied=[(2, 7, 0, 4.0)])
    lost = lambda node, user, *grants: rows(access.lacking(c, node, spark.createDataFrame([*grants, (99, 99, "x")], "Service_ID int, User_ID long, Permission string"), user))
    me = access.User(7)
    assert lost(q.Tag(1), me) == [("tag", 1, "LTS.RT")] and lost(q.Tag(1), me, (1, 7, "LTS.RT")) == []
    assert lost(q.Lookup("solo"), me, (1, 7, "LTS.RT")) == [("tag", 2, "LTS.RT")]  # the name stands in both services
    assert lost(q.Compare(">", 2, 1.0), me, (2, 8, "LMS.RM")) == [("metric", 2, "LMS.RM")]  # another user's grant
    node = q.ListUnion(q.NamespaceList(1), (q.Condition("count", ">", 0, q.InMetricService(1)),))
    assert lost(node, me) == [("metric", 1, "LMS.RM"), ("tag", 1, "LTS.RT"), ("tag", 2, "LTS.RT")]
    assert lost(node, access.User(7, sudo=True)) == lost(node, access.User(7, frozenset({"LTS.RT", "LMS.RM"}))) == []
    granted = spark.createDataFrame([(1, 7, "LTS.RT"), (0, 7, "LTgbS.RT")], "Service_ID int, User_ID long, Permission string")
    assert rows(access.checked_search(Search(c), q.Tag(1), granted, me)) == [(0,), (1,)]  # 2 is in a service that isn't seen
    with pytest.raises(access.Forbidden):
        access.checked_search(Search(c), q.Intersect((q.Tag(1), q.HasMetric(1))), granted, me)


def test_import_chunk(spark):
    c = collection(spark, PAIRS, tags=TAGS, spaces=[(1, 1)])
    schema = "name string, extension string, path string, tags array<struct<namespace:string,name:string>>, notes array<string>, urls array<string>, " + ", ".join(f"{v} long" for v in archives.DATES.values())
    files = [("a.png", ".png", "p", [("series", "x"), (None, "y"), ("new", "x")], ["n"], ["u", "v"], 1, None, 2, None), ("b.gif", ".gif", "p", [], [], [], None, None, None, None)]
    out, more = edits.import_chunk(c, spark.createDataFrame(files, schema), 1, 5)
    made = {r.Taggable_ID for r in out.taggables.where("Service_ID = 5").collect()}
    assert made == {12, 13} and out.taggables.count() == 14
    tags = {r.Lookup_Name: r.Tag_ID for r in out.tags.where("Source_Name = 'import'").collect()}
    assert set(tags) == {"x", "y"} and min(tags.values()) == 6
    spaces = {(r.Tag_ID, r.Namespace_Name) for r in out.tags_namespaces.join(out.namespaces, "Namespace_ID").collect()}
    assert spaces == {(1, "series"), (tags["x"], "series"), (tags["x"], "new")}
    assert {p for p in rows(out.pairings)} - set(PAIRS) == {(t, i) for t in tags.values() for i in made if len(rows(more["notes"])) == 1 and i == more["notes"].first().Taggable_ID}
    assert sorted(r.url for r in more["urls"].collect()) == ["u", "v"] and more["dates"].count() == 2
    again, _ = edits.import_chunk(out, spark.createDataFrame(files, schema), 1, 6)
    assert again.tags.count() == out.tags.count()


def test_sets(spark):
    from gleaner.functions import sets

    df = spark.createDataFrame([([1, 2, 2, 3], [3, 2], {"a": 1, "b": 2}, {"b": 3, "c": 4})], "x array<int>, y array<int>, m map<string,int>, n map<string,int>")
    got = df.select(sets.intersect_all([F.col("x"), F.col("y"), F.col("x")]).alias("i"), sets.merged([F.col("m"), F.col("n")]).alias("m"), sets.toggled(F.col("y"), F.lit(2)).alias("t"), sets.toggled(F.col("y"), F.lit(9)).alias("u"), sets.equal_sets(F.col("x"), F.col("y")).alias("e"), sets.equal_sets(F.col("y"), F.reverse("y")).alias("f")).first()
    assert (got.i, got.m, got.t, got.u, got.e, got.f) == ([2, 3], {"a": 1, "b": 3, "c": 4}, [3], [3, 2, 9], False, True)


def test_groups_of_equal_size(spark):
    stored = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, 200), (5, 300)], "File_ID long, group_id long")
    new = spark.createDataFrame([(2, 3), (5, 4)], "File_ID_1 long, File_ID_2 long")
    assert {g for _, g in rows(duplicates.merge_groups(stored, new))} == {200}  # of equals the largest


def test_staged_batches_are_bounded(spark):
    import pyarrow as pa
    from gleaner.sources import staging

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    long = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("t"))
    got = staging.staged(long.mapInArrow(sizes, "n long, size long"), "test").collect()
    assert sum(r.n for r in got) == 2000 and max(r.size for r in got) <= staging.BATCH_BYTES + 20_000
    huge = spark.range(0, 2, 1, 1).select(F.repeat(F.lit("0123456789"), 600_000).alias("t"))
    assert [r.n for r in staging.staged(huge.mapInArrow(sizes, "n long, size long"), "test").collect()] == [1, 1]  # longer than the bound
    assert spark.conf.get(key, None) == before


def test_links_are_not_broadcast(spark):
    """Links are many more than Spark expects from the size of the hashes."""
    df = spark.range(300).select(F.col("id").alias("File_ID"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("Hash_0"), F.xxhash64("id", F.lit(1)).bitwiseAND(0xFFFFFFFF).alias("Hash_1"))
    plan = duplicates.hamming_pairs(df.limit(0), df, ["Hash_0", "Hash_1"], 20)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 2


def test_blocks_have_tasks_by_comparisons(spark):
    classes = spark.range(300).select(F.col("id").alias("class_id"), F.lit(True).alias("is_new"), F.xxhash64("id").bitwiseAND(0xFFFFFFFF).alias("Hash_0"), F.xxhash64("id", F.lit(1)).bitwiseAND(0xFFFFFFFF).alias("Hash_1"))
    assert hamming.by_blocks(classes, ["Hash_0", "Hash_1"], 20, 16).rdd.getNumPartitions() > 30


def test_counters_of_documents_beyond_the_embeddings(spark, tmp_path):
    """Equal documents whose ids follow each other count as checked, whether or not there are embeddings of those ids."""
    spark.createDataFrame([(1, "x"), (2, "y"), (8, "same"), (9, "same"), (20, "same")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0] * 64, 0), (1, [-1.0] * 64, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in queries.QUERIES["a11_dup_counters"](spark, str(tmp_path)).collect()] == [(3, 0, 1, 0)]


def test_metrics_go_to_their_values(spark):
    """Values are not gathered by metric: all of one would be one task's."""
    applied = spark.range(10_000_000).select((F.col("id") % 2 + 1).cast("int").alias("Local_Metric_ID"), F.lit(0).cast("long").alias("User_ID"), F.col("id").alias("Taggable_ID"), F.lit(2.0).alias("Applied_Value"))
    metrics = spark.createDataFrame([(1, 7), (2, 7)], "Local_Metric_ID int, Local_Metric_Service_ID int")
    assert "BroadcastHashJoin" in edits.metric_facts(applied, metrics)._jdf.queryExecution().sparkPlan().toString()
    assert edits.metric_facts(applied.limit(10), metrics).count() == 30


def test_facts_and_keys_are_dealt_before_they_are_counted(spark):
    """Nearly every row is a group of its own, so none is gathered in the task that reads it."""
    df = spark.range(100).select((F.col("id") % 99).alias("k"), F.lit("x").alias("v"))
    audit = edits.key_audit({"t": (df, ["k"])})
    assert "RepartitionByExpression" in audit._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in audit.collect()] == [("t", "0", 2)]


def test_strips_of_descriptors(spark, monkeypatch):
    """Images of many strips give what they give as one, and a task's output has a row for a descriptor and a strip, not for every block."""
    rows = [(i, k, [float((i * 7 + k * 13) % 11), float((i * 3 + k * k) % 17), float(k % 5)]) for i in (1, 2, 3) for k in range(20 * i)]
    d = spark.createDataFrame(rows, "image long, at long, vector array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "a long, b long")
    of = lambda **how: {(r.a, r.b): round(r.share, 9) for r in duplicates.descriptor_shares(d, pairs, **how).collect()}
    whole = of()
    monkeypatch.setattr(duplicates, "STRIP", 8)
    assert len(whole) == 3 and of(block=2) == whole == of(block=64)


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_files_and_groups_are_not_broadcast(spark):
    """Files of few bytes on disk, as those of sorted ids, may be large in the driver's memory."""
    from gleaner.sources import staging

    h = lambda k: F.xxhash64("id", F.lit(k)).bitwiseAND(0xFFFFFFFF).alias(f"Hash_{k}")
    df = spark.range(300).select(F.col("id").alias("File_ID"), h(0), h(1))
    groups = staging.staged(spark.range(300).select(F.col("id").alias("File_ID"), (F.col("id") % 7).alias("group_id")), "test")
    pairs = duplicates.hamming_pairs(df.limit(0), df, ["Hash_0", "Hash_1"], 20)
    assert _broadcasts(pairs) == 0 and _broadcasts(duplicates.implied(pairs, groups)) == 0
    assert _broadcasts(duplicates.hamming_classes(df.limit(0), df, ["Hash_0", "Hash_1"], 20)[0]) == 0


def test_rounds_of_a_closure_are_not_broadcast(spark, monkeypatch):
    plans, write = [], duplicates.staged
    monkeypatch.setattr(duplicates, "staged", lambda df, label: (plans.append(df), write(df, label))[1])
    pairs = spark.range(50).select(F.col("id").alias("File_ID_1"), (F.col("id") + 1).alias("File_ID_2"))
    assert {r.group_id for r in duplicates.closure(pairs).collect()} == {0}
    assert len(plans) > 3 and not any(map(_broadcasts, plans))

"""Posting lists, buckets and kept counts."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators import counts, stored
from gleaner.plans import bitmaps
from gleaner.plans import query as q
from gleaner.plans.collection import Star
from tests.test_search import PAIRS, collection

PAIR = "Tag_ID long, Taggable_ID long"


def pairs(spark, rows):
    return spark.createDataFrame(list(rows), PAIR)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_words(spark):
    ids = {-130, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, 10**12}
    df = spark.createDataFrame([(i,) for i in [*ids, 0, 63]], "Taggable_ID long")
    w = bitmaps.words_of(df)
    assert {r.Taggable_ID for r in bitmaps.ids_of(w).collect()} == ids and bitmaps.ids_of(w).count() == len(ids)
    assert bitmaps.size_of(w).collect()[0].n == len(ids)
    assert bitmaps.size_of(w.where("false")).collect()[0].n == 0


def random_tree(r, depth):
    kind = r.randrange(7) if depth else 0
    part = lambda: random_tree(r, depth - 1)
    if kind <= 1:
        return r.choice([q.Tag(r.randrange(6)), q.Universe(), q.Empty(), q.Literal((1, 5, 70, 500)), q.Tag(r.randrange(6))])
    if kind == 2:
        return q.Union(tuple(part() for _ in range(r.randint(1, 3))))
    if kind == 3:
        return q.Intersect(tuple(part() for _ in range(r.randint(1, 3))))
    if kind == 4:
        return q.Complement(part())
    return (q.Difference if kind == 5 else q.SymmetricDifference)(part(), part())


def evaluate(node, held, universe):
    e = lambda n: evaluate(n, held, universe)
    if isinstance(node, q.Tag):
        return held.get(node.tag_id, set()) & universe
    if isinstance(node, q.Literal):
        return set(node.taggable_ids) & universe
    if isinstance(node, q.Universe | q.Empty):
        return set(universe) if isinstance(node, q.Universe) else set()
    if isinstance(node, q.Union | q.Intersect):
        sets = list(map(e, node.parts))
        return set.union(*sets) if isinstance(node, q.Union) else set.intersection(*sets)
    if isinstance(node, q.Complement):
        return universe - e(node.part)
    return e(node.left) - e(node.right) if isinstance(node, q.Difference) else e(node.left) ^ e(node.right)


def test_random_trees(spark):
    r = random.Random(7)
    ids = list(range(1, 200))
    held = {t: {i for i in ids if r.random() < 0.3} for t in range(5)}
    c = collection(spark, [(t, i) for t, s in held.items() for i in s], ids=ids, trash=range(0, 200, 9))
    universe = {i for i in ids if i % 9}
    posted = bitmaps.postings(c.pairings).cache()
    for _ in range(12):
        tree = random_tree(r, 3)
        want = sorted((i,) for i in evaluate(tree, held, universe))
        s = bitmaps.BitmapSearch(c, posted=posted)
        assert rows(s.run(tree)) == want, tree
        assert s.count(tree).collect()[0].n == len(want)


def test_dense_postings_are_small(spark, tmp_path):
    """8,000 tags on each of 200 taggables: within what the reference's store may take for them."""
    dense = spark.range(8000).select(F.col("id").alias("Tag_ID"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long"))).alias("Taggable_ID"))
    bitmaps.postings(dense).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet")) <= 295_200
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 8000 * 4 and back.agg(F.sum(F.bit_count("bits"))).collect()[0][0] == 8000 * 200


def test_group_counts(spark):
    c = collection(spark, PAIRS, trash=(3,))
    found = bitmaps.BitmapSearch(c).run(q.Universe())
    groups = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("none", 99)], "group_id string, Tag_ID long")
    df = counts.group_counts(groups, c.pairings, found)
    held = {}
    for t, i in rows(c.pairings.select("Tag_ID", "Taggable_ID")):
        held.setdefault(t, set()).add(i)
    u = {r[0] for r in found.collect()}
    assert rows(df) == [("a", len((held.get(1, set()) | held.get(2, set())) & u)), ("b", len(held.get(2, set()) & u)), ("none", 0)]


def written(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


def test_an_edit_touches_its_buckets_only(spark, tmp_path):
    r = random.Random(3)
    now = {(r.randrange(20), r.randrange(500)) for _ in range(2000)}
    table = stored.Bucketed(spark, f"file://{tmp_path}/pairs", 64).create(pairs(spark, now))
    assert rows(table.read()) == sorted(now)
    for kind in ("insert", "delete", "toggle"):
        before = written(tmp_path / "pairs")
        some = [(r.randrange(20), r.randrange(500)) for _ in range(8)] + r.sample(sorted(now), 2)
        change = table.edit(pairs(spark, [*some, some[0], some[0]]), kind)
        after = now | set(some) if kind == "insert" else now - set(some) if kind == "delete" else now ^ set(some)
        assert rows(table.read()) == sorted(after)
        assert rows(change) == sorted([(*p, 1) for p in after - now] + [(*p, -1) for p in now - after])
        new = written(tmp_path / "pairs")
        touched = {os.path.dirname(f) for f in set(before) ^ set(new)} | {os.path.dirname(f) for f in set(before) & set(new) if before[f] != new[f]}
        assert 0 < len(touched) <= 10
        now = after


def test_a_bucket_can_become_empty(spark, tmp_path):
    table = stored.Bucketed(spark, f"file://{tmp_path}/pairs", 4).create(pairs(spark, [(1, 1), (2, 1), (1, 2)]))
    table.edit(pairs(spark, [(1, 1), (2, 1), (7, 7)]), "delete")
    assert rows(table.read()) == [(1, 2)]
    assert rows(table.edit(pairs(spark, []), "insert")) == [] and rows(table.read()) == [(1, 2)]
    with pytest.raises(Exception):
        table.create(pairs(spark, []))
    table.edit(pairs(spark, [(1, 2), (3, 1)]), "toggle")
    assert rows(table.read()) == [(3, 1)]


def test_kept_counts_equal_full_counts(spark):
    r = random.Random(11)
    groups = spark.createDataFrame([(f"g{t % 4}", t) for t in range(12)] + [("all", t) for t in range(12)], "gid string, Tag_ID long").cache()
    now = {(r.randrange(14), r.randrange(30)) for _ in range(150)}
    held = stored.multiplicities(groups, pairs(spark, now)).cache()
    kept = bitmaps.counts_of(groups, pairs(spark, now)).cache()
    for k in range(4):
        kind = r.choice(["insert", "delete", "toggle"])
        some = [(r.randrange(14), r.randrange(30)) for _ in range(60)]
        change = stored.effect(pairs(spark, now), pairs(spark, some), kind)
        odd = {p for p in some if some.count(p) % 2}
        now = now | set(some) if kind == "insert" else now - set(some) if kind == "delete" else now ^ odd
        held, changes = stored.count_changes(held, groups, change)
        held, kept = held.cache(), stored.add_counts(kept, changes).cache()
        assert rows(kept) == rows(bitmaps.counts_of(groups, pairs(spark, now))), (k, kind)
        assert rows(held) == rows(stored.multiplicities(groups, pairs(spark, now)))


def test_an_edit_aggregates_once(spark, tmp_path, monkeypatch):
    """What an edit changes and what is there after it come from one table; a stored pair with a null is met like others."""
    written, write = [], stored.staged
    monkeypatch.setattr(stored, "staged", lambda df, label: (written.append(label), write(df, label))[1])
    make = lambda rows: spark.createDataFrame(rows, "Tag_ID long, Taggable_ID long")
    table = stored.Bucketed(spark, f"file://{tmp_path}/pairs", 4).create(make([(1, 1), (2, 2), (3, None)]))
    change = table.edit(make([(1, 1), (3, None), (4, 4), (4, 4)]), "insert")
    assert [tuple(r) for r in change.collect()] == [(4, 4, 1)] and written == ["edit", "edited"]
    assert sorted(map(tuple, table.read().collect())) == [(1, 1), (2, 2), (3, None), (4, 4)]
    table.edit(make([(1, 1), (3, None), (9, 9)]), "delete")
    assert sorted(map(tuple, table.read().collect())) == [(2, 2), (3, None), (4, 4)]


def test_counts_make_no_pairs_distinct(spark, sf_dir):
    """Nor does an edit of the pairings leave the rows of before."""
    c = Star(spark, sf_dir).collection("flag", "brand")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [Tag_ID" in plan(c.pairings)
    groups = c.tags.select(F.col("Tag_ID").alias("group_id"), "Tag_ID")
    for df in (counts.service_counts(c, None), counts.group_counts(groups, c.pairing_rows)):
        assert not [line for line in plan(df).splitlines() if re.search(r"Aggregate \[Tag_ID#\d+L, (Taggable_ID|l_orderkey)#", line)]
    assert rows(counts.group_counts(groups, c.pairing_rows)) == rows(counts.group_counts(groups, c.pairings))
    assert c.pairing_rows.count() > c.pairings.count() == c.pairing_rows.distinct().count()
    few = c.pairings.limit(3).cache()
    assert c.with_(pairings=few).pairing_rows is few

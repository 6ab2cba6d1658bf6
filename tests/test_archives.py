"""Archives, exports, groups that grow and descriptors."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from gleaner.operators import duplicates
from gleaner.sources import archives, zips


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


ENTRIES = {
    "a.png": b"\x00" * 5000, "a.png.tags.txt": "series:some: thing\nplain\n :odd ".encode(), "a.png.notes.txt": b"one\ntwo", "a.png.modtime.txt": b"123\n", "sub/b.gif": b"x", "sub/b.gif.urls.txt": "http://é".encode(),
    "a.png.thumb.jpg": b"t", "lost.png.tags.txt": b"nobody", "c": b"no sidecar",
}


def packed(path, entries=ENTRIES):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return str(path)


def test_zip_is_read_as_its_folder(spark, tmp_path):
    path = packed(tmp_path / "one.zip")
    with zipfile.ZipFile(path) as z:
        z.extractall(tmp_path / "folder")
    whole = archives.read_archive(spark, path, task_bytes=10)
    assert rows(whole.drop("path")) == rows(archives.read_sidecars(spark, str(tmp_path / "folder")).drop("path"))
    assert {r.name: r.path for r in whole.collect()} == {"a.png": "a.png", "b.gif": "sub/b.gif", "c": "c"}
    assert len(zips.ZipReader({"paths": path, "taskBytes": "10"}).partitions()) > 3
    data = (tmp_path / "one.zip").read_bytes()
    volumes = []
    for k in range(12):  # more than nine, so that names do not sort as numbers
        cut = len(data) // 12 + 1
        (tmp_path / f"v.zip.{k + 1}").write_bytes(data[k * cut : (k + 1) * cut])
        volumes.append(f"file://{tmp_path}/v.zip.{k + 1}")
    random.Random(1).shuffle(volumes)
    assert rows(archives.read_archive(spark, volumes, task_bytes=10)) == rows(whole)


def test_zip_of_nothing_and_of_twice(spark, tmp_path):
    assert archives.read_archive(spark, packed(tmp_path / "none.zip", {})).collect() == []
    with pytest.raises(archives.DuplicateName):
        archives.read_archive(spark, packed(tmp_path / "two.zip", {"a/x.png": b"", "b/x.png": b""}))


def test_volumes(tmp_path):
    r = random.Random(2)
    data = r.randbytes(1000)
    for k in range(5):
        (tmp_path / str(k)).write_bytes(data[k * 200 : (k + 1) * 200])
    with zips.Volumes([str(tmp_path / str(k)) for k in range(5)]) as v:
        for _ in range(50):
            at, n = r.randrange(1100), r.randrange(500)
            v.seek(at)
            got = b""
            while len(got) < n and (piece := v.read(n - len(got))):
                got += piece
            assert got == data[at : at + n]
        assert v.seek(-10, 2) == 990 and v.read(3) == data[990:993]


def test_export_round_trip(spark, tmp_path):
    items = spark.range(3000).select((F.col("id") % 5).alias("Type"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.concat(F.lit(']["é, '), F.col("id").cast("string"), F.lit(" \n]")).alias("text"))
    items = items.where("id is not null")
    archives.write_export(items, ["Type", "id"], str(tmp_path / "out"))
    schema = "Type long, id long, text string"
    assert rows(archives.read_export(spark, str(tmp_path / "out"), schema)) == rows(items)
    whole = "".join(f.read_text() for d in ("begin", "items", "end") for f in sorted((tmp_path / "out" / d).glob("part-*")))
    import json

    array = json.loads(whole)
    assert len(array) == 2 * items.count() - 1 and set(map(str, array[1::2])) == {archives.DELIMITER}
    assert [(x["Type"], x["id"]) for x in array[::2]] == sorted((r.Type, r.id) for r in items.collect())
    # As one file, by several tasks.
    (tmp_path / "one.json").write_text(whole)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        one = archives.read_export(spark, str(tmp_path / "one.json"), schema)
        assert one.rdd.getNumPartitions() > 1 and rows(one) == rows(items)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    archives.write_export(items.limit(0), ["Type", "id"], str(tmp_path / "none"))
    assert archives.read_export(spark, str(tmp_path / "none"), schema).collect() == []


def test_groups_grow_as_a_full_closure(spark):
    """Merging pairs batch by batch gives the partition that one closure over all pairs gives."""
    r = random.Random(4)
    stored = spark.createDataFrame([], "File_ID long, group_id long")
    every = []
    for _ in range(3):
        new = [(r.randrange(60), r.randrange(60)) for _ in range(14)]
        new = [p for p in new if p[0] != p[1]]
        every += new
        stored = duplicates.merge_groups(stored, spark.createDataFrame(new, "File_ID_1 long, File_ID_2 long")).cache()
        whole = duplicates.closure(spark.createDataFrame(every, "File_ID_1 long, File_ID_2 long"))

        def parts(df):
            out = {}
            for f, g in map(tuple, df.select("File_ID", "group_id").collect()):
                out.setdefault(g, set()).add(f)
            return sorted(map(sorted, out.values()))

        assert parts(stored) == parts(whole)
    assert rows(duplicates.merge_groups(stored, spark.createDataFrame([], "File_ID_1 long, File_ID_2 long"))) == rows(stored)


def test_descriptor_shares(spark):
    r = random.Random(5)
    images = {k: [[r.gauss(0, 1) for _ in range(4)] for _ in range(n)] for k, n in (("a", 30), ("b", 41), ("c", 1), ("d", 2))}
    held = [(k, i, v) for k, vs in images.items() for i, v in enumerate(vs)] + [("a", None, [1.0] * 4), ("b", 99, None)]
    df = spark.createDataFrame(held, "image string, at long, vector array<double>")
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "d"), ("a", "none"), ("a", "b")]
    got = {(x.a, x.b): x.share for x in duplicates.descriptor_shares(df, spark.createDataFrame(pairs, "a string, b string"), block=7).collect()}
    want = {}
    for a, b in set(pairs):
        if len(images.get(b, [])) > 1:
            near = [sorted(math.dist(x, y) for y in images[b])[:2] for x in images[a]]
            want[a, b] = sum(d1 > 0.7 * d2 for d1, d2 in near) / len(near)
    assert got == pytest.approx(want)

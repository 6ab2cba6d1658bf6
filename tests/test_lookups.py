"""Lookups that read few files, and classes of files that keep arriving."""

import random


from gleaner.sources import lookups
from gleaner.streaming import compare

SCHEMA = "Tag_ID long, Lookup_Name string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lookups_read_few_files(spark, tmp_path):
    r = random.Random(1)
    names = ["".join(r.choices("abcdé日🙂", k=r.randint(1, 6))) for _ in range(3000)]
    table = [(i, n) for i, n in enumerate(names)]
    folder = str(tmp_path / "tags")
    lookups.write_sorted(spark.createDataFrame([*table, (-1, None)], SCHEMA), "Lookup_Name", folder, files=40)
    for wanted in ([names[5]], names[:2], ["no such tag"], []):
        got = lookups.lookup(spark, folder, SCHEMA, "Lookup_Name", wanted)
        assert rows(got) == sorted(x for x in table if x[1] in wanted)
        assert len(got.inputFiles()) <= max(2, len(wanted) * 2)
    for prefix in ("abc", "日é", "🙂", "zz", ""):
        got = lookups.beginning(spark, folder, SCHEMA, "Lookup_Name", prefix)
        assert rows(got) == sorted(x for x in table if x[1].startswith(prefix))
    assert len(lookups.beginning(spark, folder, SCHEMA, "Lookup_Name", "abc").inputFiles()) <= 4


def test_after_prefix():
    assert lookups.after_prefix("ab") == "ac" and lookups.after_prefix("a\U0010ffff") == "b"
    assert lookups.after_prefix("\U0010ffff") is None and lookups.after_prefix("") is None and lookups.after_prefix("퟿") == ""


def test_classes_of_arriving_files(spark, tmp_path):
    """Stopped and started again in mid-stream: the same classes as in one batch."""
    r = random.Random(2)
    files = [(i, r.choice(["x", "y", "z", None, f"h{r.randrange(30)}"])) for i in r.sample(range(1000), 120)]
    schema = "File_ID long, File_Hash string"
    where = lambda n: str(tmp_path / n)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k in range(3):
            spark.createDataFrame(files[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").parquet(where("in"))
            if k != 1:  # the second arrives with the third
                assert compare.class_stream(spark, where("in"), schema, where("out"), where("check"), files_each=1) >= 1
        want = {}
        for i, h in files:
            if h is not None:
                want[h] = min(i, want.get(h, i))
        assert dict(rows(compare.classes(spark, where("out")))) == want
        again = rows(compare.classes(spark, where("out")))
        compare.class_stream(spark, where("in"), schema, where("out"), where("check"))
        assert rows(compare.classes(spark, where("out"))) == again
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_arriving_classes_run_no_python_for_a_hash(spark, tmp_path, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    place = lambda n: f"{tmp_path}/{n}"
    schema = "File_ID long, File_Hash string"
    spark.createDataFrame([(3, "x"), (2, "x"), (5, None), (4, "y")], schema).coalesce(1).write.parquet(place("in"))
    compare.class_stream(spark, place("in"), schema, place("out"), place("check"))
    spark.createDataFrame([(1, "x"), (6, "y")], schema).coalesce(1).write.mode("append").parquet(place("in"))
    compare.class_stream(spark, place("in"), schema, place("out"), place("check"))
    assert {tuple(r) for r in compare.classes(spark, place("out")).collect()} == {("x", 1), ("y", 4)}

"""File comparison: exact and perceptual duplicates, relations and their closure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.staging import staged
from .hamming import hamming, near_links  # noqa: F401

STRIP = 8192  # descriptors that meet as many others in one task
EXACT = -1  # distance of exact duplicates
DUPLICATES, ALTERNATES, FALSE_POSITIVES = 1, 2, 3  # relation types


def pixel_hash(data: Column, pages: Column | None = None) -> Column:
    """SHA-256 of the raw pixels; null for files of several pages."""
    h = F.sha2(data, 256)
    return h if pages is None else F.when(pages <= 1, h)


def exact_pairs(files: DataFrame, key: str = "File_Hash") -> DataFrame:
    """(File_ID_1, File_ID_2, distance -1) of files of equal hash, smaller id first.

    Every pair of a group is asked for; equal_classes gives the same without them.
    """
    a, b = files.select(key, F.col("File_ID").alias("File_ID_1")), files.select(key, F.col("File_ID").alias("File_ID_2"))
    return a.join(b, key).where("File_ID_1 < File_ID_2").select("File_ID_1", "File_ID_2", F.lit(EXACT).alias("distance"))


def equal_classes(files: DataFrame, key: str = "File_Hash") -> DataFrame:
    """(File_ID, class_id): the least id of equal hash, for files that share theirs. Grows with the files, not with pairs."""
    least = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("File_ID").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return files.join(least, key).select("File_ID", "class_id")


def average_hash(pixels: Column) -> Column:
    """A 64-bit hash, as two longs of 32 bits, of a thumbnail of 64 grey values: which are above their mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda t, x: t + x) / 64
    half = lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda t, i: t + F.when(F.get(pixels, i + 32 * h) > mean, F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.struct(half(0).alias("Hash_0"), half(1).alias("Hash_1"))


@F.pandas_udf(DoubleType())
def descriptor_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of an image's descriptors (arrays of numbers) whose nearest in the other isn't clearly nearer than the second: over 0.7 of its distance. Null without two to compare with."""
    import numpy as np

    def one(x, y):
        if x is None or y is None or len(x) == 0 or len(y) < 2:
            return None
        x, y = np.stack([np.asarray(r, float) for r in x]), np.stack([np.asarray(r, float) for r in y])
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
        two = np.partition(d, 1, axis=1)[:, :2]
        return float((two[:, 0] > 0.7 * two[:, 1]).mean())

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def descriptor_shares(descriptors: DataFrame, pairs: DataFrame, block: int = 256, ratio: float = 0.7) -> DataFrame:
    """(a, b, share) for pairs (a, b) of images: as descriptor_distance, of images with any number of descriptors.

    descriptors: image, at (tells an image's apart), vector (array of numbers, all of one length). Those of an image are dealt into blocks, blocks
    into strips of STRIP descriptors, and every strip of a meets every strip of b, which gives the two nearest of each of a's
    descriptors; the least two of all strips are its two nearest. So a task holds two strips, whatever an image has, and as many rows are
    shuffled as a has descriptors for each strip of b. The comparisons grow with the product of a's and b's descriptors. Pairs with an image
    that has no descriptor, or of which b has but one, have no row. Nulls are left out.
    """
    whole = descriptors.select("image", "at", F.col("vector").cast("array<double>").alias("vector")).dropna()
    counts = whole.groupBy("image").agg(F.ceil(F.count("*") / block).alias("blocks"))
    packed = whole.join(counts, "image").groupBy("image", F.pmod(F.xxhash64("at"), "blocks").alias("block")).agg(F.collect_list(F.struct("at", "vector")).alias("held"))
    strips = lambda n: counts.select(F.col("image").alias(n), F.ceil(F.col("blocks") * block / STRIP).alias(f"strips_{n}"))
    wanted = pairs.select("a", "b").distinct().join(strips("a"), "a").join(strips("b"), "b")

    def side(n: str, other: str) -> DataFrame:
        mine, every = F.pmod("block", f"strips_{n}").alias(f"strip_{n}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"strips_{other}") - 1)).alias(f"strip_{other}")
        rows = packed.join(wanted.withColumn("image", F.col(n)), "image").select("a", "b", "block", "held", mine, every)
        return rows.select("a", "b", "strip_a", "strip_b", F.lit(n == "b").alias("second"), "held")

    both = side("a", "b").unionByName(side("b", "a"))
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("a", "b")} | {"at": whole.schema["at"].dataType.simpleString()}

    def nearest(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        t = pa.Table.from_batches(list(batches))
        held = [[h.values.flatten() for h, s in zip(t.column("held"), t.column("second").to_pylist(), strict=True) if s is want] for want in (False, True)]
        if not held[0] or not held[1]:
            return
        vectors = lambda at, v: v.flatten().to_numpy().reshape(len(at), -1)
        y = np.concatenate([vectors(at, v) for at, v in held[1]])
        for ats, v in held[0]:
            xs = vectors(ats, v)
            for i in range(0, len(xs), 256):  # rows at a time, so that memory stays bounded
                x, at = xs[i : i + 256], ats[i : i + 256]
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
                two = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1) if d.shape[1] > 1 else np.hstack([d, np.full_like(d, np.inf)])
                a, b = (pa.array([k.as_py()] * len(x), k.type) for k in key[:2])
                yield pa.RecordBatch.from_arrays([a, b, at, pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b", "at", "first", "second"])

    found = both.groupBy("a", "b", "strip_a", "strip_b").applyInArrow(nearest, f"a {kinds['a']}, b {kinds['b']}, at {kinds['at']}, first double, second double")
    two = F.slice(F.array_sort(F.flatten(F.collect_list(F.array("first", "second")))), 1, 2)
    each = found.groupBy("a", "b", "at").agg(two.alias("two")).select("a", "b", F.get("two", F.lit(0)).alias("d1"), F.get("two", F.lit(1)).alias("d2")).where(F.col("d2") < float("inf"))
    return each.groupBy("a", "b").agg(F.avg((F.col("d1") > ratio * F.col("d2")).cast("double")).alias("share"))


def hamming_classes(old: DataFrame, new: DataFrame, hashes: list[str], cutoff: int, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """What is near what, without the pairs of files: (members, links). Building them runs jobs: the distinct hashes are written and counted.

    members: File_ID, is_new, class_id (the least id of equal hashes) of every file. links: c1, c2, distance of classes
    within the cutoff, c1 < c2, of which at least one holds a new file. A file with a null in its hash could not be
    read and is in neither.
    """
    cols = ["File_ID", *hashes]
    files = old.select(*cols, F.lit(False).alias("is_new")).unionByName(new.select(*cols, F.lit(True).alias("is_new"))).dropna(subset=hashes)
    classes = staged(files.groupBy(hashes).agg(F.min("File_ID").alias("class_id"), F.max("is_new").alias("is_new")), "classes")
    members = files.groupBy(cols).agg(F.max("is_new").alias("is_new")).hint("merge").join(classes.drop("is_new"), hashes).select("File_ID", "is_new", "class_id")
    return members, near_links(classes, hashes, cutoff, block)


def hamming_pairs(old: DataFrame, new: DataFrame, hashes: list[str], cutoff: int, block: int = 4096) -> DataFrame:
    """(File_ID_1, File_ID_2, distance) of new files with old and with each other, distance at most cutoff, each pair once.

    Equal hashes are one class; near classes are found by hamming_classes, whose result grows with the files, and are
    spelled out as pairs of files here. A file in old and new is new. Links are many more than their hashes' size lets Spark
    expect, so they are merged with the files, never broadcast; nor are the files, whose compressed size on disk says little of what they take in memory.
    """
    members, links = hamming_classes(old, new, hashes, cutoff, block)
    members = staged(members, "members")  # stands in four places
    side = lambda n: members.select(F.col("class_id").alias(f"c{n}"), F.col("File_ID").alias(f"f{n}"), F.col("is_new").alias(f"new_{n}"))
    pair = [F.least("f1", "f2").alias("File_ID_1"), F.greatest("f1", "f2").alias("File_ID_2"), "distance"]
    apart = links.hint("merge").join(side(1), "c1").hint("merge").join(side(2), "c2").where("new_1 or new_2").select(*pair)
    same = side(1).hint("merge").join(side(2), (F.col("c1") == F.col("c2")) & (F.col("f1") < F.col("f2"))).where("new_1 or new_2").select(F.col("f1").alias("File_ID_1"), F.col("f2").alias("File_ID_2"), F.lit(0).alias("distance"))
    return apart.unionByName(same)


def compare(exact: DataFrame, perceptual: DataFrame) -> DataFrame:
    """Both kinds of pairs; one that is exact isn't listed as perceptual."""
    return exact.unionByName(perceptual.join(exact, ["File_ID_1", "File_ID_2"], "left_anti"))


def checked(pairs: DataFrame, members: DataFrame, nontransitive: DataFrame) -> DataFrame:
    """pairs with a flag: both files are in one DUPLICATES group (members: File_ID, group_id), or the pair has any nontransitive relation."""
    g1, g2 = (members.select(F.col("File_ID").alias(f"File_ID_{k}"), F.col("group_id").alias(f"g{k}")) for k in (1, 2))
    rel = nontransitive.select(F.least("File_ID_1", "File_ID_2").alias("File_ID_1"), F.greatest("File_ID_1", "File_ID_2").alias("File_ID_2")).distinct().withColumn("rel", F.lit(True))
    joined = pairs.join(g1, "File_ID_1", "left").join(g2, "File_ID_2", "left").join(rel, ["File_ID_1", "File_ID_2"], "left")
    return joined.select(*pairs.columns, (F.coalesce(F.col("g1") == F.col("g2"), F.lit(False)) | F.coalesce("rel", F.lit(False))).alias("checked"))


def select_comparisons(pairs: DataFrame, chosen: DataFrame, most: float, members: DataFrame, nontransitive: DataFrame) -> DataFrame:
    """Pairs with both files chosen and a distance below most (not equal to it), with their flag."""
    for k in (1, 2):
        pairs = pairs.join(chosen.select(F.col("File_ID").alias(f"File_ID_{k}")), f"File_ID_{k}", "left_semi")
    return checked(pairs.where(F.col("distance") < most), members, nontransitive)


def closure(pairs: DataFrame) -> DataFrame:
    """(File_ID, group_id): groups of files that relations join, named by their least id.

    Each round every file takes the least group of itself and its neighbours and then that group's own group; groups
    travel twice as far each round. Rounds are written to the shared folder, so that neither plan nor recovery grows; they are merged, as a
    file of groups that is small enough to be broadcast may be many times as large in the driver's memory.
    """
    end = lambda k: F.col(f"File_ID_{k}")
    ways = F.array(F.struct(end(1).alias("a"), end(2).alias("b")), F.struct(end(2).alias("a"), end(1).alias("b")))
    both = staged(pairs.select(F.inline(ways)).distinct(), "closure")
    groups = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("g")), "closure")
    while True:
        near = both.hint("merge").join(groups.select(F.col("a").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        low = groups.hint("merge").join(near, "a").select("a", "g", F.least("g", "h").alias("low"))
        far = groups.select(F.col("a").alias("low"), F.col("g").alias("next"))
        after = staged(low.hint("merge").join(far, "low").select("a", F.least("low", "next").alias("new"), "g"), "closure")
        groups = after.select("a", F.col("new").alias("g"))
        if after.where("new < g").isEmpty():
            return groups.select(F.col("a").alias("File_ID"), F.col("g").alias("group_id"))


def merge_groups(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored groups (File_ID, group_id) with new pairs: groups that come together keep the id of the one with most stored members, of equals the largest id; new groups take their least file's id, negated.

    A stored group is one node of the graph, so the closure runs over the new pairs alone, whatever is stored; only groups
    that they name are counted, and members of others are not touched by any round.
    """
    node = lambda k: F.coalesce(2 * F.col(f"g{k}") + 1, 2 * F.col(f"File_ID_{k}")).alias(f"File_ID_{k}")  # noqa: E731  groups odd, files even
    held = [stored.select(F.col("File_ID").alias(f"File_ID_{k}"), F.col("group_id").alias(f"g{k}")) for k in (1, 2)]
    met = pairs.select("File_ID_1", "File_ID_2").distinct().hint("merge").join(held[0], "File_ID_1", "left").hint("merge").join(held[1], "File_ID_2", "left").select(node(1), node(2)).where("File_ID_1 <> File_ID_2").distinct()
    found = closure(met).select(F.col("File_ID").alias("node"), F.col("group_id").alias("c"))
    groups = found.where("node % 2 <> 0").select(((F.col("node") - 1) / 2).cast("long").alias("group_id"), "c")
    sizes = stored.groupBy("group_id").agg(F.count("*").alias("n")).join(groups, "group_id")
    named = sizes.groupBy("c").agg(F.max_by("group_id", F.struct("n", "group_id")).alias("named"))
    renamed = groups.join(named, "c").where("group_id <> named").select("group_id", "named")
    old = stored.join(renamed, "group_id", "left").select("File_ID", F.coalesce("named", "group_id").alias("group_id"))
    files = found.where("node % 2 = 0").join(named, "c", "left")
    return old.unionByName(files.select((F.col("node") / 2).cast("long").alias("File_ID"), F.coalesce("named", (-F.col("c") / 2).cast("long")).alias("group_id")))


def implied(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs that already lie in one group. Groups grow with the files and are merged with the pairs, never broadcast."""
    g1, g2 = (groups.select(F.col("File_ID").alias(f"File_ID_{k}"), F.col("group_id").alias(f"g{k}")) for k in (1, 2))
    return pairs.hint("merge").join(g1, "File_ID_1").hint("merge").join(g2, "File_ID_2").where("g1 = g2").drop("g1", "g2")


def trash_larger(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(File_ID) of the larger of each pair; of equals the second."""
    s1, s2 = (sizes.select(F.col("File_ID").alias(f"File_ID_{k}"), F.col("File_Size").alias(f"s{k}")) for k in (1, 2))
    return pairs.join(s1, "File_ID_1").join(s2, "File_ID_2").select(F.when(F.col("s1") > F.col("s2"), F.col("File_ID_1")).otherwise(F.col("File_ID_2")).alias("File_ID")).distinct()


def commit_relations(verdicts: DataFrame, sizes: DataFrame) -> dict[str, DataFrame]:
    """Rows of better, transitive and nontransitive relations and files to trash, from verdicts (type, File_ID_1, File_ID_2).

    For the two `better` types File_ID_1 is the better file. Pairs are unordered and single; `implied` makes none.
    """
    v = verdicts.where("File_ID_1 <> File_ID_2")
    pair = [F.least("File_ID_1", "File_ID_2").alias("File_ID_1"), F.greatest("File_ID_1", "File_ID_2").alias("File_ID_2")]
    better = F.col("type").startswith("duplicates-with-better")
    dup = better | F.col("type").startswith("duplicates-with-same-quality")
    kind = F.when(dup, DUPLICATES).when(F.col("type") == "alternates", ALTERNATES)
    other = F.when(F.col("type") == "alternates", ALTERNATES).when(F.col("type") == "false-positives", FALSE_POSITIVES)
    larger = trash_larger(v.where(F.col("type") == "duplicates-with-same-quality-trash-larger"), sizes)
    worse = v.where(F.col("type") == "duplicates-with-better-trash-worse").select(F.col("File_ID_2").alias("File_ID"))
    return {
        "better": v.where(better).select(F.col("File_ID_1").alias("Better_File_ID"), F.col("File_ID_2").alias("Worse_File_ID")).distinct(),
        "transitive": v.select(*pair, kind.alias("relation")).where("relation is not null").distinct(),
        "nontransitive": v.select(*pair, other.alias("relation")).where("relation is not null").distinct(),
        "trash": worse.unionByName(larger).distinct(),
    }


def exact_verdicts(pairs: DataFrame) -> DataFrame:
    """The verdict "same quality, trash the larger" on all pending exact pairs."""
    return pairs.where((F.col("distance") == EXACT) & ~F.col("checked")).select(F.lit("duplicates-with-same-quality-trash-larger").alias("type"), "File_ID_1", "File_ID_2")


def by_distance(pairs: DataFrame) -> DataFrame:
    """Nearest first, then by the files' ids."""
    return pairs.orderBy("distance", "File_ID_1", "File_ID_2")


def counters(pairs: DataFrame) -> DataFrame:
    """One row: exact and potential pairs, and those of each that are checked."""
    exact = F.col("distance") == EXACT
    return pairs.agg(
        F.count_if(exact).alias("exact_pairs"), F.count_if(~exact).alias("potential_pairs"),
        F.count_if(exact & F.col("checked")).alias("exact_checked"), F.count_if(~exact & F.col("checked")).alias("potential_checked"),
    )

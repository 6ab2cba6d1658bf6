"""Exact joins of bit hashes within a Hamming distance, without comparing all pairs where the distance allows it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

WORD = 32  # bits that a column of a hash holds, as a long
HOT = 1024  # classes with one value of a piece, from which on they are told apart by their other bits as well
COMPARED = 200  # pairs that a block compares in the time that a join takes for a row
MOST_PROBES = 1 << 17  # of a hash
MOST_TASKS = 10_000  # that blocks are dealt to


def hamming(left: list[Column], right: list[Column]) -> Column:
    """Bits that differ between two hashes held as longs."""
    return reduce(Column.__add__, (F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right, strict=True)))


def bits_of(hashes: list[Column], start: int, width: int) -> Column:
    """The bits from start on (the first is the highest of the first hash) as one number."""
    out, end = None, start + width
    for k, h in enumerate(hashes):
        low, high = max(start, k * WORD), min(end, (k + 1) * WORD)
        if low < high:
            here = F.shiftright(h, (k + 1) * WORD - high).bitwiseAND((1 << (high - low)) - 1)
            here = F.shiftleft(here, end - high)
            out = here if out is None else out.bitwiseOR(here)
    return out


def cuts(bits: int, pieces: int) -> list[tuple[int, int]]:
    """(start, width) of so many pieces of nearly equal width."""
    edges = [bits * k // pieces for k in range(pieces + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def radii(pieces: int, cutoff: int) -> list[int]:
    """How far to look in each piece: with cutoff = q * pieces + r, a pair within it differs by at most q bits in one of the first r + 1 pieces, or by at most q - 1 in one of the others."""
    q, r = divmod(cutoff, pieces)
    return [q if k <= r else q - 1 for k in range(pieces)]


def probes(widths: list[int], cutoff: int) -> int:
    """How many values are looked up for a hash."""
    return sum(comb(w, d) for w, far in zip(widths, radii(len(widths), cutoff), strict=True) for d in range(far + 1))


def pieces_for(n: int, bits: int, cutoff: int) -> tuple[int, float]:
    """The number of pieces that costs least for n hashes, and rows of the join for each hash, if hashes are spread evenly."""
    best = (1, float("inf"))
    for m in range(1, min(bits, cutoff + 1) + 1):
        widths = [w for _, w in cuts(bits, m)]
        if max(widths) > 60 or (p := probes(widths, cutoff)) > MOST_PROBES:
            continue
        rows = p * (1 + n / 2 ** min(widths))
        if rows < best[1]:
            best = (m, rows)
    return best


def near_links(classes: DataFrame, hashes: list[str], cutoff: int, block: int = 4096, hot: int = HOT) -> DataFrame:
    """(c1, c2, distance) of distinct hashes within the cutoff, c1 < c2, of which at least one is_new.

    classes: class_id, is_new, hashes (no nulls). Two exact ways give the same rows. Pieces: every hash is cut into pieces, and values near its own are
    looked up in each (see by_pieces); its work for each hash hardly grows with the hashes as long as the cutoff is a small part of the bits. Blocks: every block of hashes is compared with those
    of near numbers of bits (see by_blocks), which is quadratic. The cheaper one is taken, by the number of hashes and the cutoff.
    """
    n = classes.count()
    m, rows = pieces_for(max(n, 2), WORD * len(hashes), cutoff)
    return by_pieces(classes, hashes, cutoff, m, hot) if rows < n / (2 * COMPARED) else by_blocks(classes, hashes, cutoff, block)


def _masks(spark, pieces: list[tuple], name: str) -> DataFrame:
    """Rows (*key, mask, weight) of all masks of (key, width, radius): at most MOST_PROBES for each key."""
    rows = []
    for key, width, far in pieces:
        rows += [(*key, sum(1 << b for b in at), d) for d in range(far + 1) for at in combinations(range(width), d)]
    keys = {1: "at int", 3: "at int, weight int, at2 int"}[len(pieces[0][0])]
    last = "mask long, weight int" if len(pieces[0][0]) == 1 else "mask long, weight2 int"
    return F.broadcast(spark.createDataFrame(rows, f"{keys}, {last}"))


def candidates(classes: DataFrame, hashes: list[str], cutoff: int, pieces: int, hot: int = HOT) -> DataFrame:
    """Rows (c1, c2, both hashes) that meet in a piece: all pairs within the cutoff and some others, a pair once for each piece it meets in.

    One side stands under its own values, the other looks up all values within the radius of its piece, so that equal keys
    meet. A value of a piece that more than `hot` classes have (as of images with plain borders) is hot: there the rest of the bits is cut as well, for what the
    piece leaves of the cutoff, and both keys must meet.
    """
    spark, bits = classes.sparkSession, WORD * len(hashes)
    columns = [F.col(h) for h in hashes]
    parts, far = cuts(bits, pieces), radii(pieces, cutoff)
    own = classes.select("class_id", "is_new", *hashes, F.posexplode(F.array(*(bits_of(columns, *p) for p in parts))).alias("at", "piece"))
    first = _masks(spark, [((k,), w, r) for k, ((_, w), r) in enumerate(zip(parts, far, strict=True)) if r >= 0], "at")
    looked = own.join(first, "at").withColumn("piece", F.col("piece").bitwiseXOR(F.col("mask"))).drop("mask")
    side = lambda df, n, *keys: df.select(*keys, F.col("class_id").alias(f"c{n}"), *(F.col(h).alias(f"{h}_{n}") for h in hashes), F.col("is_new").alias(f"new_{n}"))
    wanted = (F.col("c1") < F.col("c2")) & (F.col("new_1") | F.col("new_2"))
    met = lambda a, b, keys: side(a, 1, *keys).join(side(b, 2, *keys), keys).where(wanted).drop(*keys)

    often = staged(own.groupBy("at", "piece").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("at", "piece"), "hot")  # at most pieces * n / hot rows
    if pieces == 1 or often.isEmpty():
        return met(looked, own, ["at", "piece"])
    cold = met(looked, own.join(often, ["at", "piece"], "left_anti"), ["at", "piece"])
    # The rest of the bits of each piece's hashes, in pieces of about the same width.
    rests = []
    for start, width in parts:
        rest = [(0, start), (start + width, bits - start - width)]
        rests.append([(s + a, w) for s, n in rest if n for a, w in cuts(n, max(1, round(n * pieces / bits)))])
    if any(len(r) != len(rests[0]) for r in rests):  # the same number for each, so that one array holds them
        most = max(map(len, rests))
        rests = [r if len(r) == most else _split(r, most) for r in rests]
    inner = F.get(F.array(*(F.array(*(bits_of(columns, *p) for p in r)) for r in rests)), F.col("at"))
    deeper = lambda df: df.join(often, ["at", "piece"], "left_semi").select("*", F.posexplode(inner).alias("at2", "piece2"))
    second = []
    for k, r in enumerate(rests):
        for weight in range(far[k] + 1):
            second += [((k, weight, j), w, x) for j, ((_, w), x) in enumerate(zip(r, radii(len(r), cutoff - weight), strict=True)) if x >= 0]
    near = deeper(looked).join(_masks(spark, second, "at2"), ["at", "weight", "at2"]).withColumn("piece2", F.col("piece2").bitwiseXOR(F.col("mask")))
    return cold.unionByName(met(near, deeper(own), ["at", "piece", "at2", "piece2"]))


def _split(parts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The widest parts halved until there are `most`."""
    parts = list(parts)
    while len(parts) < most:
        k = max(range(len(parts)), key=lambda i: parts[i][1])
        start, width = parts[k]
        parts[k : k + 1] = [(start, width // 2), (start + width // 2, width - width // 2)]
    return parts


def by_pieces(classes: DataFrame, hashes: list[str], cutoff: int, pieces: int, hot: int = HOT) -> DataFrame:
    """Near classes by multi-index hashing: the candidates, compared."""
    d = hamming([F.col(f"{h}_1") for h in hashes], [F.col(f"{h}_2") for h in hashes])
    return candidates(classes, hashes, cutoff, pieces, hot).select("c1", "c2", d.cast("int").alias("distance")).where(F.col("distance") <= cutoff).distinct()


def by_blocks(classes: DataFrame, hashes: list[str], cutoff: int, block: int) -> DataFrame:
    """For cutoffs that are a large part of the bits: hashes dealt into blocks by their number of bits, each block about `block` rows.

    Two hashes within the cutoff differ by at most as much in their number of bits, so a block meets only those of near
    numbers; every two such blocks are compared in one task, which gives only what is within the cutoff. A hash is
    copied once for each block that its own meets, so the work grows with the square of the distinct hashes, but neither
    the plan nor a task grows with them: there are as many tasks as the comparisons ask for, not as the bytes of the blocks do.
    """
    ones = reduce(Column.__add__, (F.bit_count(h) for h in hashes))
    rows = classes.withColumn("ones", ones)
    most = WORD * len(hashes)
    # One row for each number of bits: at most `most` + 1.
    sizes = {r.ones: r.n for r in rows.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    held = {b: -(-n // block) for b, n in sizes.items()}
    compared = sum(n * m for b, n in sizes.items() for c, m in sizes.items() if b <= c <= b + cutoff)
    counts = F.array(*(F.lit(held.get(b, 0)) for b in range(most + 1)))  # blocks of each number of bits
    mine = F.struct(F.col("ones").alias("b"), F.pmod(F.xxhash64(*hashes), F.get(counts, F.col("ones"))).cast("int").alias("k"))
    near = F.sequence(F.greatest(F.col("ones") - cutoff, F.lit(0)), F.least(F.col("ones") + cutoff, F.lit(most)))
    blocks = F.flatten(F.transform(near, lambda b: F.transform(F.sequence(F.lit(0), F.get(counts, b)), lambda k: F.struct(b.alias("b"), k.alias("k")))))
    blocks = F.filter(blocks, lambda x: x["k"] < F.get(counts, x["b"]))
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(blocks)).select(
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "class_id", "is_new", *hashes
    )
    kind = classes.schema["class_id"].dataType.simpleString()

    def links(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        t = pa.Table.from_batches(list(batches))
        ids, new = t.column("class_id").to_numpy(), t.column("is_new").to_numpy()
        bits = np.stack([t.column(h).to_numpy() for h in hashes])
        second = t.column("second").to_numpy()
        alone = not second.any()  # a block met with itself
        left = np.flatnonzero(~second)
        right = left if alone else np.flatnonzero(second)
        for at in range(0, len(left), 256):  # strips, so that memory stays bounded
            part = left[at : at + 256]
            d = sum(np.bitwise_count(b[part][:, None] ^ b[right]).astype(np.int32) for b in bits)
            x, y = np.nonzero((d <= cutoff) & (new[part][:, None] | new[right]) & ((part[:, None] < right) if alone else True))
            if len(x):
                a, b = ids[part[x]], ids[right[y]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[x, y])], names=["c1", "c2", "distance"])

    dealt = dealt.repartition(min(MOST_TASKS, compared // (4 * block**2) + 1), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(links, f"c1 {kind}, c2 {kind}, distance int")

"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Windows, WordHashes, kept_in_worker, mix64, staged, unused

BANDS, ROWS = 40, 4  # a pair of similarity 0.75 shares a band but for a chance of (1 - 0.75^4)^40, 3 in 10 million
BLOCK = 256  # documents of a bucket that a task compares with as many others
SURE_BELOW = 0.58  # five standard deviations under 0.75 for an estimate from BANDS * ROWS coordinates
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Sets of hashed shingles of texts: words are runs of other than ASCII white space, A-Z lowered."""

    def __init__(self, words: int):
        self.words, self.hashes, self.windows = words, WordHashes(), Windows(0x9E3779B97F4A7C15)

    def of(self, text: bytes | None) -> np.ndarray:
        got = (text or b"").lower().split()
        if not got:
            return np.zeros(0, np.uint64)
        n = min(len(got), self.words)
        return np.unique(mix64(self.windows.of(self.hashes.of(got), n) ^ np.uint64(n)))


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Fast similarity sketches, 16 bits a coordinate; all 0 for an empty set.

    In each of the first `size` rounds every element of a set throws one hashed value at one hashed bin; in round
    size + k all throw at bin k, so every bin fills. A bin keeps its least value of the earliest round. Two sets agree
    in a coordinate with a chance that is their similarity, as concentrated as with independent permutations. A set
    leaves as soon as its bins are full: after one or two rounds, if it has many elements.
    """
    lengths = np.array([len(s) for s in sets], np.int64)
    out = np.full(len(sets) * size, _MOST, np.uint64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    for r in range(2 * size):
        if not len(elements):
            break
        h = mix64(elements ^ mix64(np.array([r + 1], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        bins = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if r < size else r - size
        np.minimum.at(out, owner * size + bins, (np.uint64(r) << np.uint64(48)) | (mix64(h) >> np.uint64(16)))
        short = (out.reshape(-1, size) == _MOST).any(1)
        keep = short[owner]
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
    out = (mix64(out) & np.uint64(0xFFFF)).astype(np.uint16).reshape(-1, size)
    out[lengths == 0] = 0
    return out


def _sketch(words: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = kept_in_worker(("shingler", words), lambda: Shingler(words))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingler.of(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([x.tobytes() for x in sketches(sets, size)], pa.binary())],
                    names=["doc_id", "n", "set_id", "sketch"],
                )

    return run


def _shingle(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept_in_worker(("shingler", words), lambda: Shingler(words))
        for b in batches:
            sets = [shingler.of(t).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block; side 2 is a block met with itself."""
    side = t.column("side").to_numpy()
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _block_nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a bucket, the rows that have a like enough sketch of another component in the other block, if this is the first band that the two share."""
    t = pa.Table.from_batches(list(batches))
    comp, at = t.column("comp").to_numpy(), t.column("at")[0].as_py()
    sk = np.stack([np.frombuffer(x, np.uint16) for x in t.column("sketch").to_pylist()])
    first, second = _sides(t)
    hit = np.zeros(len(comp), bool)
    for i in first:
        other = second[comp[second] != comp[i]]
        same = sk[other] == sk[i]
        like = (same.sum(1) >= SURE_BELOW * size) & (same.reshape(len(other), BANDS, ROWS).all(2).argmax(1) == at)
        if like.any():
            hit[i] = True
            hit[other[like]] = True
    if hit.any():
        yield from t.filter(pa.array(hit)).select(["band", "i", "j", "side", "node", "comp"]).combine_chunks().to_batches()


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of two blocks of a bucket, links on full sets that join all components that such links join: at most one a row."""
    t = pa.Table.from_batches(list(batches))
    nodes, comp = t.column("node").to_numpy(), t.column("comp").to_pylist()
    sets = [x.values.to_numpy() for x in t.column("shingles").combine_chunks()] if t.num_rows else []
    first, second = _sides(t)
    lengths = np.array([len(x) for x in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    column = np.cumsum(counts > 1) - 1  # only what two sets hold can be in an intersection
    keep = counts[inverse] > 1
    owner, place = owner[keep], column[inverse[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1, 4096):  # counted in strips, so memory stays bounded
        a, b = np.searchsorted(place, [low, low + 4096])
        strip = np.zeros((len(sets), 4096), np.float32)
        strip[owner[a:b], place[a:b] - low] = 1
        both += strip @ strip.T
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i in first:
        inter = both[i, second].astype(np.int64)
        for j in second[100 * inter >= percent * (lengths[i] + lengths[second] - inter)]:
            x, y = find(comp[i]), find(comp[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out]), pa.array([b for _, b in out])], names=["a", "b"])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, comp): the least node that can be reached, for every node that has an edge (a, b).

    Alternating large and small stars: each round links every node's larger, then smaller, neighbours to its least one.
    Every round is a written table; the number of rounds grows with the logarithm of the nodes.
    """
    stars = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), label)
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = staged(small.distinct(), label)
        after = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        before = after


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of percent/100 or more.

    Documents with equal sets are one node. Each node's sketch is cut into BANDS bands; nodes with an equal band are a
    bucket. First each node is verified on full sets against the least node of its buckets. Of a bucket that still holds
    several components, the members of the largest are not compared with each other; they are cut into blocks, as is
    the rest, and the rest's blocks meet each other and those of the largest, two in one task: by sketches, then those
    that may be linked on full sets. A bucket of n members of which r are not in the largest component is copied
    n * r / BLOCK^2 block pairs wide, so one stray costs each member one copy. Only links that join components leave a
    task, so pairs are never made as rows.

    Two nodes of similarity percent/100 have no bucket in common with a chance of 3 in 10 million, and sketches that
    agree in less than SURE_BELOW with about as much; that is all that can be missed.

    Documents without words have an empty set and stay alone. Rows that share an id are one document for linking and
    give a row each. A null id stays alone, with a null component. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, n_shingles, component_id, kept.
    """
    size = BANDS * ROWS
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = staged(docs.mapInArrow(_sketch(words, size), f"doc_id {kind}, n long, set_id binary, sketch binary"), "sketches")
    sets = staged(known.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "sets")
    bands = F.array(*(F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)))
    banded = sets.select("node", F.posexplode(bands).alias("at", "band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    members = staged(banded.join(shared, "band"), "buckets")

    wanted = members.select("node").distinct()
    full = staged(docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").distinct().mapInArrow(_shingle(words), f"node {kind}, shingles array<long>"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        one = full.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        two = full.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (
            pairs.join(one, "a").join(two, "b")
            .where((100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))) & (100 * both >= percent * (F.size("sa") + F.size("sb") - both)))
            .select("a", "b")
        )

    links = staged(verified(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()), "links")
    comps = components(links)
    placed = members.join(comps, "node", "left").select("band", "at", "node", F.coalesce("comp", "node").alias("comp"))
    held = placed.groupBy("band", "comp").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.max("c").alias("b"), F.sum("c").alias("k"), F.count("*").alias("comps"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = held.where("comps > 1").select(F.col("band").alias("m_band"), "big", blocks(F.col("b")).alias("bigs"), blocks(F.col("k") - F.col("b")).alias("rests"))
    # Members of a bucket's largest component meet the rest only: numbers j of their blocks are negative.
    is_big = F.col("comp") == F.col("big")
    mine = F.pmod(F.xxhash64("node"), F.when(is_big, F.col("bigs")).otherwise(F.col("rests"))).cast("int")
    place = lambda i, j, side: F.struct(i.alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    among = each(F.col("rests"), lambda o: place(F.least(o, mine), F.greatest(o, mine), F.when(o == mine, 2).when(mine < o, 0).otherwise(1)))
    rest = F.concat(among, each(F.col("bigs"), lambda o: place(mine, -1 - o, F.lit(0))))
    others = F.when(is_big, each(F.col("rests"), lambda o: place(o, -1 - mine, F.lit(1)))).otherwise(rest)
    dealt = placed.join(mixed, F.col("band") == F.col("m_band")).join(sets.select("node", "sketch"), "node").select("band", "at", "node", "comp", "sketch", F.explode(others).alias("p"))

    dealt = dealt.select("band", "at", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.col("p.side").alias("side"), "node", "comp", "sketch")

    def near(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_nodes(rows, size)

    def link(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_links(rows, percent)

    close = dealt.groupBy("band", "i", "j").applyInArrow(near, f"band long, i int, j int, side int, node {kind}, comp {kind}")
    late = staged(close.join(full, "node").groupBy("band", "i", "j").applyInArrow(link, f"a {kind}, b {kind}"), "links")
    if not late.isEmpty():
        comps = components(links.unionByName(late))
    nodes = known.select("doc_id", "n", "set_id").join(sets.select("set_id", "node"), "set_id", "left").join(comps, "node", "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "node")).otherwise(F.col("doc_id"))
    return nodes.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, unchanged, of which each near-duplicate group keeps the one of least id.

    Null ids stay, as do null and empty texts; of rows that share an id all stay or go; an empty table gives no rows; columns
    may have any names.
    """
    (gone,) = unused(docs, "gone")
    lost = near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(lost, F.col(id_col) == F.col(gone), "left_anti")

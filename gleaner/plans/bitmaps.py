"""Posting lists as bitmaps, and searches and counts on them.

A row (Tag_ID, word, bits) holds which of the taggables 64 * word ... 64 * word + 63 carry a tag. A boolean tree is then integer
operations on the words of its leaves, 64 taggables at a time inside generated code; counts are sums of bit counts. A tag on
everything takes 8 bytes for 64 taggables, a rare one no more rows than it has pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as q
from .search import Search


def word_of(ids: Column) -> Column:
    return F.shiftright(ids.cast("long"), 6)


def bit_of(ids: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), ids.cast("long").bitwiseAND(63).cast("int"))


def postings(pairings: DataFrame) -> DataFrame:
    """(Tag_ID, word, bits) of pairings, repeated or not."""
    return pairings.groupBy("Tag_ID", word_of(F.col("Taggable_ID")).alias("word")).agg(F.bit_or(bit_of(F.col("Taggable_ID"))).alias("bits"))


def words_of(ids: DataFrame, key: str = "Taggable_ID") -> DataFrame:
    """(word, bits) of a set of ids."""
    return ids.groupBy(word_of(F.col(key)).alias("word")).agg(F.bit_or(bit_of(F.col(key))).alias("bits"))


def ids_of(words: DataFrame, key: str = "Taggable_ID") -> DataFrame:
    """The ids that words hold, one row each."""
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(1) == 1)
    return words.select("word", F.explode(held).alias("i")).select((F.col("word") * 64 + F.col("i")).alias(key))


def size_of(words: DataFrame) -> DataFrame:
    """(n): how many ids words hold."""
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))


def counts_of(groups: DataFrame, pairings: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(gid, count) of groups (gid, Tag_ID): distinct taggables, of those found if given, that carry any tag of the group; groups of none are left out.

    Pairs, repeated or not, become bits of their tag before they are shuffled, so a tag on everything sends a 64th of its pairs at most, and
    no task holds pairs to make them distinct. What was found meets words, not pairs, and is computed once.
    """
    held = postings(pairings).join(groups.select("gid", "Tag_ID").distinct(), "Tag_ID")
    words = held.groupBy("gid", "word").agg(F.bit_or("bits").alias("bits"))
    if found is not None:
        among = words_of(found).withColumnRenamed("bits", "among")
        words = words.join(among, "word").select("gid", F.col("bits").bitwiseAND(F.col("among")).alias("bits"))
    return words.groupBy("gid").agg(F.sum(F.bit_count("bits")).cast("long").alias("count")).where(F.col("count") > 0)


@dataclass
class BitmapSearch(Search):
    """A search whose tags come from posting lists (those of the collection's pairings unless stored ones are given).

    Other leaves (literals, metrics, lists with conditions) are found as in Search and become words with the rest. The tree is one
    expression over the words of its leaves, which one aggregation by word brings together.
    """

    posted: DataFrame | None = None

    def words(self, node: q.Node) -> DataFrame:
        """(word, bits) of what a query finds; no row is empty."""
        node = q.normalize(node)
        universe = words_of(self.universe()).withColumnRenamed("bits", "all")
        leaves: dict[q.Node, int] = {}
        tree = self._bits(node, leaves)
        if not leaves:
            found = universe.select("word", "all", tree.alias("tree"))
        else:
            known = self._leaf_words(leaves)
            found = universe.join(known, "word", "left" if self._needs_all(node) else "inner").na.fill(0).select("word", "all", tree.alias("tree"))
        return found.select("word", F.col("tree").bitwiseAND(F.col("all")).alias("bits")).where("bits <> 0")

    def run(self, node: q.Node) -> DataFrame:
        return ids_of(self.words(node))

    def count(self, node: q.Node) -> DataFrame:
        return size_of(self.words(node))

    def _bits(self, node: q.Node, leaves: dict[q.Node, int]) -> Column:
        part = lambda n: self._bits(n, leaves)
        if isinstance(node, q.Universe | q.Empty):
            return F.lit(-1 if isinstance(node, q.Universe) else 0).cast("long")
        if isinstance(node, q.Union):
            return reduce(Column.bitwiseOR, map(part, node.parts))
        if isinstance(node, q.Intersect):
            return reduce(Column.bitwiseAND, map(part, node.parts))
        if isinstance(node, q.Complement):
            return F.bitwise_not(part(node.part))
        if isinstance(node, q.SymmetricDifference):
            return part(node.left).bitwiseXOR(part(node.right))
        return F.col(f"b{leaves.setdefault(node, len(leaves))}")

    def _leaf_words(self, leaves: dict[q.Node, int]) -> DataFrame:
        """(word, b0, b1, ...), null where a leaf has nothing."""
        posted = self.posted if self.posted is not None else postings(self.collection.pairing_rows)
        rows = []
        number = lambda of, kind: F.create_map(*(F.lit(x).cast(k) for kv in of.items() for x, k in zip(kv, (kind, "int"), strict=True)))
        tags = {n.tag_id: i for n, i in leaves.items() if isinstance(n, q.Tag)}
        if tags:
            rows.append(posted.where(F.col("Tag_ID").isin(list(tags))).select("word", "bits", number(tags, "long")[F.col("Tag_ID").cast("long")].alias("leaf")))
        names = {n.lookup_name: i for n, i in leaves.items() if isinstance(n, q.Lookup)}
        if names:
            rows.append(posted.join(self.tags_named(list(names)), "Tag_ID").select("word", "bits", number(names, "string")[F.col("Lookup_Name")].alias("leaf")))
        rest = [n for n in leaves if not isinstance(n, q.Tag | q.Lookup)]
        if rest:
            flags = self._flags({n: k for k, n in enumerate(rest)})
            which = F.array_compact(F.array(*(F.when(F.col(f"f{k}"), leaves[n]) for k, n in enumerate(rest))))
            each = flags.select("Taggable_ID", F.explode(which).alias("leaf"))
            rows.append(each.groupBy(word_of(F.col("Taggable_ID")).alias("word"), "leaf").agg(F.bit_or(bit_of(F.col("Taggable_ID"))).alias("bits")).select("word", "bits", "leaf"))
        every = reduce(DataFrame.unionByName, rows)
        return every.groupBy("word").agg(*(F.bit_or(F.when(F.col("leaf") == i, F.col("bits"))).alias(f"b{i}") for i in leaves.values()))

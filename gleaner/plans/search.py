"""From a query to one DataFrame of taggable ids."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as q
from ..sources.staging import staged
from .collection import Collection, with_metrics

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "<>": operator.ne}


def compared(left: Column, comparator: str, right: Column) -> Column:
    return _OPS[comparator](left, right)


@dataclass
class Search:
    """Compiles queries for one user.

    Each distinct leaf becomes a number. Its taggables come as rows (Taggable_ID, leaf): tags by one join of the
    pairings with the tags that the leaves name, metrics by one pass over the applied values. One aggregation by taggable
    makes a flag of each leaf; the query's tree is then a boolean of flags over the universe. So a query of any depth has
    one shuffle of its leaves and one join to the universe. Of a conditional list, the leaves of its conditions are
    flags of the same aggregation, which also gathers the list's expressions that each taggable has; with conditions,
    that table is written once, and one more aggregation of it, by expression, tells which expressions meet them.
    """

    collection: Collection
    user: int | None = None
    tag_services: tuple[int, ...] | None = None
    taggable_services: tuple[int, ...] | None = None
    with_trash: bool = False
    leaves: dict[q.Node, int] = field(default_factory=dict)

    def universe(self) -> DataFrame:
        u = self.collection.taggables
        if not self.with_trash:
            u = u.where(~F.col("In_Trash"))
        if self.taggable_services is not None:
            u = u.where(F.col("Service_ID").isin(list(self.taggable_services)))
        return u.select("Taggable_ID")

    def run(self, node: q.Node) -> DataFrame:
        """The taggables that a query finds: (Taggable_ID)."""
        return self._within(self.universe(), q.normalize(node))

    def unlimited(self, node: q.Node) -> DataFrame:
        """As run, over all taggables, trash included: what conditions and counts are measured on."""
        return self._within(self.collection.taggables.select("Taggable_ID"), q.normalize(node))

    def _within(self, universe: DataFrame, node: q.Node) -> DataFrame:
        if isinstance(node, q.Universe):
            return universe
        if isinstance(node, q.Empty):
            return universe.limit(0)
        if isinstance(node, q.Tag):  # no flags needed
            held = self.collection.pairings.where(F.col("Tag_ID") == node.tag_id).select("Taggable_ID")
            return universe.join(held, "Taggable_ID", "left_semi")
        leaves: dict[q.Node, int] = {}
        flag = self._flag(node, leaves)
        known = self._flags(leaves)
        if self._needs_all(node):
            whole = universe.join(known, "Taggable_ID", "left").na.fill(False)
            return whole.where(flag).select("Taggable_ID")
        return known.where(flag).select("Taggable_ID").join(universe, "Taggable_ID", "left_semi")

    def _flags(self, leaves: dict[q.Node, int]) -> DataFrame:
        """(Taggable_ID, f0, f1, ...) of every taggable that has a leaf."""
        every, seen = dict(leaves), 0
        while seen < len(every):  # the leaves of conditions get numbers too, and those of lists inside of them
            new, seen = list(every)[seen:], len(every)
            for n in new:
                for s in self._sets(n) if isinstance(n, q.ListUnion) else ():
                    self._flag(s, every)
        lists = {n: i for n, i in every.items() if isinstance(n, q.ListUnion)}
        plain = {n: i for n, i in every.items() if n not in lists}
        rows = self._leaf_rows(plain, lists)
        flags = [F.max(F.col("leaf") == i).alias(f"f{i}") for i in plain.values()]
        gathered = [F.collect_set(f"x{i}").alias(f"x{i}") for i in lists.values()]
        known = rows.groupBy("Taggable_ID").agg(*flags, *gathered)
        known = known.select("Taggable_ID", *(F.coalesce(f"f{i}", F.lit(False)).alias(f"f{i}") for i in plain.values()), *(f"x{i}" for i in lists.values()))
        if any(n.conditions for n in lists):
            known = staged(known.join(self.collection.taggables.select("Taggable_ID"), "Taggable_ID", "left_semi"), "flags")
        # Those without lists in their conditions first: their flags are known to the others.
        for n, i in sorted(lists.items(), key=lambda kv: self._nested(kv[0])):
            if n.conditions:
                held = known.select("Taggable_ID", F.explode(f"x{i}").alias("expr"))
                kept = held.join(self._surviving(n, i, known, every), "expr", "left_semi").select("Taggable_ID").distinct()
                known = known.join(kept.withColumn(f"f{i}", F.lit(True)), "Taggable_ID", "left").withColumn(f"f{i}", F.coalesce(f"f{i}", F.lit(False)))
            else:
                known = known.withColumn(f"f{i}", F.size(f"x{i}") > 0)
        return known.drop(*(f"x{i}" for i in lists.values()))

    @staticmethod
    def _sets(node: q.ListUnion) -> list[q.Node]:
        """The distinct queries that a list's conditions count."""
        return list(dict.fromkeys(q.normalize(x) for c in node.conditions for x in (c.compare, c.within) if x is not None))

    def _nested(self, node: q.Node) -> int:
        """How deep lists are nested in a list's conditions."""
        deep = [0]
        for s in self._sets(node):
            q.walk(s, lambda n: deep.append(1 + self._nested(n)) if isinstance(n, q.ListUnion) else None)
        return max(deep)

    def _needs_all(self, node: q.Node) -> bool:
        """Whether a taggable of no leaf can be found."""
        if isinstance(node, q.Universe):
            return True
        if isinstance(node, q.Complement):
            return not self._needs_all(node.part)
        if isinstance(node, q.Union):
            return any(map(self._needs_all, node.parts))
        if isinstance(node, q.Intersect):
            return all(map(self._needs_all, node.parts))
        if isinstance(node, q.SymmetricDifference):
            return self._needs_all(node.left) != self._needs_all(node.right)
        return False

    def _flag(self, node: q.Node, leaves: dict[q.Node, int]) -> Column:
        if isinstance(node, q.Universe | q.Empty):
            return F.lit(isinstance(node, q.Universe))
        if isinstance(node, q.Union):
            return reduce(operator.or_, (self._flag(p, leaves) for p in node.parts))
        if isinstance(node, q.Intersect):
            return reduce(operator.and_, (self._flag(p, leaves) for p in node.parts))
        if isinstance(node, q.Complement):
            return ~self._flag(node.part, leaves)
        if isinstance(node, q.SymmetricDifference):
            return self._flag(node.left, leaves) != self._flag(node.right, leaves)
        return F.col(f"f{leaves.setdefault(node, len(leaves))}")

    def tags_named(self, names: list[str]) -> DataFrame:
        t = self.collection.tags.where(F.col("Lookup_Name").isin(names))
        if self.tag_services is not None:
            t = t.where(F.col("Local_Tag_Service_ID").isin(list(self.tag_services)))
        return t.select("Tag_ID", "Lookup_Name")

    def _leaf_rows(self, leaves: dict[q.Node, int], lists: dict[q.Node, int]) -> DataFrame:
        """(Taggable_ID, leaf) rows of the leaves, and (Taggable_ID, x<i>) rows of the lists' expressions."""
        c, parts = self.collection, []
        spark = c.pairings.sparkSession
        tags = {n.tag_id: i for n, i in leaves.items() if isinstance(n, q.Tag)}
        if tags:
            number = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv))
            parts.append(c.pairings.where(F.col("Tag_ID").isin(list(tags))).select("Taggable_ID", number[F.col("Tag_ID").cast("int")].alias("leaf")))
        names = {n.lookup_name: i for n, i in leaves.items() if isinstance(n, q.Lookup)}
        if names:
            number = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
            parts.append(c.pairings.join(self.tags_named(list(names)), "Tag_ID").select("Taggable_ID", number[F.col("Lookup_Name")].alias("leaf")))
        literal = [(t, i) for n, i in leaves.items() if isinstance(n, q.Literal) for t in n.taggable_ids]
        if literal:
            parts.append(spark.createDataFrame(literal, "Taggable_ID long, leaf int"))
        measured = {n: i for n, i in leaves.items() if isinstance(n, q.HasMetric | q.InMetricService | q.Compare | q.AppliedValue)}
        if measured:
            applied = c.applied_metrics
            if any(isinstance(n, q.InMetricService) for n in measured):
                applied = with_metrics(applied, c.metrics, "Local_Metric_Service_ID")
            hits = F.array_compact(F.array(*(F.when(self._meets(n), i) for n, i in measured.items())))
            parts.append(applied.select("Taggable_ID", F.explode(hits).alias("leaf")))
        for n, i in lists.items():
            parts.append(self.expressions(n.items).select("Taggable_ID", F.col("expr").alias(f"x{i}")))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return rows if "leaf" in rows.columns else rows.withColumn("leaf", F.lit(None).cast("int"))

    def _meets(self, n: q.Node) -> Column:
        if isinstance(n, q.HasMetric):
            return F.col("Local_Metric_ID") == n.metric_id
        if isinstance(n, q.InMetricService):
            return F.col("Local_Metric_Service_ID") == n.service_id
        mine = (F.col("Local_Metric_ID") == n.metric_id) & F.col("User_ID").eqNullSafe(F.lit(self.user).cast("long"))
        return mine & compared(F.col("Applied_Value"), n.comparator if isinstance(n, q.Compare) else "=", F.lit(n.value))

    def expressions(self, items: q.NamespaceList | q.MetricList) -> DataFrame:
        """(expr, Taggable_ID) of a list; expr is a tag id or an applied value."""
        c = self.collection
        if isinstance(items, q.NamespaceList):
            tags = c.tags_namespaces.where(F.col("Namespace_ID") == items.namespace_id).select("Tag_ID").distinct()
            return c.pairings.join(tags, "Tag_ID").select(F.col("Tag_ID").alias("expr"), "Taggable_ID")
        mine = c.applied_metrics.where((F.col("Local_Metric_ID") == items.metric_id) & F.col("User_ID").eqNullSafe(F.lit(self.user).cast("long")))
        return mine.select(F.col("Applied_Value").alias("expr"), "Taggable_ID")

    def _surviving(self, node: q.ListUnion, number: int, known: DataFrame, leaves: dict[q.Node, int]) -> DataFrame:
        """(expr) of the expressions that meet all conditions: one aggregation by expression, whatever their number."""
        conditions = [c for c in node.conditions if c.kind != "not-in"]
        has = {s: self._flag(s, leaves) for s in self._sets(node)}
        rows = known.select(F.explode(f"x{number}").alias("expr"), *(v.alias(f"s{k}") for k, v in enumerate(has.values())))
        for c in node.conditions:
            if c.kind == "not-in":
                rows = self._without(rows, node.items, c.dropped)
        name = {s: F.col(f"s{k}") for k, s in enumerate(has)}
        total = F.count("*")
        meets = []
        for c in conditions:
            compare = name[q.normalize(c.compare)]
            if c.kind == "count":
                meets.append(compared(F.count_if(compare), c.comparator, F.lit(int(c.amount))))
            else:
                within = None if c.kind == "percent" else name[q.normalize(c.within)]
                both, of = (F.count_if(compare), total) if within is None else (F.count_if(compare & within), F.count_if(within))
                # single precision, as the counts of the reference semantics are divided
                share = (both.cast("double") / F.when(of > 0, of)).cast("float")
                meets.append(F.coalesce(compared(share, c.comparator, F.lit(c.amount).cast("float")), F.lit(False)))
        kept = rows.groupBy("expr").agg(*(m.alias(f"m{k}") for k, m in enumerate(meets)), total.alias("n"))
        return kept.where(reduce(operator.and_, (F.col(f"m{k}") for k in range(len(meets))), F.lit(True))).select("expr")

    def _without(self, rows: DataFrame, items, dropped: tuple[q.Node, ...]) -> DataFrame:
        ids = [n.tag_id for n in dropped if isinstance(n, q.Tag)]
        names = [n.lookup_name for n in dropped if isinstance(n, q.Lookup)]
        if isinstance(items, q.MetricList):
            for n in dropped:
                if isinstance(n, q.AppliedValue | q.Compare) and n.metric_id == items.metric_id:
                    rows = rows.where(~compared(F.col("expr"), getattr(n, "comparator", "="), F.lit(n.value)))
            return rows
        if ids:
            rows = rows.where(~F.col("expr").isin(ids))
        if names:
            rows = rows.join(self.tags_named(names).select(F.col("Tag_ID").alias("expr")), "expr", "left_anti")
        return rows

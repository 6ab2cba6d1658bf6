"""The query language: recursive expressions over tags, metrics and conditional lists."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

COMPARATORS = ("<", "<=", ">", ">=", "=", "<>")


class QueryError(ValueError):
    """A query that doesn't follow the grammar."""


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Universe(Node):
    """All taggables."""


@dataclass(frozen=True)
class Empty(Node):
    """No taggable."""


@dataclass(frozen=True)
class Tag(Node):
    tag_id: int
    name: str | None = None


@dataclass(frozen=True)
class Lookup(Node):
    """Any tag of this lookup name in the chosen tag services."""

    lookup_name: str
    name: str | None = None


@dataclass(frozen=True)
class Literal(Node):
    taggable_ids: tuple[int, ...]


@dataclass(frozen=True)
class HasMetric(Node):
    metric_id: int


@dataclass(frozen=True)
class InMetricService(Node):
    service_id: int


@dataclass(frozen=True)
class Compare(Node):
    """The current user's value of a metric, compared with a constant."""

    comparator: str
    metric_id: int
    value: float


@dataclass(frozen=True)
class AppliedValue(Node):
    """Taggables with this very value of a metric from this user."""

    metric_id: int
    value: float


@dataclass(frozen=True)
class Union(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Intersect(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Complement(Node):
    part: Node


@dataclass(frozen=True)
class Difference(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class SymmetricDifference(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class NamespaceList:
    """One expression for each tag of a namespace."""

    namespace_id: int


@dataclass(frozen=True)
class MetricList:
    """One expression for each value of a metric that the current user applied."""

    metric_id: int


@dataclass(frozen=True)
class Condition:
    """kind: count, percent, filtered (percent within a filter) or not-in (drop the listed expressions)."""

    kind: str
    comparator: str = "="
    amount: float = 0
    compare: Node | None = None
    within: Node | None = None
    dropped: tuple[Node, ...] = ()


@dataclass(frozen=True)
class ListUnion(Node):
    """The union of the expressions of a list that meet all conditions."""

    items: NamespaceList | MetricList
    conditions: tuple[Condition, ...] = field(default=())


def _int(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise QueryError(f"{what} must be a whole number, not {value!r}")
    return value


def _comparator(value: object) -> str:
    if value not in COMPARATORS:
        raise QueryError(f"{value!r} is no comparator")
    return value


def _share(value: object) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
        raise QueryError(f"a percentage lies between 0 and 1, not {value!r}")
    return float(value)


def parse(q: dict) -> Node:
    """The node of a query in its JSON form."""
    if not isinstance(q, dict) or "type" not in q:
        raise QueryError(f"{q!r} is no query")
    kind = q["type"]
    try:
        if kind in ("union", "intersect"):
            return (Union if kind == "union" else Intersect)(tuple(map(parse, q["expressions"])))
        if kind == "complement":
            return Complement(parse(q["expression"]))
        if kind == "tagByLookup":
            if not isinstance(q["Lookup_Name"], str):
                raise QueryError("a lookup name is a string")
            return Lookup(q["Lookup_Name"], q.get("displayName"))
        if kind == "tagByLocalTagID":
            return Tag(_int(q["localTagID"], "a tag id"), q.get("displayName"))
        if kind == "hasLocalMetricID":
            return HasMetric(_int(q["Local_Metric_ID"], "a metric id"))
        if kind == "inLocalMetricServiceID":
            return InMetricService(_int(q["localMetricServiceID"], "a service id"))
        if kind == "localMetricComparison":
            value = q["metricComparisonValue"]
            if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
                raise QueryError("a metric is compared with a finite number")
            return Compare(_comparator(q["comparator"]), _int(q["Local_Metric_ID"], "a metric id"), float(value))
        if kind == "conditional-expression-list-union":
            items = q["expressionList"]
            if items["type"] == "namespace":
                of = NamespaceList(_int(items["namespaceID"], "a namespace id"))
            elif items["type"] == "applied-metrics":
                of = MetricList(_int(items["Local_Metric_ID"], "a metric id"))
            else:
                raise QueryError(f"{items['type']!r} is no list")
            return ListUnion(of, tuple(map(_condition, q["conditions"])))
    except KeyError as e:
        raise QueryError(f"a {kind} needs {e}") from None
    raise QueryError(f"{kind!r} is no query")


def _condition(c: dict) -> Condition:
    kind = c.get("type")
    if kind == "count":
        n = _int(c["occurrences"], "a count")
        if n < 0:
            raise QueryError("a count is not negative")
        return Condition("count", _comparator(c["comparator"]), n, parse(c["compareExpression"]))
    if kind == "percent":
        return Condition("percent", _comparator(c["comparator"]), _share(c["percentage"]), parse(c["compareExpression"]))
    if kind == "filtered":
        return Condition("filtered", _comparator(c["comparator"]), _share(c["percentage"]), parse(c["compareExpression"]), parse(c["filteringExpression"]))
    if kind == "notIn":
        return Condition("not-in", dropped=tuple(Lookup(x["pseudoTagName"]) if x.get("type") == "pseudo-tag" else parse(x) for x in c["compareList"]))
    raise QueryError(f"{kind!r} is no condition")


def children(node: Node) -> tuple[Node, ...]:
    if isinstance(node, Union | Intersect):
        return node.parts
    if isinstance(node, Complement):
        return (node.part,)
    if isinstance(node, Difference | SymmetricDifference):
        return (node.left, node.right)
    if isinstance(node, ListUnion):
        return tuple(x for c in node.conditions for x in (c.compare, c.within, *c.dropped) if x is not None)
    return ()


def walk(node: Node, see: Callable[[Node], None]) -> None:
    see(node)
    for child in children(node):
        walk(child, see)


def normalize(node: Node) -> Node:
    """Canonical form: constants folded, double complements and single operands undone, unconditioned lists left to the compiler."""
    if isinstance(node, Complement):
        part = normalize(node.part)
        if isinstance(part, Empty):
            return Universe()
        if isinstance(part, Universe):
            return Empty()
        return part.part if isinstance(part, Complement) else Complement(part)
    if isinstance(node, Union | Intersect):
        zero, one = (Empty, Universe) if isinstance(node, Union) else (Universe, Empty)
        parts: list[Node] = []
        for p in map(normalize, node.parts):
            if isinstance(p, one):
                return one()
            if not isinstance(p, zero) and p not in parts:
                parts.append(p)
        return zero() if not parts else parts[0] if len(parts) == 1 else type(node)(tuple(parts))
    if isinstance(node, Difference):
        return normalize(Intersect((node.left, Complement(node.right))))
    if isinstance(node, SymmetricDifference):
        left, right = normalize(node.left), normalize(node.right)
        for a, b in ((left, right), (right, left)):
            if isinstance(a, Empty):
                return b
            if isinstance(a, Universe):
                return normalize(Complement(b))
        return Empty() if left == right else SymmetricDifference(left, right)
    if isinstance(node, ListUnion):
        fold = lambda x: None if x is None else normalize(x)
        return replace(node, conditions=tuple(replace(c, compare=fold(c.compare), within=fold(c.within), dropped=tuple(map(normalize, c.dropped))) for c in node.conditions))
    if isinstance(node, Literal):
        return Literal(tuple(sorted(set(node.taggable_ids)))) if node.taggable_ids else Empty()
    return node


def display(node: Node) -> str:
    """How a query reads: ( a OR b ), ( a AND b ), -a."""
    if isinstance(node, Union | Intersect):
        inside = [display(p) for p in node.parts]
        return inside[0] if len(inside) == 1 else "(" + (" OR " if isinstance(node, Union) else " AND ").join(inside) + ")"
    if isinstance(node, Complement):
        return "-" + display(node.part)
    if isinstance(node, Tag):
        return node.name or f"tag {node.tag_id}"
    if isinstance(node, Lookup):
        return node.name or node.lookup_name
    if isinstance(node, Compare):
        return f"metric {node.metric_id} {node.comparator} {node.value:g}"
    if isinstance(node, ListUnion):
        return " and ".join(condition_text(c) for c in node.conditions) or "any of the list"
    return type(node).__name__.lower()


def condition_text(c: Condition) -> str:
    """What a condition asks of an expression."""
    if c.kind == "count":
        return f"must have {c.comparator}{c.amount:g} taggables match {display(c.compare)}"
    if c.kind == "percent":
        return f"must have {c.comparator}{100 * c.amount:g}% of taggables match {display(c.compare)}"
    if c.kind == "filtered":
        return f"must have {c.comparator}{100 * c.amount:g}% of taggables in {display(c.within)} match {display(c.compare)}"
    return "must not be in list [" + ", ".join(map(display, c.dropped)) + "]"


def _bare(node: Node) -> Node:
    while isinstance(node, Complement):
        node = node.part
    return node


def conflicts(a: Node, b: Node) -> bool:
    """Whether two selections are the same tag, whatever their polarity."""
    a, b = _bare(a), _bare(b)
    if isinstance(a, Tag) and isinstance(b, Tag):
        return a.tag_id == b.tag_id
    return isinstance(a, Lookup) and isinstance(b, Lookup) and a.lookup_name == b.lookup_name


def toggle(selected: list[Node], new: Node) -> list[Node]:
    """Selecting a tag again takes it away; with the other polarity it takes the old one's place."""
    if new in selected:
        return [s for s in selected if s != new]
    kept = [s for s in selected if not conflicts(s, new)]
    return [*kept, new]


@dataclass(frozen=True)
class Typed:
    exclude: bool
    namespaces: tuple[str, ...]
    name: str


def typed_entry(text: str) -> Typed:
    """What was typed: a leading - excludes; the last : ends the namespaces, which : also separates."""
    exclude = text.startswith("-")
    *spaces, name = text.removeprefix("-").split(":")
    return Typed(exclude, tuple(s for s in spaces if s), name)


def rating_steps(lower: float, upper: float, precision: int) -> list[float]:
    """The values from lower to upper that a metric of this precision can take, in steps of 10^-precision."""
    n = round((upper - lower) * 10**precision)
    return [round(lower + k / 10**precision, precision) for k in range(n + 1)]

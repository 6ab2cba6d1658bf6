"""The query language and its compiler, against Python sets and the fixed examples."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.plans import query as q
from gleaner.plans.collection import Collection
from gleaner.plans.search import Search


def collection(spark, pairs, ids=range(12), applied=(), tags=None, spaces=(), trash=(), services=None):
    tags = tags or [(t, 1, f"tag {t}") for t in sorted({t for t, _ in pairs})]
    make = spark.createDataFrame
    return Collection(
        make([(i, (services or {}).get(i, 0), i in trash) for i in ids], "Taggable_ID long, Service_ID int, In_Trash boolean"),
        make([(t, s, n, "x", n) for t, s, n in tags], "Tag_ID long, Local_Tag_Service_ID int, Lookup_Name string, Source_Name string, Display_Name string"),
        make([(1, "series"), (2, "meta")], "Namespace_ID int, Namespace_Name string"),
        make(list(spaces), "Tag_ID long, Namespace_ID int"),
        make(list(pairs), "Tag_ID long, Taggable_ID long"),
        make([(1, 1, "a"), (2, 2, "b")], "Local_Metric_ID int, Local_Metric_Service_ID int, Local_Metric_Name string"),
        make(list(applied), "Local_Metric_ID int, User_ID long, Taggable_ID long, Applied_Value double"),
    )


def found(search, node):
    return {r.Taggable_ID for r in search.run(node).collect()}


METRICS = [(2, 7, 0, 4.0), (2, 7, 1, 5.0), (1, 7, 2, 2.0), (2, 8, 3, 4.0), (2, None, 4, 4.0)]


def test_metric_examples(spark):
    s = Search(collection(spark, [(1, 0)], applied=METRICS), user=7)
    assert found(s, q.HasMetric(1)) == {2} and found(s, q.InMetricService(1)) == {2}
    for op, want in (("<", {0}), ("<=", {0, 1}), (">", {1}), (">=", {0, 1}), ("=", set()), ("<>", {0, 1})):
        value = 4.0 if op in (">", ">=") else 5.0 if op in ("<", "<=") else 9.0
        assert found(s, q.Compare(op, 2, value)) == want, op
    assert found(s, q.Compare("=", 2, 5.0)) == {1}
    assert found(Search(s.collection), q.Compare("=", 2, 4.0)) == {4}  # the system's own


PAIRS = [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (3, 9), (4, 0), (4, 1), (4, 2), (4, 3), (5, 3)]
TAGS = [(1, 1, "solo"), (2, 1, "long hair"), (3, 2, "solo"), (4, 1, "highres"), (5, 1, "other")]


def test_lookups_trash_and_services(spark):
    c = collection(spark, PAIRS, tags=TAGS, trash={1}, services={2: 5})
    assert found(Search(c), q.Lookup("solo")) == {0, 2, 9}
    assert found(Search(c, tag_services=(2,)), q.Lookup("solo")) == {9}
    assert found(Search(c, with_trash=True), q.Tag(1)) == {0, 1, 2}
    assert found(Search(c, taggable_services=(5,)), q.Tag(1)) == {2}
    assert found(Search(c), q.Lookup("no such")) == set() == found(Search(c), q.Tag(99))
    assert found(Search(c), q.Literal((0, 0, 1, 777))) == {0}
    assert found(Search(c), q.Complement(q.Literal((0, 777)))) == set(range(2, 12))


def test_conditional_lists(spark):
    c = collection(spark, PAIRS, tags=TAGS, spaces=[(1, 1), (2, 1), (4, 1), (5, 1)])
    s, series = Search(c), q.NamespaceList(1)
    cond = lambda *a, **k: q.Condition(*a, **k)
    union = lambda *cs: found(s, q.ListUnion(series, cs))
    assert union() == {0, 1, 2, 3}
    assert union(cond("count", ">=", 2, q.Tag(1))) == {0, 1, 2, 3}  # tags 1 and 4
    assert union(cond("count", ">=", 2, q.Tag(1)), cond("not-in", dropped=(q.Lookup("highres"),))) == {0, 1, 2}
    assert union(cond("percent", "=", 1.0, q.Tag(1))) == {0, 1, 2}
    assert union(cond("percent", ">=", 0.75, q.Tag(1))) == {0, 1, 2, 3}
    assert union(cond("filtered", "=", 0.5, q.Tag(1), q.Tag(2))) == {0, 1, 2, 3}  # tags 2 and 4
    assert union(cond("filtered", ">=", 0.0, q.Universe(), q.Tag(3))) == set()  # nothing within: dropped
    assert union(cond("count", "=", 0, q.Empty())) == {0, 1, 2, 3}
    assert found(s, q.Complement(q.ListUnion(series, (cond("percent", "=", 1.0, q.Tag(1)),)))) == set(range(3, 12))
    values = [(1, 7, 0, 3.0), (1, 7, 1, 3.0), (1, 7, 2, 4.0), (1, 8, 5, 3.0)]
    m = Search(collection(spark, PAIRS, applied=values), user=7)
    assert found(m, q.ListUnion(q.MetricList(1), (cond("count", "=", 2, q.Tag(4)),))) == {0, 1}
    assert found(m, q.ListUnion(q.MetricList(1), (cond("not-in", dropped=(q.AppliedValue(1, 3.0),)),))) == {2}


LEAVES = st.one_of(st.integers(1, 4).map(q.Tag), st.sampled_from([q.Universe(), q.Empty(), q.Literal((1, 5, 99))]))
TREES = st.recursive(
    LEAVES,
    lambda t: st.one_of(
        st.lists(t, max_size=3).map(lambda x: q.Union(tuple(x))), st.lists(t, max_size=3).map(lambda x: q.Intersect(tuple(x))), t.map(q.Complement),
        st.tuples(t, t).map(lambda x: q.Difference(*x)), st.tuples(t, t).map(lambda x: q.SymmetricDifference(*x)),
    ),
    max_leaves=7,
)


def in_sets(node, sets, everything):
    go = lambda n: in_sets(n, sets, everything)
    if isinstance(node, q.Tag):
        return sets.get(node.tag_id, set())
    if isinstance(node, q.Universe):
        return everything
    if isinstance(node, q.Empty):
        return set()
    if isinstance(node, q.Literal):
        return set(node.taggable_ids) & everything
    if isinstance(node, q.Union):
        return set().union(*map(go, node.parts))
    if isinstance(node, q.Intersect):
        return everything.intersection(*map(go, node.parts))
    if isinstance(node, q.Complement):
        return everything - go(node.part)
    return go(node.left) - go(node.right) if isinstance(node, q.Difference) else go(node.left) ^ go(node.right)


@given(TREES)
@settings(max_examples=300, deadline=None)
def test_normal_form_means_the_same(tree):
    r = random.Random(1)
    sets = {t: {i for i in range(12) if r.random() < 0.4} for t in range(1, 5)}
    everything = set(range(12))
    assert in_sets(q.normalize(tree), sets, everything) == in_sets(tree, sets, everything)
    assert q.normalize(q.normalize(tree)) == q.normalize(tree)


def test_random_trees_on_spark(spark):
    r = random.Random(4)
    sets = {t: {i for i in range(12) if r.random() < 0.4} for t in range(1, 5)}
    s = Search(collection(spark, [(t, i) for t, x in sets.items() for i in x]))

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([q.Tag(r.randint(1, 5)), q.Universe(), q.Literal((1, 5, 99))])
        kind = r.choice([q.Union, q.Intersect, q.Complement, q.Difference, q.SymmetricDifference])
        if kind is q.Complement:
            return kind(tree(depth - 1))
        return kind(tuple(tree(depth - 1) for _ in range(r.randint(0, 3)))) if kind in (q.Union, q.Intersect) else kind(tree(depth - 1), tree(depth - 1))

    for _ in range(12):
        t = tree(3)
        assert found(s, t) == in_sets(t, sets, set(range(12))), t


JSON = {"type": "union", "expressions": [{"type": "tagByLookup", "Lookup_Name": "solo"}, {"type": "complement", "expression": {"type": "localMetricComparison", "comparator": "<=", "Local_Metric_ID": 2, "metricComparisonValue": 5}}, {"type": "conditional-expression-list-union", "expressionList": {"type": "namespace", "namespaceID": 1}, "conditions": [{"type": "notIn", "compareList": [{"type": "pseudo-tag", "pseudoTagName": "z"}]}, {"type": "filtered", "comparator": ">", "percentage": 0.1, "filteringExpression": {"type": "tagByLocalTagID", "localTagID": 3}, "compareExpression": {"type": "hasLocalMetricID", "Local_Metric_ID": 1}}]}]}


def test_parse_and_display():
    node = q.parse(JSON)
    assert node.parts[0] == q.Lookup("solo") and node.parts[1] == q.Complement(q.Compare("<=", 2, 5.0))
    assert node.parts[2].conditions[1] == q.Condition("filtered", ">", 0.1, q.HasMetric(1), q.Tag(3))
    assert q.display(q.Intersect((q.Lookup("a"), q.Complement(q.Lookup("b")), q.Union((q.Lookup("c"),))))) == "(a AND -b AND c)"
    assert q.condition_text(q.Condition("percent", ">", 0.1, q.Lookup("x"))) == "must have >10% of taggables match x"


@pytest.mark.parametrize("bad", [{}, {"type": "no"}, {"type": "union"}, {"type": "tagByLocalTagID", "localTagID": "1"}, {"type": "localMetricComparison", "comparator": "==", "Local_Metric_ID": 1, "metricComparisonValue": 1}, {"type": "localMetricComparison", "comparator": "=", "Local_Metric_ID": 1, "metricComparisonValue": float("inf")}])
def test_bad_queries(bad):
    with pytest.raises(q.QueryError):
        q.parse(bad)


def test_selection_helpers():
    a, b = q.Lookup("a"), q.Tag(1)
    assert q.toggle([a, b], a) == [b]
    assert q.toggle([a, b], q.Complement(a)) == [b, q.Complement(a)]
    assert q.typed_entry("-series:x:name") == q.Typed(True, ("series", "x"), "name")
    assert q.rating_steps(0, 1, 1)[:3] == [0.0, 0.1, 0.2] and len(q.rating_steps(0, 1, 1)) == 11


def test_one_shuffle_of_leaves(spark):
    """Whatever the depth, tags are joined once and aggregated once."""
    s = Search(collection(spark, PAIRS, tags=TAGS))
    node = q.Intersect((q.Tag(1), q.Union((q.Tag(2), q.Complement(q.Tag(4)))), q.Tag(5)))
    plan = s.run(node)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1

"""Content programs: small declarative extractions over HTML and JSON text.

A program is a tree of steps, each with a type, its own settings, and `then`: the steps that get its value. Steps take
a string, an array of strings, a JSON value, a document or a set of elements; two of them emit. The same tree runs in
three ways: over arrays of strings as Spark columns (array_steps), and over whole texts by a pandas UDF that walks
documents and JSON (extract), since SQL has no tolerant HTML reader and no recursive JSON walk.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import IMAGE, VIDEO, has_prefix, has_suffix

# The names of the steps.
HTML, JSON, EMIT_FILE, EMIT_URL = "TransformTextAsHTMLToXML", "TransformTextToJson", "TransformTextToImportFileName", "TransformTextToAdditionalURL"
STARTS, ENDS, LOWER = "StartsWith", "EndsWith", "TransformTextToLowercase"
ROOT, DESCENDANTS, TRAITS, GROUP, ELEMENT, ATTRIBUTE, VALUE = "TransformXMLToXPathRootContextNode", "GetDescendents", "WithTraits", "XPathTraitGroup", "ElementType", "AttributeName", "AttributeValue"
GET_ATTRIBUTE, EACH, ANCESTORS, NOT, SAME, IF = "GetAttribute", "ForEach", "GetUpToNthAncestor", "Not", "Identity", "ConditionalTransform"
WITH_PROPERTY, STRINGS, NTH, TO_ARRAY, FILTER, DISTINCT, MAP = "GetDescendentsWithPropertyName", "GetAllStringPropertyValues", "GetNthValue", "ToStringArray", "Filter", "Distinct", "Map"

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


class Element:
    __slots__ = ("name", "attributes", "parent", "children", "order")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None, order: int):
        self.name, self.attributes, self.parent, self.children, self.order = name, attributes, parent, [], order


class _Reader(HTMLParser):
    """Elements of a page; end tags that fit nothing are passed over, open elements end with the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None, 0)
        self.n = 0

    def handle_starttag(self, tag, attrs):
        while self.at.name in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        self.n += 1
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at, self.n)
        self.at.children.append(new)
        if tag not in _VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.name != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent


def read_html(text: str) -> Element:
    r = _Reader()
    r.feed(text)
    r.close()
    return r.root


def _below(e: Element) -> list[Element]:
    out, stack = [], list(reversed(e.children))
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(x.children)
    return out


def _ordered(elements: list[Element]) -> list[Element]:
    return sorted({e.order: e for e in elements}.values(), key=lambda e: e.order)


_COMPARE: dict[str, Callable[[float, float], bool]] = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def _holds(left: str | None, op: str, right: str) -> bool:
    """Text is compared as text for equality and as numbers for order; what isn't there or is no number never holds."""
    if left is None:
        return False
    if op == "contains":
        return right in left
    if op in ("=", "!="):
        return (left == right) == (op == "=")
    try:
        return _COMPARE[op](float(left), float(right))
    except ValueError:
        return False


def _trait(t: dict, e: Element) -> bool:
    kind = t["type"]
    if kind == GROUP:
        return (all if t["groupType"].strip() == "and" else any)(_trait(x, e) for x in t["expressions"])
    if kind == NOT:
        return not _trait(t["expression"], e)
    if kind == ELEMENT:
        return _holds(e.name, t["operator"], t["value"])
    if kind == ATTRIBUTE:
        return t["value"] in e.attributes
    if kind == VALUE:
        return _holds(e.attributes.get(t["attributeName"]), t["operator"], t["value"])
    raise ValueError(f"{kind!r} is no trait")


def _walk_json(x, see: Callable) -> None:
    see(x)
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        _walk_json(v, see)


def _text(v) -> str:
    return v if isinstance(v, str) else "" if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


class Run:
    """One run of a program over one text; files and urls are what it emitted."""

    def __init__(self):
        self.files: list[str] = []
        self.urls: list[tuple[str, int]] = []

    def step(self, s: dict, v):
        """The value of a step for its input v; its `then` steps run on that value."""
        kind, out = s["type"], None
        if kind == IF:
            out = self.step(s["trueCase"] if self.step(s["ifCheck"], v) is True else s["elseCase"], v)
        elif kind == SAME:
            out = v
        elif kind == HTML:
            out = read_html(v)
        elif kind == ROOT:
            out = [v]
        elif kind == DESCENDANTS:
            out = _ordered([d for e in v for d in _below(e)])
        elif kind == ANCESTORS:
            out = []
            for e in v:
                for _ in range(s["n"]):
                    e = e.parent
                    if e is None or e.parent is None:
                        break
                    out.append(e)
            out = _ordered(out)
        elif kind == TRAITS:
            out = [e for e in v if _trait(s["traits"], e)]
        elif kind == GET_ATTRIBUTE:
            out = [e.attributes[s["attributeName"]] for e in v if s["attributeName"] in e.attributes]
        elif kind == JSON:
            out = json.loads(v)
        elif kind == WITH_PROPERTY:
            out, name = [], s["propertyName"]
            _walk_json(v, lambda x: out.append({name: x[name]}) if isinstance(x, dict) and name in x else None)
        elif kind == STRINGS:
            out = []
            _walk_json(v, lambda x: out.append(x) if isinstance(x, str) else None)
        elif kind == NTH:
            values = list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
            out = values[s["n"]] if s["n"] < len(values) else None
        elif kind == TO_ARRAY:
            out = list(map(_text, v.values() if isinstance(v, dict) else v if isinstance(v, list) else []))
        elif kind == FILTER:
            out = [x for x in v if all(self.step(c, x) is True for c in s["conditions"])]
        elif kind == MAP:
            out = [self.step(s["mapFn"], x) for x in v]
        elif kind == DISTINCT:
            out = list(dict.fromkeys(v))
        elif kind == EACH:
            for t in s.get("then", ()):
                for x in [[k, y] for k, y in v.items()] if isinstance(v, dict) else v if isinstance(v, list) else []:
                    self.step(t, x)
            return None
        elif kind == LOWER:
            out = v.lower()
        elif kind in (STARTS, ENDS):
            ends = s["prefixes" if kind == STARTS else "suffixes"]
            if not s.get("caseSensitive", True):
                v, ends = v.lower(), [x.lower() for x in ends]
            out = v.startswith(tuple(ends)) if kind == STARTS else v.endswith(tuple(ends))
        elif kind == EMIT_FILE:
            self.files.append(v)
            return None
        elif kind == EMIT_URL:
            self.urls.append((v, s["depthAllowed"]))
            return None
        else:
            raise ValueError(f"{kind!r} is no step")
        for t in s.get("then", ()):
            self.step(t, out)
        return out


def run(program: dict, text: str | None) -> tuple[list[str], list[tuple[str, int]]]:
    """(file names, (url, depth)) that a program emits for a text; none for null, and for JSON that can't be read."""
    r = Run()
    if text is not None:
        try:
            r.step(program, text)
        except json.JSONDecodeError:
            return [], []
    return r.files, r.urls


RESULT = "struct<importFileNames:array<string>,additionalUrls:array<struct<url:string,depth:int>>>"


def extract(program: dict, text: Column) -> Column:
    """A program over a column of texts, in Arrow batches."""

    @F.pandas_udf(RESULT)
    def over(texts: pd.Series) -> pd.DataFrame:
        got = [run(program, t) for t in texts]
        return pd.DataFrame({"importFileNames": [f for f, _ in got], "additionalUrls": [[{"url": u, "depth": d} for u, d in us] for _, us in got]})

    return over(text)


def array_steps(steps: list[dict], values: Column) -> Column:
    """Filter, Map and Distinct steps over an array of strings, with built-in functions only."""
    for s in steps:
        if s["type"] == FILTER:
            for c in s["conditions"]:
                values = F.filter(values, functools.partial(_string_test, c))
        elif s["type"] == MAP:
            if s["mapFn"]["type"] != LOWER:
                raise ValueError("only lower case can be mapped here")
            values = F.transform(values, lambda x: F.lower(x))
        elif s["type"] == DISTINCT:
            values = F.array_distinct(values)
        elif s["type"] != SAME:
            raise ValueError(f"{s['type']!r} needs extract()")
    return values


def _string_test(c: dict, x: Column) -> Column:
    if c["type"] == STARTS:
        return has_prefix(x, c["prefixes"], c.get("caseSensitive", True))
    if c["type"] == ENDS:
        return has_suffix(x, c["suffixes"], c.get("caseSensitive", True))
    raise ValueError(f"{c['type']!r} is no test")


def emit(*, depth: int | None = None) -> dict:
    return {"type": EACH, "then": [{"type": EMIT_FILE} if depth is None else {"type": EMIT_URL, "depthAllowed": depth}]}


def attribute_program(element: str, attribute: str, depth: int | None = None) -> dict:
    """All values of an attribute of an element, emitted."""
    return {"type": HTML, "then": [{"type": ROOT, "then": [{"type": DESCENDANTS, "then": [{"type": TRAITS, "traits": _with(element, attribute), "then": [{"type": GET_ATTRIBUTE, "attributeName": attribute, "then": [emit(depth=depth)]}]}]}]}]}


def _with(element: str, attribute: str) -> dict:
    return {"type": GROUP, "groupType": " and ", "expressions": [{"type": ELEMENT, "operator": "=", "value": element}, {"type": ATTRIBUTE, "operator": "exists", "value": attribute}]}


def default_html() -> dict:
    """Sources of images as files, and the links at most three levels above them as urls of depth 0."""
    p = attribute_program("img", "src")
    images = p["then"][0]["then"][0]["then"][0]
    images["then"].append({"type": ANCESTORS, "n": 3, "then": [{"type": TRAITS, "traits": _with("a", "href"), "then": [{"type": GET_ATTRIBUTE, "attributeName": "href", "then": [emit(depth=0)]}]}]})
    return p


def default_json() -> dict:
    """Strings that begin like a URL and end like a media file, in lower case, once each, as files."""
    tests = [{"type": STARTS, "prefixes": ["https://", "http://"], "caseSensitive": False}, {"type": ENDS, "suffixes": [*VIDEO, *IMAGE], "caseSensitive": False}]
    lower = {"type": MAP, "mapFn": {"type": LOWER, "then": []}, "then": [{"type": DISTINCT, "then": [emit()]}]}
    return {"type": JSON, "then": [{"type": STRINGS, "then": [{"type": FILTER, "conditions": tests, "then": [lower]}]}]}


def best_parser(url: Column, parsers: list[tuple[str, int, str]]) -> Column:
    """Of (pattern, priority, name), the name of the highest priority whose pattern finds the URL; of equals the first."""
    ranked = sorted(parsers, key=lambda p: -p[1])
    return F.coalesce(*(F.when(url.rlike(pattern), name) for pattern, _, name in ranked), F.lit(None).cast("string"))

"""Main text of web pages by minimum-cut labelling of their blocks (operator 9)."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Comments; tags; what else is in angle brackets.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)|<[!?/][^>]*+>", re.S | re.I)
_QUOTE_OR_END = re.compile("[>\"']")
# Elements whose text is not that of the page; of some of them, a block ends there.
_RAW = set("script style noscript template iframe canvas title desc annotation annotation-xml textarea select".split())
_RAW_BLOCKS = {"textarea", "select"}
_CODE = {"script", "style"}
_AFTER_CODE = re.compile(r"</?(?:body|html|div|p|article|main|section|header|footer|nav|aside|h[1-6]|ul|ol|table|form)\b", re.I)
_ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z]{2,}")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements that don't end a block, that have no end tag, and that begin a block of their own kind.
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_INLINE |= set("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics svg g text tspan textpath path circle rect line polygon polyline ellipse defs use symbol stop lineargradient radialgradient".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_OPEN_ENDED = set("p li dt dd tr td th option".split())
# Costs, in hundredths: an ancestor's name or the words of its class, id or role speak for boilerplate or content.
_BAD_TAGS = dict.fromkeys("nav footer aside form menu dialog button fieldset".split(), 700) | {"header": 350, "address": 150, "figcaption": 0}
_BAD_WORDS = dict.fromkeys(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent notice popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments respond reply replies disqus feedback discussion legal copyright disclaimer pagination pager toolbar search masthead complementary contentinfo".split(),
    700,
) | {"header": 350, "meta": 100, "tags": 200}
# These in a name of several words leave its meaning.
_NEUTRAL = set("guest reader readers user users visitor visitors area bar block box container group inner item items left list outer panel primary right secondary section site widget widgets wrap wrapper".split())
HIDDEN, FADE, CONTRAST = 700, 0.95, 0.7
_PROSE = ("p", "blockquote", "pre", "h1", "h2", "h3")
PRIOR = (1.0, -1.0, 2.0, 0.6, 0.3, -5.0, -1.2)  # weights of `features` where no page tells others
SPACE = 1 << 62  # hashed pages
_GOOD_TAGS = {"article": 300, "main": 200}
_GOOD_WORDS = {"article": 200, "content": 120, "post": 100, "entry": 120, "story": 150, "main": 120, "body": 60}


class TagEnds:
    """Where tags of a page end: at the first bracket that no quotes hold, or, if quotes don't close, at the first of all.

    What was looked for in vain is remembered: quotes from which no end is reached, and the place from which a kind of quote
    does not come again. So no part of a page is passed over more than twice, however many quotes are left open.
    """

    def __init__(self, page: str, last: int):
        self.page, self.last = page, last
        self.vain: set[int] = set()
        self.none_from: dict[str, int] = {}

    def of(self, at: int) -> int:
        """The place of the bracket that ends the tag whose name ends at `at`; there is one before `last`."""
        passed, place = [], at
        while (m := _QUOTE_OR_END.search(self.page, place, self.last)) and m[0] != ">":
            open_ = m.start()
            close = -1
            if open_ not in self.vain and open_ < self.none_from.get(m[0], self.last):
                close = self.page.find(m[0], open_ + 1, self.last)
                if close < 0:
                    self.none_from[m[0]] = open_
            passed.append(open_)
            if close < 0:
                m = None
                break
            place = close + 1
        if m:
            return m.start()
        self.vain.update(passed)
        return self.page.find(">", at, self.last)


class Block:
    """A block of text, how many of its letters are in links, its element, the tag of that, and what ancestors say: (content, boilerplate)."""

    __slots__ = ("text", "linked", "place", "tag", "costs")

    def __init__(self, text: str, linked: int, place: int, tag: str, costs: tuple[int, int] = (0, 0)):
        self.text, self.linked, self.place, self.tag, self.costs = text, linked, place, tag, costs


class Tree:
    """Elements in page order; number 0 is the page itself. `above` is the next element above that isn't inline, `depth` how many of those there are."""

    def __init__(self):
        self.names, self.own, self.parent, self.above, self.depth = [""], [(0, 0, 0)], [-1], [-1], [0]

    def add(self, name: str, own: tuple[int, int, int], parent: int) -> int:
        above = self.solid(parent)
        self.names.append(name)
        self.own.append(own)
        self.parent.append(parent)
        self.above.append(above)
        self.depth.append(self.depth[above] + (name not in _INLINE))
        return len(self.names) - 1

    def solid(self, e: int) -> int:
        """e, or the next element above it that isn't inline."""
        return self.above[e] if self.names[e] in _INLINE else e

    def apart(self, a: int, b: int, most: int) -> int:
        """Steps between two elements that aren't inline, or more than most."""
        d = 0
        while a != b and d <= most:
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
            d += 1
        return d


def _element_costs(name: str, rest: str) -> tuple[int, int, int]:
    """What one element's name and attributes speak for: content, boilerplate, and text that isn't shown.

    A class, id, role or label speaks for boilerplate by a whole token: all of its words do, or those that aren't neutral.
    """
    good, bad, hidden = _GOOD_TAGS.get(name, 0), _BAD_TAGS.get(name, 0), 0
    if rest and name not in ("html", "body"):
        for m in _ATTRIBUTES.finditer(rest):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id", "role", "aria-label"):
                for token in value.split():
                    words = _WORDS.findall(token)
                    good = max([good, *(_GOOD_WORDS.get(w, 0) for w in words)])
                    told = [w for w in words if w not in _NEUTRAL] or words
                    bad = max(bad, min((_BAD_WORDS.get(w, 0) for w in told), default=0))
            elif key == "hidden" or key == "aria-hidden" and value.strip() == "true" or key == "style" and _UNSEEN.search(value):
                hidden = HIDDEN
    return good, bad, hidden


def _inherit(out: list[Block], places: list[int], tree: Tree) -> None:
    """Give every block the costs of the elements around it (places: the innermost of each).

    An element that holds more than half of the page's text outside links speaks the less for boilerplate the more it holds. A
    cost for boilerplate fades with every element below, and to a quarter in an article or main that holds half of the
    text; that of text that isn't shown stays.
    """
    held = [0] * len(tree.names)
    for b, e in zip(out, places, strict=True):
        held[e] += len(b.text) - b.linked
    for e in range(len(held) - 1, 0, -1):
        held[tree.parent[e]] += held[e]
    total = max(1, held[0])
    told = [(0, 0.0, 0)]
    for e in range(1, len(held)):
        good, bad, hidden = told[tree.parent[e]]
        name, (g, own, unseen), share = tree.names[e], tree.own[e], held[e] / total
        if name not in _INLINE:
            bad *= FADE / 4 if name in _GOOD_TAGS and share >= 0.5 else FADE
        if name == "header" and good >= 200:
            own = min(own, 100)  # an article's own head
        told.append((max(good, g), max(bad, own * min(1.0, 2 * (1 - share))), max(hidden, unseen)))
    for b, e in zip(out, places, strict=True):
        good, bad, hidden = told[e]
        b.costs = (good, max(int(bad), hidden))


def blocks(page: str, marks: bool = True) -> tuple[list[Block], Tree]:
    """The page's blocks of text in order: what stands between tags that aren't inline, references decoded, white space made single.

    Without marks, article and main elements say nothing.

    Time grows with the page: every element enters and leaves the stack once, and after LOOSE tags whose quotes don't
    close a tag ends at the next bracket, quoted or not. An element of _RAW that is never closed is passed over alone,
    or, if it is code, with what stands before the next element that isn't inline.
    """
    out: list[Block] = []
    tree, stack, solid = Tree(), [0], [0]  # solid: places in the stack of elements that aren't inline
    is_open: dict[str, int] = {}
    places: list[int] = []  # the innermost element of each block
    parts: list[str] = []
    linked, at = 0, 0
    ends: dict[str, re.Pattern | None] = {}  # how an element of _RAW ends; None: not any more

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            e = tree.solid(stack[-1])
            out.append(Block(text, min(linked, len(text)), e, tree.names[e]))
            places.append(stack[-1])
        parts, linked = [], 0

    def pop() -> str:
        name = tree.names[stack.pop()]
        is_open[name] -= 1
        if solid[-1] == len(stack):
            solid.pop()
        return name

    def add(raw: str) -> None:
        nonlocal linked
        parts.append(raw)
        if is_open.get("a"):
            linked += len(raw.strip())

    last = page.rfind(">") + 1  # no tag ends after the last bracket
    tag_ends = TagEnds(page, last)
    while m := _MARKUP.search(page, at, last):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)  # a comment that is never closed
            continue
        name, end, at = m["name"].lower(), m["end"], tag_ends.of(at) + 1
        rest = page[m.end() : at - 1]
        if name in _RAW:
            if name in _RAW_BLOCKS:
                close()
            if not end:
                pattern = ends.setdefault(name, re.compile(rf"</{name}\s*>", re.I))
                found = pattern.search(page, at) if pattern else None
                if found is None:
                    ends[name] = None
                    found = _AFTER_CODE.search(page, at) if name in _CODE else None
                    at = found.start() if found else len(page) if name in _CODE else at
                else:
                    at = found.end()
            continue
        if name == "br":
            parts.append(" ")
            continue
        inline = name in _INLINE
        if not inline:
            close()
        if end:
            if is_open.get(name):
                while pop() != name:
                    pass
        elif name not in _VOID and not rest.endswith("/"):
            if not inline:  # a new block ends an open paragraph; a new item the open item
                before = tree.names[stack[solid[-1]]]
                if before == "p" or before == name and name in _OPEN_ENDED:
                    for _ in range(len(stack) - solid[-1]):
                        pop()
            own = _element_costs(name, rest) if marks or name not in _GOOD_TAGS else (0, 0, 0)
            stack.append(tree.add(name, own, stack[-1]))
            is_open[name] = is_open.get(name, 0) + 1
            if not inline:
                solid.append(len(stack) - 1)
    if at < len(page):
        add(page[at:].split("<!--", 1)[0])
    close()
    _inherit(out, places, tree)
    return out, tree


def features(b: Block) -> list[float]:
    """What the classifier sees of a block: what ancestors say for content and for boilerplate, length, kind of element, end of a sentence, share of links, and 1."""
    words = b.text.count(" ") + 1
    content, boiler = b.costs
    return [content / 100, boiler / 100, min(1.0, words / 25), float(b.tag in _PROSE), float(b.text[-1] in ".!?…\"”'"), b.linked / max(1, len(b.text)), 1.0]


def terminal_costs(b: Block, weights: tuple[float, ...] = PRIOR) -> tuple[int, int]:
    """What a wrong label costs: taking content for boilerplate, and boilerplate for content. Each is the sum of the classifier's terms of one sign, in hundredths."""
    terms = [int(100 * w * x) for w, x in zip(weights, features(b), strict=True)]
    return sum(t for t in terms if t > 0), -sum(t for t in terms if t < 0)


def marked(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page with one article or main element, and whether each is its text (in it, and in no menu, form or the like), without what those two elements say for content."""
    found, tree = blocks(page, marks=False)
    names = tree.names
    if sum(x in _GOOD_TAGS for x in names) != 1:
        return [], []
    state = [0]  # 0: outside, 1: inside, 2: inside, but no text
    for e in range(1, len(names)):
        up = state[tree.parent[e]]
        state.append(1 if names[e] in _GOOD_TAGS and up == 0 else 2 if up == 1 and (_BAD_TAGS.get(names[e], 0) >= 700 or tree.own[e][1] >= 700 or tree.own[e][2]) else up)
    return found, [state[b.place] == 1 for b in found]


def fit(x: np.ndarray, y: np.ndarray, hold: float = 20.0, rounds: int = 30) -> tuple[float, ...]:
    """Weights of a logistic regression that is drawn towards PRIOR, `hold` strong, by Newton steps.

    They are scaled so that scores are as large on average as PRIOR's, since smoothness is measured against those, and
    none leaves the range from half to twice its prior. Without blocks of both kinds it is PRIOR itself.
    """
    prior = np.array(PRIOR)
    if len(y) == 0 or y.all() or not y.any():
        return PRIOR
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + hold * (w - prior)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), gradient)
    w = w * np.abs(x @ prior).mean() / max(1e-9, np.abs(x @ w).mean())
    ratio = np.clip(w / prior, 0.5, 2.0)
    return tuple(float(v) for v in ratio * prior)


def learn(pages: DataFrame, most: int = 400, html_col: str = "html", longest: int = 200_000) -> tuple[float, ...]:
    """Weights fitted on the pages of a sample that mark their text themselves (see marked).

    The sample is about `most` pages of at most `longest` bytes, those of least hash; it alone reaches the driver.
    """
    html = pages.select(F.col(html_col).alias("html")).where(F.octet_length("html") <= longest)
    n = html.where(F.lower("html").rlike("<(article|main)[\\s>]")).select("html")
    share = -(-most * SPACE // max(1, n.count()))
    rows = n.where(F.pmod(F.xxhash64("html"), F.lit(SPACE)) < min(SPACE, share)).orderBy(F.xxhash64("html")).limit(2 * most).collect()
    x, y = [], []
    for r in rows:
        found, text = marked(r.html)
        x += map(features, found)
        y += text
    return fit(np.array(x, float).reshape(-1, len(PRIOR)), np.array(y, float))


def smoothness(found: list[Block], tree: Tree) -> list[tuple[int, int, int]]:
    """Edges (i, j, capacity): neighbours in page order, blocks two apart, and blocks of one parent next to each other.

    A capacity falls with the distance in the tree, and with how unlike the two are in their share of links, so that a
    line of links between paragraphs doesn't take them with it.
    """
    linked = [b.linked / max(1, len(b.text)) for b in found]
    out, last = [], {}

    def join(i: int, j: int, most: int) -> None:
        most = int(most * (1 - CONTRAST * abs(linked[i] - linked[j])))
        d = tree.apart(found[i].place, found[j].place, most + 2)
        if near := most // (1 + max(0, d - 2)):
            out.append((i, j, near))

    for i, b in enumerate(found):
        if i:
            join(i - 1, i, 90)
        if i > 1:
            join(i - 2, i, 45)
        parent = max(0, tree.above[b.place])
        if parent in last and last[parent] < i - 2:
            join(last[parent], i, 60)
        last[parent] = i
    return out


def minimum_cut(left: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; left is what the source gives (or, below 0, the sink takes) at each node.

    Blocking flows along shortest ways, found together by levels (Dinic).
    """
    left, n = list(left), len(left)
    arcs: list[list[int]] = [[] for _ in range(n)]  # an edge is the arcs 2k and 2k + 1, one the other's way back
    to, room = [], []
    for i, j, c in edges:
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    while True:
        level = [0 if x > 0 else -1 for x in left]
        queue, ends = [i for i in range(n) if left[i] > 0], False
        for i in queue:
            for e in arcs[i]:
                j = to[e]
                if room[e] and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
                    ends = ends or left[j] < 0
        if not ends:
            return [x >= 0 for x in level]
        nth = [0] * n
        for s in [i for i in range(n) if left[i] > 0]:
            way: list[int] = []
            i = s
            while left[s] > 0:
                if left[i] < 0:
                    flow = min([left[s], -left[i], *(room[e] for e in way)])
                    left[s] -= flow
                    left[i] += flow
                    for e in way:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    short = next((k for k, e in enumerate(way) if not room[e]), len(way))
                    if short < len(way):
                        i = to[way[short] ^ 1]
                        del way[short:]
                    continue
                while nth[i] < len(arcs[i]):
                    e = arcs[i][nth[i]]
                    if room[e] and level[to[e]] == level[i] + 1:
                        break
                    nth[i] += 1
                else:
                    if not way:
                        break
                    i = to[way.pop() ^ 1]
                    nth[i] += 1
                    continue
                way.append(e)
                i = to[e]


def labels(found: list[Block], tree: Tree, weights: tuple[float, ...] = PRIOR) -> list[bool]:
    """Which blocks are content: the source's side of a minimum cut, with the terminal costs as capacities of source and sink.

    Where no block is, as on a page of one short line, it is those that no element around them speaks against and that are
    mostly not links.
    """
    kept = minimum_cut([c - b for c, b in (terminal_costs(f, weights) for f in found)], smoothness(found, tree))
    return kept if any(kept) else [not f.costs[1] and 2 * f.linked < len(f.text) for f in found]


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The page's content blocks, joined by single spaces."""
    found, tree = blocks(page or "")
    return " ".join(b.text for b, keep in zip(found, labels(found, tree, weights), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 400) -> DataFrame:
    """Main text of every page: blocks, the costs of a linear classifier that is fitted on the pages (see learn), and the minimum cut.

    Null or empty html gives an empty text; broken markup is read as far as it goes; repeated rows give repeated
    results; null ids and urls are passed through; an empty table gives no rows; other columns are ignored.

    Returns page_id, url, text, n_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, weights) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    weights = learn(pages, most, html_col)
    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema}
    return plain.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

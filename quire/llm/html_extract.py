"""Main text of web pages, by minimum-cut labelling of their blocks.

1. A tolerant reader cuts a page into blocks: text between block-level tags, with its open elements.
   Scripts, styles, titles and comments are no text, nor is what players, drawings, frames and choices hold; one
   of these without an end tag holds nothing.  The head ends at its end tag or where the body's elements or text
   begin; formulas are inline text.
2. A logistic classifier gives each block a log-odds of being content, from its innermost semantic element,
   class and id words, link density, length and punctuation.  It is trained here, on generated pages
   whose blocks are known (``page_maker``), so its odds are on one scale with the edges.
3. In a flow network the log-odds are capacities: a positive one from the source (content), a negative
   one to the sink (boilerplate).  Neighbouring blocks, and blocks near each other in the DOM, are
   joined by smoothness edges.  The minimum cut is the labelling of the least total cost.  Blocks whose
   capacity exceeds all their edges are settled first, exactly; maximum flow runs on the rest.
4. The text is that of the content blocks, in page order.

A null or empty page gives an empty text; so does one without content blocks.  Repeated rows give equal
texts.  Unclosed and stray tags are allowed.  Whole pages are read, however long.  Null ids and urls stay null, extra
columns are left alone, and an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Rows

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Elements whose content is no text of the page.
HOLDS_NONE = frozenset("noscript template svg iframe object canvas audio video select".split())
MATH = frozenset("math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mlabeledtr mspace mstyle semantics annotation annotation-xml mpadded mphantom menclose merror mfenced mmultiscripts mprescripts none maction".split())
HEAD = frozenset("base basefont bgsound link meta noframes html head".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select"}

# Words of class, id and role, and what the classifier's features look for.
AGAINST = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion popup modal overlay dialog cookie cookies consent gdpr notice alert nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar toolbar footer foot copyright legal sidebar side aside widget widgets rail comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup signin login register search form pagination pager tags skip complementary contentinfo".split()
)
#: Parts of compounds that say the same, and what an article's own class may say against it.
STEMS = re.compile("sidebar|footer|cookie|advert|breadcrumb|newsletter|comment|navbar|topnav|subscri|sponsor|promo|banner|disqus|masthead|popup", re.I)
NO_ARTICLE = frozenset("comment comments reply related teaser ad ads advert sponsored promo widget".split())
#: Short blocks that head or are boilerplate.
HEADS = frozenset(("comments", "leave a comment", "leave a reply", "related", "related articles", "related posts", "related stories", "read more", "share", "share this", "advertisement", "sponsored", "subscribe", "newsletter", "sign up", "log in", "tags"))
FOR = frozenset("article content post entry story body main text".split())
COMMENTS = frozenset("reply replies respond discussion disqus".split())
#: Words of a class that tell how a page is laid out, not what an element holds.
LAYOUT = re.compile(r"^(?:no|has|with|without|is|hide|show|js)[-_]|[-_]?(?:layout|page|template|theme)$|^(?:layout|page|template|theme)[-_]", re.I)
GOOD, BAD = frozenset(("article", "main")), frozenset("nav footer aside form button dialog menu header".split())
S_NEXT, S_NEAR, WINDOW = 0.8, 0.4, 3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_HOLDS_NONE = re.compile(rf"<({'|'.join(sorted(HOLDS_NONE))})\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Scanner:
    """The tokens of a page, in one pass: where a tag ends is looked up once for each quote and each gap between special characters."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] = {}  # where a tag ends that meets this opening quote
        self.seen: dict[str, tuple[int, int]] = {}

    def _next(self, what: str, at: int) -> int:
        """The next place of one of these characters, or the page's length."""
        begin, found = self.seen.get(what, (0, -1))
        if not begin <= at <= found:
            places = [p for p in (self.page.find(what, at),) if p >= 0] if len(what) == 1 else [p for p in (self._next(c, at) for c in what) if p < len(self.page)]
            found = min(places, default=len(self.page))
            self.seen[what] = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quoted ones don't, but where a quote stays open the next one does.  Without any, the page's length."""
        begin, passed, size = at, [], len(self.page)
        while True:
            at = self._next(">\"'", at)
            if at == size or self.page[at] == ">":
                break
            if at in self.ends:
                at = self.ends[at]
                break
            passed.append(at)
            at = self._next(self.page[at], at + 1) + 1
            if at > size:
                at = size
                break
        for quote in passed:
            self.ends[quote] = at
        return at if at < size else self._next(">", begin)

    def tokens(self) -> Iterator[tuple[int, str, str, str]]:
        """(place, kind, name, what): kind is text, start, end or raw; of a start tag what are its attributes, of text itself."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            if page[at] != "<":
                end = self._next("<", at)
                yield at, "text", "", page[at:end]
                at = end
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
            elif name := _NAME.match(page, at + 1 + (page[at + 1 : at + 2] == "/")):
                end, tag = self.tag_end(name.end()), name[0].lower()
                if end == size:
                    return  # a tag that never ends
                if page[at + 1] == "/":
                    yield at, "end", tag, ""
                elif tag in RAW:
                    yield at, "raw", tag, ""
                    close = _RAW_END[tag].search(page, end + 1)
                    end = close.end() - 1 if close else size
                else:
                    yield at, "start", tag, page[name.end() : end]
                at = end + 1
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                at = self._next(">", at) + 1
            else:
                yield at, "text", "", "<"
                at += 1


class Element:
    """An open element: what it says of itself (against), and what holds for its text once a page is read (place, against)."""

    __slots__ = ("tag", "depth", "place", "against", "supports", "in_link", "no_text", "parent", "block", "comments", "words", "holds_main", "holds_good")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.place, self.against, self.words = "", False, 0
        self.comments, self.holds_main, self.holds_good = False, tag == "main", False
        self.supports = parent.supports if parent else False
        self.in_link = tag == "a" or bool(parent and parent.in_link)
        self.no_text = tag in HOLDS_NONE or bool(parent and parent.no_text)
        self.block = parent.block if tag in INLINE and parent else self
        if attributes and not attributes.isspace():
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role"):
                    value = " ".join(v for v in value.split() if not LAYOUT.search(v))
                    words = {w.lower() for w in _WORDS.findall(value)}
                    self.supports |= bool(words & FOR)
                    self.comments |= bool(words & COMMENTS) or "comment" in value.lower()
                    if tag == "article":
                        self.against |= bool(words & NO_ARTICLE)
                    elif tag not in ("html", "body", "main"):
                        # the header of an article is part of it
                        self.against |= bool(words & (AGAINST - {"header"} if words & FOR else AGAINST)) or bool(STEMS.search(value))
                elif name == "style":
                    self.against |= "display:none" in value.replace(" ", "").lower()
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.against = True

    def settle(self, total: int, marked: bool) -> None:
        """place and against, given those of the parent, the page's words and whether it has an article or main element.

        What wraps the page is no boilerplate, whatever its name: an element around the main element, or one with over half of all words, other
        than comments, where no article is marked elsewhere; nor is a form of either kind."""
        most = 2 * self.words > total and not self.comments
        wraps = self.holds_main or most and (not marked or self.holds_good)
        own, place = self.against and not wraps, "good" if self.tag in GOOD else "bad" if self.tag in BAD else ""
        if place == "bad" and (self.tag == "form" and (most or self.holds_good) or self.tag == "header" and self.parent.place == "good"):
            place = ""
        self.place = place or (self.parent.place if self.parent else "")
        self.against = own or bool(self.parent and self.parent.against)


class Block:
    __slots__ = ("text", "words", "links", "element")

    def __init__(self, text: str, links: int, element: Element):
        self.text, self.words, self.links, self.element = text, text.count(" ") + 1, links, element


def _held(page: str) -> set[int]:
    """Where the start tags stand that hold no text and have an end tag."""
    closed: set[int] = set()
    if _HOLDS_NONE.search(page):
        open_at: dict[str, list[int]] = {}
        for at, kind, tag, what in Scanner(page).tokens():
            if tag in HOLDS_NONE:
                if kind == "start":
                    if not what.endswith("/") or tag != "svg":
                        open_at.setdefault(tag, []).append(at)
                elif open_at.get(tag):
                    closed.add(open_at[tag].pop())
    return closed


class Stack:
    """The open elements, and where each tag stands among them."""

    def __init__(self):
        self.items, self.at, self.blocks = [Element("", "", None)], {}, []

    @property
    def top(self) -> Element:
        return self.items[-1]

    def push(self, element: Element) -> None:
        for places in [self.at.setdefault(element.tag, [])] + [self.blocks] * (element.tag not in INLINE):
            places.append(len(self.items))
        self.items.append(element)

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, 0 if none is open."""
        return (self.at.get(tag) or [0])[-1]

    def cut(self, place: int) -> None:
        """Closes everything from a place on."""
        while len(self.items) > place:
            tag = self.items.pop().tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def close(self, tag: str, within) -> None:
        """Closes the innermost open ``tag``, unless one of ``within`` is open inside it."""
        place = self.last(tag)
        if place and all(self.last(other) < place for other in within if other != tag):
            self.cut(place)


def read_blocks(page: str) -> list[Block]:
    blocks: list[Block] = []
    closed = _held(page)
    stack, elements = Stack(), []
    parts: list[str] = []
    links = 0

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, links, stack.top.block))
                stack.top.block.words += blocks[-1].words - min(links, blocks[-1].words)
            parts.clear()
            links = 0

    for at, kind, tag, what in Scanner(page).tokens():
        if kind == "text":
            if stack.top.no_text:
                continue
            text = html.unescape(what) if "&" in what else what
            if stack.top.tag == "head" and not text.isspace():
                stack.cut(stack.last("head"))
            parts.append(text)
            if stack.top.in_link:
                links += len(text.split())
            continue
        if kind == "raw":
            end_block()
            continue
        if tag not in INLINE:
            end_block()
        if kind == "end":
            place = stack.last(tag)
            if place and not (tag in INLINE and stack.blocks and stack.blocks[-1] > place):  # an inline end tag doesn't close blocks
                stack.cut(place)
            continue
        if stack.top.tag == "head" and tag not in HEAD:
            stack.cut(stack.last("head"))  # its end tag may be left out
        if tag in MATH and what.endswith("/") or tag in HOLDS_NONE and at not in closed:
            continue
        if tag in CLOSES_P:
            stack.close("p", ("button", "td", "th", "li", "article", "section", "div", "object"))
        elif tag in SAME_CLOSES:
            for other in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                stack.close(other, SAME_CLOSES[tag].split())
        if tag not in VOID:
            stack.push(Element(tag, what, stack.top))
            elements.append(stack.top)
    end_block()
    _settle(elements)
    return blocks


def _settle(elements: list[Element]) -> None:
    """From the words that elements hold, what holds for their text; parents come before their children."""
    marked = False
    for e in reversed(elements):
        good = e.tag in GOOD and not e.against
        marked |= good and e.words > 0
        if e.parent:
            e.parent.words += e.words
            e.parent.holds_main |= e.holds_main
            e.parent.holds_good |= good or e.holds_good
    total = elements[0].parent.words if elements else 0
    for e in elements:
        e.settle(total, marked)


def features(block: Block, marked: bool) -> tuple[float, ...]:
    """marked: the page has an article or main element with text, so what stands outside of it is rarely content."""
    e = block.element
    ends = block.text[-1] in ".!?…\"'»”"
    heads = block.words <= 4 and " ".join(_LETTERS.findall(block.text.lower())) in HEADS
    return (
        1.0, e.place == "good", e.place == "bad", marked and not e.place, e.against, e.supports, min(1.0, block.links / block.words),
        min(40, block.words) / 40, ends, not ends and block.words < 6, heads, e.tag in HEADINGS,
    )


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def is_marked(blocks: list[Block]) -> bool:
    return any(b.element.place == "good" and not b.element.against for b in blocks)


def page_maker(rng: np.random.Generator) -> tuple[str, dict[str, bool]]:
    """(a page, block text -> whether it is content).  Half of the pages mark their article, some blocks say what they are."""
    known: dict[str, bool] = {}

    def words(n: int, ends: bool, content: bool) -> str:
        letters = rng.integers(97, 123, (n, 7))
        text = " ".join(bytes(row[: 2 + row[0] % 6].astype(np.uint8)).decode() for row in letters) + ("." if ends else "")
        known[text] = content
        return text

    def link(n: int, content: bool = False) -> str:
        return f'<a href="/x">{words(n, False, content)}</a>'

    def phrase() -> str:
        text = sorted(HEADS)[rng.integers(len(HEADS))] if rng.random() < 0.8 else words(2, False, False)
        known[text] = False
        return text

    def some(*ways):
        return ways[rng.integers(len(ways))]()

    def content() -> str:
        return some(
            lambda: f"<p>{words(int(rng.integers(12, 90)), True, True)}</p>", lambda: f"<p>{words(int(rng.integers(12, 90)), True, True)}</p>", lambda: f"<p>{words(int(rng.integers(1, 12)), rng.random() < 0.7, True)}</p>",
            lambda: f"<h2>{words(int(rng.integers(1, 9)), False, True)}</h2>", lambda: "<ul>" + "".join(f"<li>{words(int(rng.integers(1, 9)), rng.random() < 0.3, True)}</li>" for _ in range(3)) + "</ul>", lambda: f"<blockquote>{words(20, True, True)}</blockquote>",
            lambda: f"<div>{words(int(rng.integers(1, 20)), rng.random() < 0.5, True)}</div>", lambda: "<ul>" + "".join(f"<li>{link(2, True) if rng.random() < 0.2 else words(3, False, True)}</li>" for _ in range(2)) + "</ul>",
        )

    def against() -> str:
        word = ("sidebar", "ad", "main-menu", "page-footer", "cookie-notice", "comments", "related-content", "promo")[rng.integers(8)]
        return f' class="{word}"' if rng.random() < 0.5 else ""

    def within() -> str:
        """Boilerplate inside of an article, which says what it is."""
        return some(
            lambda: f'<div class="ad">{words(int(rng.integers(2, 30)), rng.random() < 0.5, False)}</div>', lambda: f"<form>{words(3, False, False)}</form>", lambda: f"<aside><p>{words(int(rng.integers(5, 30)), True, False)}</p></aside>",
            lambda: f'<div class="share">{words(3, False, False)}</div>', lambda: f'<section><h2>{phrase()}</h2><article class="comment"><p>{words(int(rng.integers(4, 40)), True, False)}</p></article></section>', lambda: f"<h3>{phrase()}</h3><ul><li>{link(3)}</li></ul>",
        )

    def boilerplate() -> str:
        return some(
            lambda: "<nav><ul>" + "".join(f"<li>{link(int(rng.integers(1, 4)))}</li>" for _ in range(5)) + "</ul></nav>", lambda: f"<ul{against()}>" + "".join(f"<li>{link(int(rng.integers(1, 4)))}</li>" for _ in range(4)) + "</ul>",
            lambda: f"<div{against()}>{words(int(rng.integers(2, 14)), rng.random() < 0.5, False)}</div>", lambda: f"<aside><h3>{words(2, False, False)}</h3><p>{words(int(rng.integers(5, 30)), True, False)}</p></aside>",
            lambda: f"<footer>{words(int(rng.integers(3, 20)), True, False)}</footer>", lambda: f'<div class="comments"><p>{words(int(rng.integers(4, 40)), True, False)}</p></div>', lambda: f"<form>{words(3, False, False)}</form>",
            lambda: f"<p>{words(int(rng.integers(1, 30)), rng.random() < 0.5, False)}</p>", lambda: f"<h3>{phrase()}</h3><ul>" + "".join(f"<li>{words(2, False, False)}</li>" for _ in range(3)) + "</ul>",
            lambda: f'<div class="advert">{words(int(rng.integers(5, 40)), True, False)}</div>', lambda: f"<header>{words(4, False, False)}</header>",
        )

    opens, closes = (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ('<div class="content">', "</div>"))[rng.integers(4)]
    one = lambda: content() if rng.random() < 0.85 else within()
    before, inside, after = ("".join(make() for _ in range(rng.integers(low, high))) for make, low, high in ((boilerplate, 1, 4), (one, 3, 12), (boilerplate, 1, 5)))
    return f"<html><body>{before}{opens}<h1>{words(6, False, True)}</h1>{inside}{closes}{after}</body></html>", known


#: Pages that the classifier is trained on, their seed, and the ridge on its weights.
TRAIN_PAGES, SEED, RIDGE = 400, 17, 0.5


@cache
def weights() -> tuple[float, ...]:
    """Logistic regression by Newton's method on the blocks of generated pages."""
    rng = np.random.default_rng(SEED)
    x, y = [], []
    for _ in range(TRAIN_PAGES):
        page, known = page_maker(rng)
        blocks = read_blocks(page)
        marked = is_marked(blocks)
        x += [features(b, marked) for b in blocks]
        y += [known[b.text] for b in blocks]
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    return tuple(np.round(w, 6).tolist())


def log_odds(block: Block, marked: bool, own: tuple[float, ...]) -> float:
    return sum(w * x for w, x in zip(own, features(block, marked), strict=True))


def _shared(a: Element, b: Element) -> float:
    """Depth of the nearest common ancestor, as a share of the deeper one's depth."""
    most = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a.depth / most if most else 1.0


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges = []
    for i, a in enumerate(blocks):
        for j in range(i + 1, min(i + 1 + WINDOW, len(blocks))):
            b = blocks[j].element
            # an element that says what it is shares no label with what lies outside of it
            near = _shared(a.element, b) if (a.element.place, a.element.against) == (b.place, b.against) else 0.1
            edges.append((i, j, (S_NEXT if j == i + 1 else 0.0) * near + S_NEAR * near / (j - i)))
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node stays with the source: the labels x that maximise sum(gain[i] x[i]) - sum(w |x[i] - x[j]|)."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(gain[i]) < sum(near[i].values()) or gain[i] == 0 and near[i]:
            continue
        label[i] = gain[i] > 0
        for j, w in near[i].items():
            gain[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, x in zip(rest, _max_flow(rest, gain, near), strict=True):
            label[i] = x
    return [bool(x) for x in label]


def _max_flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths; afterwards, what the source still reaches is content."""
    source, sink, tiny = -1, -2, 1e-12
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
    for i in rest:
        a, b = (source, i) if gain[i] > 0 else (i, sink)
        room[a][b], room[b][a] = abs(gain[i]), 0.0
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > tiny and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [i in came for i in rest]
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        flow = min(room[b][a] for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(path, path[1:], strict=False):
            room[b][a] -= flow
            room[a][b] = room[a].get(b, 0.0) + flow


def label_blocks(blocks: list[Block], own: tuple[float, ...]) -> list[bool]:
    """Whether each block is content."""
    marked = is_marked(blocks)
    return minimum_cut([log_odds(b, marked, own) for b in blocks], smoothness(blocks))


def main_text(page: str | None, own: tuple[float, ...] | None = None) -> str:
    blocks = read_blocks(page or "")
    return " ".join(b.text for b, k in zip(blocks, label_blocks(blocks, own or weights()), strict=True) if k)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    own = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for page_id, url, page in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                    text = main_text(page, own)
                    yield from out.add((page_id, url, text), len(text) + 128)
        yield out.flush()

    plain = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string")


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

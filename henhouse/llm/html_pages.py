"""A small, forgiving reader of HTML pages: containers, their scores, and text blocks."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

_TAG = re.compile(
    r"<(?:!--(?P<note>.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]{0,20000}\"|'[^']{0,20000}')*+)>"
    r"|/?[a-zA-Z][^>]*(?P<cut>>|\Z))", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_ASKED = frozenset("class id role hidden aria-hidden style".split())
_MARK = re.compile(r">|=\s*([\"'])")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Names of HTML and words that sites use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary "
                  "table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
OUT = frozenset("aside audio button canvas dialog datalist embed footer form head iframe input label map menu meter nav noembed noframes "
                "noscript object optgroup option progress script select style svg template textarea title video xmp".split())
OUT_WORDS = frozenset("ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments "
                      "consent contentinfo cookie cookies copyright disclaimer disqus dialog footer gdpr header login masthead menu modal "
                      "nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
                      "recommended related replies reply respond search share sharing sidebar signup skip social sponsor "
                      "sponsored subscribe subscription toolbar topbar widget".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
#: Of these, the ones that also name what holds a whole site.
SITE_WORDS = frozenset("main page".split())
#: Elements that end when one of these starts before their end tag.
ENDS = {"p": BLOCK - {"html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
        "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
#: An end of an element is looked for no further out than these.
WALLS = frozenset("table ul ol dl select".split())


@dataclass
class Node:
    tag: str
    path: str
    parent: int
    out: bool
    hint: float
    whole: bool = False  # an article or main by its tag or role
    named: bool = False  # one by its class or id
    marks: tuple[str, ...] = ()  # the classes and id that hold a word of OUT_WORDS
    prose: bool = False  # text that is not short or links stands in it outside inner containers
    chars: int = 0  # of its text outside links and inner elements
    score: float = 0.0


@dataclass
class Page:
    """``nodes`` of a page in order, and its text ``blocks``: (node, text), with their ``values``."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    left_out: set[str] = field(default_factory=set)  # paths of containers that their marks leave out


    def within(self, node: int, chosen: set[int]) -> bool:
        while node >= 0:
            if node in chosen:
                return True
            node = self.nodes[node].parent
        return False

    def text(self, chosen: set[int]) -> str:
        return "\n".join(t for n, t in self.blocks if self.within(n, chosen))

    def held(self, chosen: set[int]) -> float:
        return sum(v for (n, _), v in zip(self.blocks, self.values) if v and self.within(n, chosen))

    def whole(self, node: int) -> int:
        """The container of the article that ``node`` is a part of: the nearest article or
        main, else the outermost one that is named so, has text beside ``node``, or is
        kept in spite of its marks, as it or its kind holds most of the page."""
        top, at = node, node
        while at >= 0 and (n := self.nodes[at]).tag not in ("body", "html"):
            if n.tag in CONTAINERS:
                if n.whole:
                    return at
                if n.named or n.prose or n.marks:
                    top = at
            at = n.parent
        return top

    def marked(self, node: int) -> bool:
        while node >= 0 and not self.nodes[node].marks:
            node = self.nodes[node].parent
        return node >= 0

    def candidates(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.score > 0]

    def best(self) -> int:
        """The article around the container with the highest score (the first of equals), or -1."""
        best = max(self.candidates(), key=lambda i: (self.nodes[i].score, -i), default=-1)
        return self.whole(best) if best >= 0 else -1


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


def _described(tag: str, rest: str, inside: bool) -> tuple[str, bool, float, bool, bool, tuple[str, ...]]:
    """The step of the generalised path, whether the element is not article text, a hint,
    whether it is a whole article by its tag or role, or by its class or id, and its marks."""
    if not rest.strip(" /"):
        whole = tag in ("article", "main")
        return tag, tag in OUT or (tag == "header" and not inside), 1.25 if whole else 1.0, whole, False, ()
    attrs = {n: next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(rest) if (n := m[1].lower()) in _ASKED}
    classes = attrs.get("class", "").split()
    step = ".".join([tag, *sorted({re.sub(r"\d+", "", c).strip("-_").lower() for c in classes} - {""})])
    out = tag in OUT or (tag == "header" and not inside) or attrs.get("role", "").lower() in OUT_ROLES \
        or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    names = [*classes, attrs.get("id", "")]
    named = _words(" ".join(names))
    marks: tuple[str, ...] = ()
    if tag not in ("html", "body", "article", "main") and named & OUT_WORDS:
        marks = tuple(sorted({re.sub(r"\d+", "", n) for n in names if _words(n) & OUT_WORDS}))
    whole = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
    return step, out, 1.25 if whole or named & GOOD_WORDS and not marks else 1.0, whole, bool(named & (GOOD_WORDS - SITE_WORDS)), marks


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """The place of the ``>`` that ends the tag whose attributes start at ``at``, quoted
    values of any length passed over; -1 if a quote does not end or no ``>`` comes. ``dead``
    keeps the quotes known to lead there, so each is looked at once for a page."""
    seen = []
    while (m := _MARK.search(source, at)) and m[1] and m.end() not in dead:
        seen.append(m.end())
        close = source.find(m[1], m.end())
        if close < 0:
            break
        at = close + 1
    if m and not m[1]:
        return m.start()
    dead.update(seen)
    return -1


def _left_out(nodes: list[Node]) -> list[bool]:
    """Of each node, whether it stands in a part that its marks say is not the article.
    Marks do not count for an element around an article or main, nor where the elements
    that bear the same ones hold more than half of the page's text (0.9 of it on a page that
    has text in an article or main beside them)."""
    if not any(n.marks for n in nodes):
        return [False] * len(nodes)
    around, chars = [n.whole for n in nodes], [n.chars for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):  # inner nodes come after the outer ones
        if (up := nodes[i].parent) >= 0:
            around[up] |= around[i]
            chars[up] += chars[i]
    total, held = sum(n.chars for n in nodes), Counter()
    bearers: list[frozenset] = []
    articles: list[int] = []  # the outermost article or main around each node, or -1
    beside: dict[int, frozenset] = {}  # articles with text, and the marks around them
    for i, n in enumerate(nodes):
        above = bearers[n.parent] if n.parent >= 0 else frozenset()
        if n.marks and n.marks not in above:  # inside another one with the same marks it is counted with it
            held[n.marks] += chars[i]
            above = above | {n.marks}
        bearers.append(above)
        outer = articles[n.parent] if n.parent >= 0 else -1
        articles.append(outer if outer >= 0 or not n.whole else i)
        if n.whole and chars[i]:
            beside[i] = above
    within: dict[tuple[str, ...], set[int]] = {}
    for i, n in enumerate(nodes):
        if n.marks:
            within.setdefault(n.marks, set()).add(articles[i])
    least = {m: 0.9 if any(m not in above and a not in inside for a, above in beside.items()) else 0.5 for m, inside in within.items()}
    out: list[bool] = []
    for i, n in enumerate(nodes):
        own = bool(n.marks) and not around[i] and held[n.marks] <= least[n.marks] * total
        out.append(own or n.parent >= 0 and out[n.parent])
    return out


def read(source: str) -> Page:
    """The containers and text blocks of a page; never fails, whatever the markup."""
    page = Page()
    nodes, stack = page.nodes, [-1]
    parts: list[tuple[int, str, bool]] = []  # node, text, in a link
    found: list[tuple[int, list[tuple[int, str, bool]]]] = []
    links = hidden = inside = 0  # open elements of each sort

    def flush() -> None:
        nonlocal parts
        if parts:
            found.append((stack[-1], parts))
            parts = []

    def say(text: str) -> None:
        if text and not hidden:
            parts.append((stack[-1], text, links > 0))
            if stack[-1] >= 0 and not links:
                nodes[stack[-1]].chars += len(text.strip())

    def close(depth: int) -> None:
        nonlocal links, hidden, inside
        while len(stack) > depth:
            node = nodes[stack[-1]]
            if node.tag in BLOCK:
                flush()
            stack.pop()
            links -= node.tag == "a"
            hidden -= node.out
            inside -= node.tag in ("article", "main")

    at, size = 0, len(source)
    dead: set[int] = set()
    while at < size:
        m = _TAG.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at:m.start()])
        at = m.end()
        name = m["name"] or (n[1] if m["cut"] and (n := _NAME.match(m[0])) else None)
        if not name:
            continue
        tag, rest = name.lower(), m["rest"] or ""
        if m["cut"] and m[0][1] != "/":  # a value too long for the expression, or a stray quote
            start = m.start() + 1 + len(name)
            if (end := _tag_end(source, start, dead)) >= 0:
                rest, at = source[start:end], end + 1
        if m["end"] or m[0].startswith("</"):
            for depth in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[depth]].tag
                if open_ == tag:
                    close(depth)
                    break
                if tag == "p" and open_ in WALLS:
                    break
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if tag in BLOCK:
                flush()
            at = end.end() if end else size
            continue
        if tag in BLOCK:
            flush()
            for depth in range(len(stack) - 1, 0, -1):
                open_ = nodes[stack[depth]].tag
                if open_ in ENDS and tag in ENDS[open_]:
                    close(depth)
                    break
                if open_ in WALLS or open_ in CONTAINERS and open_ != "td":
                    break
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            if tag in ("br", "wbr", "img"):
                say(" " if tag != "wbr" else "")
            continue
        step, out, *hints = _described(tag, rest, inside > 0)
        up = stack[-1]
        path = f"{nodes[up].path}/{step}" if up >= 0 and tag in CONTAINERS | OUT else (nodes[up].path if up >= 0 else step)
        nodes.append(Node(tag, path, up, out, *hints))
        stack.append(len(nodes) - 1)
        links += tag == "a"
        hidden += out
        inside += tag in ("article", "main")
    close(1)
    flush()
    out = [*_left_out(nodes), False]  # the last one stands for text outside all elements
    for at in {n for _, said in found for n, _, _ in said if out[n]}:
        while out[at]:
            if nodes[at].tag in CONTAINERS:
                page.left_out.add(nodes[at].path)
            at = nodes[at].parent
    for node, said in found:
        said = [p for p in said if not out[p[0]]]
        text = " ".join(entities.unescape("".join([t for _, t, _ in said])).split())
        if text:
            _add(page, node, text, sum(len(t.strip()) for _, t, link in said if link))
    return page


def _add(page: Page, node: int, text: str, linked: int) -> None:
    """A block of text, and its value for the containers around it."""
    value = max(0.0, len(text) - 3.0 * linked) * (1.0 if len(text) >= 25 else 0.2)
    page.blocks.append((node, text))
    page.values.append(value)
    at, share, inner = node, 1.0, True
    while at >= 0 and value:
        outer = page.nodes[at]
        if outer.tag in CONTAINERS:
            outer.score += value * share * outer.hint
            outer.prose |= inner and len(text) >= 25
            share, inner = share / 2, False
        at = outer.parent


def vote(source: str) -> tuple[str, float] | None:
    """The generalised path of the page's best container and its score."""
    page = read(source)
    best = page.best()
    return (page.nodes[best].path, page.nodes[best].score) if best >= 0 else None


def ballot(source: str) -> tuple[str | None, set[str]]:
    """The generalised path of the page's best container, and those of all that hold text,
    also where it is left out."""
    page = read(source)
    best = page.best()
    return page.nodes[best].path if best >= 0 else None, {page.nodes[i].path for i in page.candidates()} | page.left_out


def extract(source: str, paths: list[str]) -> str:
    """The text of the articles that the containers on ``paths`` are parts of. Where they
    hold no fair part (0.3) of what the page's best container has, its text as well, unless
    it is one with marks (long comments below a short article)."""
    page = read(source)
    best = page.best()
    if best < 0:
        return "\n".join(t for _, t in page.blocks)
    winning = set(paths)
    chosen = {page.whole(i) for i in page.candidates() if page.nodes[i].path in winning}
    if not chosen or page.held(chosen) < 0.3 * page.held({best}) and not page.marked(best):
        chosen.add(best)
    return page.text(chosen)
